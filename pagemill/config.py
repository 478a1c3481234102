"""Nested settings: defaults, a file's values over them, and ``key.path=value`` overrides."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping


Path = tuple[str, ...]


def leaves(config: Mapping, at: Path = ()) -> Iterator[tuple[Path, object]]:
    """Every value that is no filled mapping, with its path."""
    for name, value in config.items():
        if isinstance(value, Mapping) and value:
            yield from leaves(value, (*at, name))
        else:
            yield (*at, name), value


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with ``over`` on top: the values of ``over`` are put one by one at their paths; neither is changed.

    An empty mapping in ``over`` adds nothing to a mapping and takes the place of anything else.
    """
    out: dict = {}
    for path, value in (*leaves(base), *leaves(over)):
        *way, last = path
        here = out
        for name in way:
            if not isinstance(here.get(name), dict):
                here[name] = {}
            here = here[name]
        if isinstance(value, Mapping):
            value = here[last] if isinstance(here.get(last), dict) else {}
        here[last] = value
    return out


def overridden(config: Mapping, settings: Iterable[str]) -> dict:
    """Each setting is ``a.b.c=value``; values are JSON where they parse as JSON, else text."""
    out = dict(config)
    for s in settings:
        path, sign, raw = s.partition("=")
        if not sign or not path:
            raise ValueError(f"{s!r} is no key.path=value")
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        for name in reversed(path.split(".")):
            value = {name: value}
        out = merged(out, value)
    return out
