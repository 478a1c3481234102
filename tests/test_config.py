import pytest

from pagemill.config import merged, overridden


def test_settings():
    base = {"a": {"b": 1, "c": 2}, "d": [1]}
    assert merged(base, {"a": {"c": 3, "e": 4}, "d": 5}) == {"a": {"b": 1, "c": 3, "e": 4}, "d": 5}
    assert overridden(base, ["a.b=2.5", "x.y=text", "d=[2, 3]", "a.c=true"]) == {"a": {"b": 2.5, "c": True}, "d": [2, 3], "x": {"y": "text"}}
    assert base == {"a": {"b": 1, "c": 2}, "d": [1]}
    with pytest.raises(ValueError):
        overridden(base, ["novalue"])
