"""Problem 7: byte-level BPE with a hierarchical-bitmap rank queue.

The merge order comes from a public rank file (token bytes in base64, rank), whose path is a parameter.
A pre-token's bytes form a linked list; every adjacent pair that is a token waits, under its rank, in the bucket
of that rank. Two levels of bitmaps say which buckets hold anything, so the next rank is found by two
find-first-set steps whatever the length of the pre-token. Merging leaves old entries behind; they are told by
a changed pair and skipped.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORD_BITS = 8
_WORD_MASK = (1 << _WORD_BITS) - 1


class Encoder:
    """Encodes text by one rank file. ``None`` and the empty text both give no ids."""

    CACHE = 300_000
    CACHED_CHARS = 64

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
        self.find = regex.compile(pattern).findall
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        self.shift = max(self.ranks.values()).bit_length()
        self.pairs: dict[int, int] = {}
        get, shift, pairs = self.ranks.get, self.shift, self.pairs
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left = get(token[:cut])
                if left is not None:
                    right = get(token[cut:])
                    if right is not None:
                        pairs[left << shift | right] = rank
        encoder = self

        class Cache(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = tuple(encoder.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= encoder.CACHED_CHARS:
                    if len(self) >= encoder.CACHE:
                        self.clear()
                    self[piece] = ids
                return ids

        self.cache = Cache()

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        pair_rank, shift = self.pairs.get, self.shift
        symbols = [self.of_byte[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i in range(n - 1):
            rank = pair_rank(symbols[i] << shift | symbols[i + 1])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> _WORD_BITS
                    words[word] = words.get(word, 0) | 1 << (rank & _WORD_MASK)
                    top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << _WORD_BITS | low.bit_length() - 1
            words[word] = bits ^ low
            if bits == low:
                top ^= 1 << word
            places = buckets.pop(rank)
            places.sort()
            for k, i in enumerate(places):
                left = symbols[i]
                j = after[i]
                if left < 0 or j >= n or pair_rank(left << shift | symbols[j]) != rank:
                    continue  # a stale entry
                symbols[i] = rank
                symbols[j] = -1
                j = after[i] = after[j]
                lower = False
                fresh = []
                if j < n:
                    before[j] = i
                    new = pair_rank(rank << shift | symbols[j])
                    if new is not None:
                        fresh.append((new, i))
                h = before[i]
                if h >= 0:
                    new = pair_rank(symbols[h] << shift | rank)
                    if new is not None:
                        fresh.append((new, h))
                for new, at in fresh:
                    lower |= new <= rank
                    if new in buckets:
                        buckets[new].append(at)
                    else:
                        buckets[new] = [at]
                        word = new >> _WORD_BITS
                        words[word] = words.get(word, 0) | 1 << (new & _WORD_MASK)
                        top |= 1 << word
                if lower and k + 1 < len(places):  # a pair of lower rank came up: it goes first
                    if rank in buckets:
                        buckets[rank].extend(places[k + 1 :])
                    else:
                        buckets[rank] = places[k + 1 :]
                        word = rank >> _WORD_BITS
                        words[word] = words.get(word, 0) | 1 << (rank & _WORD_MASK)
                        top |= 1 << word
                    break
        return [s for s in symbols if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.cache.__getitem__, self.find(text))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(len, map(self.cache.__getitem__, self.find(text))))


_ENCODERS: dict[int, Encoder] = {}


def encoder_for(vocabulary: bytes) -> Encoder:
    """The worker's encoder; it is built once and kept while the worker lives."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())  # a fixed file of under 1 MB


def encode_column(df: DataFrame, text: str, keep: list[str], out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and the token ids of ``text`` as ``out`` (array<int>); one pass, no shuffle.

    Null and empty texts give the empty array. Repeated rows stay as they are; an empty table gives an empty
    table; further columns of ``df`` are not read. ``out`` must not be one of ``keep`` (ValueError).
    """
    if out in keep:
        raise ValueError(f"{out!r} is both kept and made")
    ship(df.sparkSession)
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value)
        lookup, find = encoder.cache.__getitem__, encoder.find
        for batch in batches:
            flat, ends = array("i"), [0]
            for part in batch.column(len(keep)).to_pylist():
                if part:
                    flat.extend(chain.from_iterable(map(lookup, find(part))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], names=[*keep, out])

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{out}` array<int>"])
    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """As ``encode_column``, with only the number of ids (bigint)."""
    if out in keep:
        raise ValueError(f"{out!r} is both kept and made")
    ship(df.sparkSession)
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value)
        for batch in batches:
            counts = pa.array([encoder.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, out])

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{out}` bigint"])
    return source.mapInArrow(run, schema)
