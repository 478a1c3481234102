import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm.tokenizer import PATTERN, VOCABULARY, Encoder, count_tokens, encode_column


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as file:
        return Encoder(file.read())


@pytest.fixture(scope="module")
def public(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_null_and_empty_have_no_ids(encoder):
    assert encoder.encode(None) == [] and encoder.encode("") == []


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text_as_the_public_library(encoder, public, text):
    ids = encoder.encode(text)
    assert ids == public.encode_ordinary(text)
    assert public.decode(ids) == text


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin", "é漢🧪", "=-", "\n "])
def test_very_long_pieces(encoder, public, letters):
    rnd = random.Random(len(letters))
    text = "".join(rnd.choice(letters) for _ in range(20_000))
    assert encoder.encode(text) == public.encode_ordinary(text)


def test_special_strings_are_text(encoder, public):
    assert encoder.encode("<|endoftext|>") == public.encode_ordinary("<|endoftext|>")
    assert 50256 not in encoder.encode("a<|endoftext|>b")


def test_cache_forgets(encoder):
    small = Encoder.__new__(Encoder)
    small.__dict__.update(encoder.__dict__)
    encoder.CACHE, before = 10, encoder.CACHE
    try:
        for k in range(50):
            encoder.encode(f" word{k} x{k}y")
            assert len(encoder.cache) <= 10
    finally:
        encoder.CACHE = before


def test_column(spark, public):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (3, "", None), (1, "Hello  world", "x"), (None, "é", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string")
    got = encode_column(df, "text", ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), public.encode_ordinary(t or "")) for i, t, _ in rows)
    counts = count_tokens(df, "text", ["doc_id"]).agg(F.sum("n_tokens")).first()[0]
    assert counts == sum(len(public.encode_ordinary(t or "")) for _, t, _ in rows)
    assert encode_column(df.where("false"), "text", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        encode_column(df, "text", ["doc_id"], out="doc_id")
