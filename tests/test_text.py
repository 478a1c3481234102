import html
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as X

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
dirt = st.lists(st.text(alphabet="ab \t\r\n\u00a0\u2003é.!;。\x00\x0b\x1f<>&\"$\\()|{}e\u0301", max_size=60), min_size=1, max_size=60)


def each(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "raw,tidy",
    [
        ("a\r\nb\rc", "a\nb\nc"), ("a\tb", "a b"), ("a \u00a0 b", "a b"), ("a \u00a0\nb", "a\nb"), ("a\n\n\n\n\n\nb", "a\n\n\nb"), ("a\n\n\nb", "a\n\n\nb"),
        ("\x00a\x0b\x1f b\x7f", "a b"), ("e\u0301", "\u00e9"), ("\u2003 a \u2003", "a"), ("", ""), (" \n ", ""), ("a\u2003\u2003b", "a\u2003\u2003b"),
    ],
)
def test_normalize_pairs(spark, raw, tidy):
    assert each(spark, [raw], X.normalize) == [tidy]


@few
@given(dirt)
def test_normalize(spark, values):
    once = each(spark, values, X.normalize)
    assert each(spark, once, X.normalize) == once
    for raw, t in zip(values, once):
        assert t == t.strip() and not set(t) & set("\r\t\x00\x0b\x1f") and "  " not in t and "\n\n\n\n" not in t and " \n" not in t
        kept = lambda x: [c for c in unicodedata.normalize("NFC", x) if c.isprintable() and not c.isspace()]
        assert kept(t) == kept("".join(c for c in raw if c not in "\x00\x0b\x1f"))


@few
@given(dirt)
def test_strip_and_tags(spark, values):
    assert each(spark, values, X.strip) == [v.strip() for v in values]
    assert each(spark, values, X.strip_tags) == [html.unescape(re.sub(r"<[^>]+>", " ", v)).strip() for v in values]


@pytest.mark.parametrize(
    "text,size,want",
    [
        ("One. Two. Three.", 9, ["One. Two.", "Three."]), ("One. Two. Three.", 8, ["One.", "Two.", "Three."]), ("abcdefgh", 3, ["abc", "def", "gh"]), ("A. bcdefgh. I.", 5, ["A.", "bcdef", "gh.", "I."]),
        ("  short  ", 9, ["short"]), ("", 5, []), ("   ", 5, []), ("one\ntwo three", 6, ["one", "two th", "ree"]), ("a; b; c", 4, ["a;", "b; c"]),
    ],
)
def test_chunk_pairs(spark, text, size, want):
    assert each(spark, [text], lambda c: X.split_long(c, size)) == [want]


@few
@given(dirt, st.integers(3, 30))
def test_chunks(spark, values, size):
    for raw, got in zip(values, each(spark, values, lambda c: X.split_long(c, size))):
        assert all(0 < len(c) <= size for c in got)
        assert "".join("".join(got).split()) == "".join(raw.split())
        if len(raw.strip()) <= size:
            assert got == [raw.strip()] * bool(raw.strip())


@few
@given(dirt)
def test_boundaries(spark, values):
    def plain(t):
        marks = {0, len(t)} | {i + 1 for i, c in enumerate(t) if c == "\n" or (c in ".!?。！？" and t[i + 1 : i + 2] in (" ", "\n"))}
        return sorted(marks)

    assert each(spark, values, X.safe_boundaries) == list(map(plain, values))


@pytest.mark.parametrize(
    "text,flags",
    [("a \\(x\\) b", 1), ("\\[x\ny\\]", 0), ("col a\tcol b\ncol c\tcol d", 2), ("a\tb\nc\td", 0), ("|a|b|", 2), ("<p>x", 4), ("a < b > c", 0), ("", 0), ("\\(x\\) <b>\n|a|b|", 7)],
)
def test_flags(spark, text, flags):
    assert each(spark, [text], X.text_flags) == [flags]


def test_math_or_price(spark):
    assert each(spark, ["x=2", "10", "1,000.50 USD", "a", "\\alpha", "a + b", "x_1", "", "5 million", "x" * 257 + "=", "a\n=b", "≤"], X.looks_like_math) == [True, False, False, False, True, True, True, False, False, False, False, True]


def test_nulls_and_small_ones(spark):
    assert each(spark, [None], X.normalize) == [None] and each(spark, [None], X.text_flags) == [None]
    assert each(spark, ["A&B<c>\"d\""], X.escape_html) == ["A&amp;B&lt;c&gt;&quot;d&quot;"]
    assert each(spark, ["a/b c-é.x", "x" * 200], X.safe_file_name) == ["a_b_c-é.x", "x" * 120]
    assert each(spark, ["\\textbf{a \\emph{b}} c"], X.strip_visual_commands) == ["a b c"]
    assert each(spark, ["ok", "bad \ufffd", "\ue000"], X.has_unicode_issues) == [False, True, True]
    assert each(spark, ["漢", "がな", "latin"], X.has_cjk) == [True, True, False]
