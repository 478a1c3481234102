"""Text functions as Spark columns. A null text gives null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.udfs import boundaries, html_unescape, nfc, unwrap

#: Every white space of Unicode, for a regex class; Java's \\s is ASCII only.
SPACES = r"\s\x0B\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# Patterns that must decide as the corpus' earlier tools did.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TAG = r"</?[A-Za-z][^>]*>"
ANY_TAG = r"<[^>]+>"
RISKY_TAG = r"(?i)<(script|iframe|object|embed)\b"
SENTENCE_END = r"(?<=[.!?。！？；;])[" + SPACES + r"]+|\n+"
CURRENCY = r"(?i)^\s*[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]{1,2})?(\s*(USD|EUR|GBP|dollars?|euros?|pounds?|million|billion|trillion))?\s*$"
MATH_COMMANDS = (
    "frac dfrac tfrac sqrt sum prod int iint iiint lim log ln sin cos tan alpha beta gamma delta theta lambda mu rho sigma omega"
    " partial nabla cdot times leq geq neq approx infty mathrm mathbf mathit text begin end"
).split()
MATH_SUBJECTS = ("mathematics", "physics", "chemistry", "astronomy", "electricalengineering", "electrical engineering")
VISUAL = r"\\(textbf|textit|emph|mathrm|mathbf|mathit|textsubscript|textsuperscript)\{([^{}]*)\}"
STRONG_SYMBOLS = r"[_^={}≤≥∫∑√]"
OPERATION = r"[A-Za-z0-9)\]}]\s*[+\-*/=<>]\s*[A-Za-z0-9({\[]"
CJK = r"[\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF]"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, rf"\A[{SPACES}]+|[{SPACES}]+\z", "")


def unix_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def compose(c: Column) -> Column:
    """Unicode NFC; only texts beyond ASCII go to Python."""
    beyond = c.rlike(r"[^\x00-\x7f]")
    return F.when(beyond, nfc(F.when(beyond, c))).otherwise(c)


def normalize(c: Column, collapse: bool = True, composed: bool = True) -> Column:
    """Line ends, tabs, control characters, NFC, blanks before line ends, runs of blanks and of line ends, outer space.

    ``collapse=False`` keeps runs of blanks, as the block parser needs.
    """
    c = F.replace(unix_lines(c), F.lit("\t"), F.lit("    "))
    c = F.regexp_replace(c, CONTROL, "")
    if composed:
        c = compose(c)
    c = F.regexp_replace(c, r"[ \u00a0]+\n", "\n")
    if collapse:
        c = F.regexp_replace(c, r"[ \t\u00a0]+", " ")
    return strip(F.regexp_replace(c, r"\n{4,}", "\n\n\n"))


def normalize_spaces(c: Column) -> Column:
    """Only white space: runs of blanks, line ends, outer space."""
    c = unix_lines(F.regexp_replace(c, r"[ \t\u00a0]+", " "))
    return strip(F.regexp_replace(c, r"\n{4,}", "\n\n\n"))


def strip_tags(c: Column, unescape: bool = True) -> Column:
    """Every tag becomes a blank; entities are decoded."""
    bare = F.regexp_replace(c, ANY_TAG, " ")
    return strip(html_unescape(bare) if unescape else bare)


def has_tags(c: Column) -> Column:
    return c.rlike(TAG)


def has_risky_tags(c: Column) -> Column:
    return c.rlike(RISKY_TAG)


def has_unicode_issues(c: Column) -> Column:
    """Replacement, private-use or unassigned characters."""
    return c.rlike(r"[\uFFFD\p{Co}\p{Cn}]")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def is_currency(c: Column) -> Column:
    return c.rlike(CURRENCY)


def is_math_subject(c: Column) -> Column:
    """False for a null subject."""
    return F.coalesce(F.lower(strip(c)).isin(*MATH_SUBJECTS), F.lit(False))


def looks_like_math(c: Column) -> Column:
    """Whether what stands between two dollars is a formula rather than a price or prose."""
    inner = strip(c)
    fits = (inner != "") & ~inner.contains("\n") & (F.length(inner) <= 256) & ~is_currency(inner)
    signs = inner.rlike(r"\\(" + "|".join(MATH_COMMANDS) + r")\b") | inner.rlike(STRONG_SYMBOLS) | inner.rlike(OPERATION)
    return fits & signs


def text_flags(c: Column) -> Column:
    """1 for a formula within a line, 2 for a table of tabs or pipes, 4 for a tag; told from the text alone."""
    math = c.rlike(r"(?d)\\\(.*?\\\)") | c.rlike(r"(?d)\\\[.*?\\\]")
    tabbed = F.size(F.filter(F.split(c, "\n", -1), lambda line: line.contains("\t") & (F.length(line) > 10))) >= 2
    piped = c.rlike(r"(?md)^\|.+\|.+\|$")
    bit = lambda cond, n: F.when(cond, n).otherwise(0)
    return F.when(c.isNotNull(), bit(math, 1) + bit(tabbed | piped, 2) + bit(has_tags(c), 4))


def sentences(c: Column) -> Column:
    """Sentences (after an end mark and white space, or at line ends), stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, SENTENCE_END, -1), strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, rf"\n[{SPACES}]*\n", -1), strip), lambda p: p != "")


def split_long(c: Column, max_chars: int = 420, stripped: bool = False) -> Column:
    """Chunks of at most ``max_chars``: sentences joined by a blank as far as they fit; a longer sentence is sliced.

    A text within the limit is one chunk, an empty one none.
    """
    text = c if stripped else strip(c)
    size = F.lit(max_chars)

    def step(state: Column, sentence: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(sentence) - 1) / size).cast("int")), lambda k: F.substring(sentence, k * size + 1, size))
        flushed = F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        joined = F.when(state["open"] == "", sentence).otherwise(F.concat(state["open"], F.lit(" "), sentence))
        pair = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
        return F.when(F.length(sentence) > size, pair(F.concat(flushed, slices), F.lit(""))).when(F.length(joined) <= size, pair(state["done"], joined)).otherwise(pair(flushed, sentence))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    folded = F.aggregate(sentences(text), start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(folded)


def paragraph_chunks(c: Column, max_chars: int = 420) -> Column:
    return F.flatten(F.transform(paragraphs(c), lambda p: split_long(p, max_chars, stripped=True)))


def safe_boundaries(c: Column) -> Column:
    """Positions where a text may be cut: 0, after a line end, after an end mark before a blank or line end, its length.

    In Arrow batches: a running sum over a text's parts would copy its array for each of them in Spark's own functions.
    """
    return boundaries(c)


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def safe_file_name(c: Column, longest: int = 120) -> Column:
    """Letters, digits and ``-_.`` stay, anything else becomes an underscore; cut to ``longest``."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_"), 1, longest)


def strip_visual_commands(c: Column) -> Column:
    """Bold, italic, roman and super- or subscript text commands give way to what they wrap, however deep."""
    return F.when(c.rlike(VISUAL), unwrap(F.when(c.rlike(VISUAL), c))).otherwise(c)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def fallback_id(text: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the first 200 characters."""
    return F.substring(F.sha1(F.substring(text, 1, 200).cast("binary")), 1, 12)


def hash_uniform(key: Column, seed: int | str) -> Column:
    """A whole number in [0, 2**60) from SHA-256 of key and seed: the same in every engine."""
    digest = F.substring(F.sha2(F.concat(key, F.lit(f":{seed}")), 256), 1, 15)
    return F.conv(digest, 16, 10).cast("bigint")


def count_of(c: Column, needle: str) -> Column:
    """How often a string occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
