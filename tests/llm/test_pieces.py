import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm.pieces import cut, oversized_pieces, page_pieces, page_texts, sections
from pagemill.schemas import BLOCK


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .!\n\t|#$\\[]()é🧪-", max_size=400), st.integers(2, 80), st.data())
def test_pieces_cover_the_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    blocks = data.draw(st.lists(st.integers(0, len(text)), max_size=4))
    pieces = cut(text, limit, overlap, blocks)
    if not text:
        assert pieces == []
        return
    assert pieces[0][:2] == (0, 0) and pieces[-1][2] == len(text)
    for (_, _, end), (start, own, _) in zip(pieces, pieces[1:]):
        assert own == end and start == max(0, own - overlap)
    assert all(end - start <= limit and end > own for start, own, end in pieces)
    assert len(pieces) == 1 or len(text) > limit


def test_natural_places():
    text = "# One\nFirst sentence here. Second sentence \\(a. b\\) goes on.\n\nA\tB\n1\t2\n3\t4\n# Two\nLast words of all."
    for limit in (40, 55, 70):
        pieces = [text[own:end] for _, own, end in cut(text, limit, 0)]
        assert all(p[-1] in "\n. " for p in pieces)
        assert all(p.count("\\(") == p.count("\\)") for p in pieces)
    assert any(p.startswith("# Two") for p in (text[own:end] for _, own, end in cut(text, 60, 0)))


def own(text, limit):
    return [text[a:b] for _, a, b in cut(text, limit, 0)]


@pytest.mark.parametrize("form", ["{hash} {name}\n", "<h{n}>{name}</h{n}>\n", "<h{n}>{name}</h{n}>"])
def test_siblings_of_different_parents_stay_apart(form):
    head = lambda n, name: form.format(hash="#" * n, n=n, name=name)
    words = "Some words of this part are here.\n"
    text = head(2, "A") + words + head(3, "a1") + words * 2 + head(3, "a2") + words + head(2, "B") + words
    got = own(text, 150)
    assert "".join(got) == text and not any("a2" in p and head(2, "B") in p for p in got)
    assert any(p.startswith(head(2, "A")) and "a1" in p for p in own(text, 151)) and any(p.startswith(head(2, "B")) for p in got)
    tree = sections(text)
    assert [(s.level, [x.level for x in s.below]) for s in tree.below] == [(2, [3, 3]), (2, [])]


def test_levels_that_are_passed_over():
    tree = sections("### x\nwords\n# y\n#### z\nwords\n## w\nwords\n# v")
    assert [(s.level, [x.level for x in s.below]) for s in tree.below] == [(3, []), (1, [4, 2]), (1, [])]
    assert sections("").below == [] and sections("no heading").body_end == 10


@pytest.mark.parametrize("html", [False, True])
def test_nested_items_stay_with_their_item(html):
    if html:
        text = "<ul>" + "".join(f"<li>item {k} has some words<ul><li>below {k} one</li><li>below {k} two</li></ul></li>" for k in range(6)) + "</ul>"
    else:
        text = "".join(f"- item {k} has some words\n  - below {k} one\n  - below {k} two\n" for k in range(6))
    got = own(text, 120)
    assert "".join(got) == text and len(got) > 2
    assert all(p.count("one") == p.count("two") == p.count("has some") for p in got)
    small = own(text, 45)
    assert "".join(small) == text and all(p.lstrip(" ").startswith(("- ", "<li>", "<ul>")) for p in small)


def test_long_formula_is_not_cut():
    formula = "$" + " + ".join(f"x_{{{k}}}" for k in range(60)) + "$"
    text = "Words stand here. " * 20 + formula + " and go on. " + "Words stand here. " * 20
    assert len(formula) > 400 and any(formula in p for p in own(text, 600))
    assert all(len(p) <= 100 for p in own("It costs $5 here. " * 30 + "Or $6 there. " * 30, 100))


def test_small_subtrees_are_merged():
    text = "\n".join(f"Line number {k} is short." for k in range(100))
    sizes = [end - start for start, _, end in cut(text, 300, 30)]
    assert min(sizes[:-1]) > 240


def test_no_natural_place():
    assert [b - a for a, _, b in cut("x" * 1000, 300, 50)] == [300, 300, 300, 250]


def test_bad_overlap():
    with pytest.raises(ValueError):
        cut("abc", 10, 10)


def test_pages(spark):
    part = lambda text=None, target=None: {"kind": "text" if text else "math_inline", "text": text, "tex": None, "target": target}
    block = lambda kind, parts=None, target=None: {"id": "b", "kind": kind, "parts": parts, "tex": None, "rows": None, "target": target}
    blocks = [block("paragraph", [part("One "), part(target="\\(x\\)")]), block("math_display", None, "\\[y\\]"), block("table", [], "a\tb"), block("paragraph", [])]
    rows = [("p1", "d", 0, blocks, None, 1), ("p2", "d", 1, blocks, "", 1), ("p3", None, None, None, None, 1), ("p4", "d", 3, None, "word " * 500, 1), ("p4", "d", 3, None, "word " * 500, 1), (None, "d", 4, None, "x" * 5000, 1)]
    df = spark.createDataFrame(rows, f"id string, doc_id string, page_index int, blocks array<{BLOCK}>, target_text string, piece int")
    texts = {r.id: r.text for r in page_texts(df).collect()}
    assert texts["p1"] == texts["p2"] == "One \\(x\\)\n\\[y\\]\na\tb" and texts["p3"] == ""
    got = page_pieces(df, 1200, 120).collect()
    assert sorted(r.id for r in got if r.n_pieces == 1) == ["p1", "p2", "p3"]
    four = sorted((r.piece, r.start, r.end) for r in got if r.id == "p4")
    assert len(four) == 6 and all(len(r.text) == r.end - r.start for r in got)
    assert [r.id for r in oversized_pieces(page_texts(df), 1200, 120).select("id").distinct().collect()] == ["p4"]
    assert page_pieces(df.where("false"), 1200, 120).count() == 0
    assert df.where(F.length("target_text") > 1200).count() == 3
