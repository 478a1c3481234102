import random

import pytest

from pagemill.llm.subjects import Lexicon, collected, fit_lexicon, page_areas, seed_terms, sentence_key, sentences

WORDS = {"cooking": "oven dough skillet simmer pastry broth".split(), "sailing": "mast keel rudder harbour spinnaker anchor".split()}


def said(rnd, area):
    a, b, c = rnd.sample(WORDS[area], 3)
    return f"The {a} and a small {b} stay near the {c} today."


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(1)
    examples = [(k, a, " ".join(said(rnd, a) for _ in range(3)), 1) for a in WORDS for k in range(12)] + [(None, None, "nothing", 1), (5, "cooking", None, 1)]
    pages = [(f"p{k}", " ".join(said(rnd, "cooking" if k % 2 else "sailing") for _ in range(8)), "x") for k in range(120)]
    mixed = " ".join([said(rnd, "cooking")] * 6 + [said(rnd, "sailing")] * 2)
    passing = " ".join([said(rnd, "cooking")] * 9 + [said(rnd, "sailing")])
    pages += [("mixed", mixed, "x"), ("mixed", mixed, "y"), ("passing", passing, "x"), ("none", "The chapter is given in part nine. See the small table for more.", None), ("null", None, "x"), ("empty", "", "x"), (None, mixed, "x")]
    return spark.createDataFrame(pages, "id string, target_text string, area string"), spark.createDataFrame(examples, "example_id int, area string, text string, share int")


def test_areas(tables):
    pages, examples = tables
    got = {}
    for r in page_areas(pages, fit_lexicon(pages, examples)).collect():
        got.setdefault(r.id, []).append(r.area)
    assert sorted(got["mixed"]) == ["cooking", "sailing"] and got["passing"] == ["cooking"]
    assert all(got[f"p{k}"] == ["cooking" if k % 2 else "sailing"] for k in range(120))
    assert not {"none", "null", "empty", None} & set(got)


def test_empty_tables(tables):
    pages, examples = tables
    assert page_areas(pages.where("false"), fit_lexicon(pages.where("false"), examples)).count() == 0
    bare = fit_lexicon(pages, examples.where("false"))
    assert bare.terms == {} and page_areas(pages, bare).count() == 0


def test_sentences():
    text = "A heading\nThe first sen­tence is here. The second, where \\(a. b\\) holds; it goes\non over a line.\n\\[x = y\\]\na\tb\n1\t2"
    assert [" ".join(s) for s in sentences(text)] == ["the first sentence is here", "the second where holds it goes on over a line"]
    assert sentences(None) == sentences("") == sentences(" \n ") == []
    assert len(sentences("The oven is hot now. " * 20_000)) == 20_000


def test_lexicon_alone():
    assert Lexicon({}, {}).areas_of(["oven"]) == []
    lexicon = Lexicon({"oven": {"a": 2.0}, "mast": {"b": 2.0, "c": 0.5}, "pan": {"a": 9.0}}, {"a": 0.1, "b": 0.1, "c": 0.1})
    assert sorted(lexicon.areas_of(["mast", "oven"])) == ["a", "b"]  # both, and not what is a fraction of them
    assert lexicon.areas_of(["mast", "pan"]) == ["a"] and Lexicon({"oven": {"a": 2.0}}, {"a": 3.0}).areas_of(["oven"]) == []
    assert seed_terms([]) == {}


def test_notices_are_told_by_their_neighbours(spark, tables):
    """A notice of any words, even an area's, counts for nothing; sentences of a page that was copied often do count."""
    rnd = random.Random(6)
    notice = "The oven and the skillet of this house may be seen on open days."
    pages = [(f"n{k}", f"{said(rnd, 'sailing')} {notice} {said(rnd, 'sailing')} {notice}", "") for k in range(40)] + [(f"c{k}", "The page rank of dough is fixed. A skillet and an oven stay hot. The broth needs a simmer.", "") for k in range(40)]
    frame = tables[0].union(spark.createDataFrame(pages, "id string, target_text string, area string"))
    lexicon = fit_lexicon(frame, tables[1])
    assert sentence_key(sentences(notice)[0]) in lexicon.notices and sentence_key(sentences(pages[-1][1])[1]) not in lexicon.notices
    got = {}
    for r in page_areas(frame, lexicon).collect():
        got.setdefault(r.id, []).append(r.area)
    assert all(got[f"n{k}"] == ["sailing"] and got[f"c{k}"] == ["cooking"] for k in range(40))
    assert set(lexicon.thresholds) == {"cooking", "sailing"} and lexicon.left_out == 0


def test_bitmap_of_notices(spark):
    keys = [sentence_key([f"w{k}"]) for k in range(300)]
    held = collected(spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys[:200]], "key bigint"))
    assert all(k in held for k in keys[:200]) and not any(k in held for k in keys[200:])
