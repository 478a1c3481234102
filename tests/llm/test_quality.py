import random

import pytest

from pagemill.llm.quality import NUMBERS, describe, not_running_text, text_statistics

PROSE = "The grey river follows the narrow bridge near the garden. It is common to find a lantern there, and nobody minds."
TEXTS = {
    "text": [
        PROSE, PROSE.upper(), PROSE.lower().replace(".", "").replace(",", ""), PROSE + "\n\\[a = b\\]\n" + PROSE, "\n".join(PROSE[k : k + 40] for k in range(0, len(PROSE), 40)), f"<p>{PROSE}</p>\n<p>{PROSE}</p>",
        "每個樣本對答案和測量。邊界被地圖,的收成了方法。", "Eine Mühle ist mit der Brücke und dem Hafen, weil die Ordnung auch dem Kessel dient.", "L'école est dans la forêt, mais la carte est sur le pont du moulin.", PROSE * 3 + "\na\tb\n1\t2",
    ],
    "list": ["- grey river\n- old bridge\n- iron gate", "1. grey river\n2. old bridge of stone\n3. iron gate", "[x] grey river\n[ ] old bridge\n[x] iron gate", "Grey River\nOld Bridge\nIron Gate\nPaper Lantern", "river: grey water\nbridge: old stone\ngate: iron bars", "Old bridge ........ 1\nGrey river ............. 14", "<li>grey river</li>\n<li>old bridge</li>", "[1] Ann, Bob: grey rivers. Vol. 3, pp. 1-9\n[2] Cy, Dee: old bridges. Vol. 4, pp. 2-8"],
    "table": ["| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | four |", "a\tb\tc\n1\t2\t3\n4\t5\t6", "river,bridge,gate\n12,4.5,gate\n7,bridge,3", "river & bridge \\\\\n12 & 4.5 \\\\\n7 & gate \\\\", "<table>\n<tr><td>river</td><td>12</td></tr>\n<tr><td>gate</td><td>7</td></tr>\n</table>", "river     bridge     gate\n12        4.5        7\ngate      3          8"],
    "junk": ["~~~~~~~~~~~~\n------------\n============", "orakan " * 40, "Home | Menu | Home | Login | Home | Menu | Top | Home | Login | Menu", "00000000  0a 88 0d f9 4c fd be 67 cd 74\n00000010  33 88 34 7f 33 28 d5 6d 04 ec", "q|zt wrx0 !kv ;dhg' " * 12, "".join(random.Random(1).choices("abcdefghijkABCDEFGHIJ0123456789+/", k=300)), "█◆☐^◆†^¶☒¤▒░~" * 8, "ThÃ©Â ï¿½rÃ©v�r fÃ¼Â lâ€™ws ï¿½ Ã©Â brï¿½dgÃ© Ã¼Â � nÃ©Â r"],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in TEXTS.items() for t in ts])
def test_kinds(kind, text):
    assert describe(text)["kind"] == kind


def test_repetition_decides():
    sentence = "Please return every borrowed volume to the front desk before the library closes this evening."
    notice = "All visitors of the old reading room must leave their coats and bags with the attendant at the entrance, where they get a ticket."
    for text in ("\n".join([sentence] * 200), " ".join([sentence] * 200), "\n\n".join([f"{notice}\n{PROSE}"] * 100)):
        assert describe(text)["kind"] == "junk"
    assert describe("\n".join([sentence] * 3 + [PROSE, notice]))["kind"] == "text"
    assert describe("\n".join([f"- {a} {b}" for a in ("grey", "old", "iron", "paper") for b in "river bridge gate lantern harbour garden meadow valley copper anchor".split()] * 20))["kind"] == "list"


def test_statistics():
    s = describe("One two two.\nOne two two.\n\nThree!")
    assert (s["n_words"], s["n_lines"], s["n_chars"]) == (7, 3, 33)
    assert s["mean_word_length"] == pytest.approx(23 / 7) and s["line_end_share"] == 1.0
    assert s["dup_line_share"] == pytest.approx(1 / 3) and s["dup_paragraph_share"] == 0.0
    assert s["symbol_ratio"] == pytest.approx(3 / 26) and s["top_3gram_share"] == pytest.approx(18 / 23)


def test_blank_texts_have_no_kind():
    for text in (None, "", " \n\t "):
        s = describe(text)
        assert s["kind"] is None and all(s[n] == 0 for n in NUMBERS) and s["n_words"] == 0


def test_table(spark):
    rows = [(k, t, "clash") for k, t in enumerate(sum(TEXTS.values(), []))] + [(None, "- a b\n- c d\n- e f g h", "x"), (90, None, "x"), (91, "short", "x"), (92, PROSE * 3000, "x"), (0, PROSE, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = text_statistics(df)
    assert got.count() == len(rows)
    found = {r.doc_id: r.kind for r in not_running_text(got).collect()}
    assert found == {r.doc_id: r.kind for r in got.collect() if r.kind in ("list", "table", "junk") and r.n_chars >= 20} and 91 not in found and 92 not in found
    assert text_statistics(df.where("false")).count() == 0
