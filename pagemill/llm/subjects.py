"""Problem 2: the subject areas of each page.

Weighted terms come from a small labelled table and from the whole corpus: every sentence that labelled terms place
in an area counts for its other words, so a word's weight says how surely it tells the area and how rare it is
among all sentences. A multi-pattern automaton finds the terms; a sentence's scores are divided by its length, and it
is about every area whose score exceeds that area's threshold, which is calibrated on labelled passages held out of
the fit. A page has every area that at least a given share of its sentences are about. Stock notices are told by the
corpus and not by their words: a notice stands between ever different sentences, while a sentence of a text that was
copied keeps its neighbours.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pagemill.session import materialize, ship

_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_DISPLAY = re.compile(r"\\\[.*?\\\]|\$\$.*?\$\$|\[latex\].*?\[/latex\]|\\begin\{(\w+\*?)\}.*?\\end\{\1\}", re.S | re.I)
_INLINE = re.compile(r"\\\(.*?\\\)|\$[^$\s](?:[^$\n]*?[^$\s])?\$", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ALL = (1 << 64) - 1
_LINES = re.compile("[\r\n\x0b\x0c\x85\u2028\u2029]+")
_SPLIT = re.compile(r"(?<=[.!?。！？])[\"'”’»)\]]*\s+|(?<=;)\s+(?=[A-Z“\"])|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+")
_ENDED = re.compile(r"[.!?。！？;:,][\"'”’»)\]]*$")
_HEAD = re.compile(r"^(?:#{1,6}\s|={2,}\s|chapter\s+\d|section\s+\d|part\s+\d|—\s*\d+\s*—$)", re.I)
def sentences(text: str | None, least_words: int = 3) -> list[list[str]]:
    """The words of each sentence: no formulas or tables that stand alone, no headings.

    Null and empty texts have none. Hard-wrapped lines are joined first.
    """
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "\\" in text or "$" in text or "[latex]" in text:
        text = _INLINE.sub(" ", _DISPLAY.sub("\n", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    kept, opened = [], False
    lines = [x for x in map(str.strip, _LINES.split(text)) if x]
    for i, line in enumerate(lines):
        if "\t" in line or line.count("|") >= 2 or " & " in line or _HEAD.match(line):
            opened = False
            continue
        ended = bool(_ENDED.search(line))
        if not ended and not opened and len(line) < 60 and (i + 1 == len(lines) or lines[i + 1][:1].isupper() or not lines[i + 1][:1].isalpha()) and len(line.split()) <= 8:
            continue  # a short line by itself: a heading
        kept.append(line)
        opened = not ended
    out = []
    for sentence in _SPLIT.split(" ".join(kept)):
        words = _WORD.findall(sentence.lower())
        if len(words) >= least_words:
            out.append(words)
    return out


def sentence_key(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


class Notices:
    """The keys of stock sentences as a bitmap of two bits each in 2**26 (8 MB, whatever their number).

    Of n notices and any other sentence, it takes the sentence for a notice with a probability of (n / 2**25)**2.
    """

    def __init__(self, bits: bytes = b""):
        self.bits = bits

    def __contains__(self, key: int) -> bool:
        bits = self.bits
        return bool(bits) and all(bits[p >> 3] >> (p & 7) & 1 for p in (key >> 38, key >> 12 & (1 << 26) - 1))


class Lexicon:
    """Weighted terms of areas and the areas' thresholds for a sentence, with their automaton."""

    def __init__(self, terms: dict[str, dict[str, float]], thresholds: dict[str, float], notices: Notices | None = None, rival: float = 0.5):
        self.terms, self.thresholds, self.notices, self.rival = terms, thresholds, notices or Notices(), rival
        self.automaton = None

    def _built(self):
        if self.automaton is None:
            found = ahocorasick.Automaton()
            for term, weights in self.terms.items():
                found.add_word(f" {term} ", tuple(weights.items()))
            found.make_automaton()
            self.automaton = found
        return self.automaton

    def __getstate__(self):
        return self.terms, self.thresholds, self.notices, self.rival

    def __setstate__(self, state):
        self.terms, self.thresholds, self.notices, self.rival = state
        self.automaton = None

    def scores(self, words: list[str]) -> dict[str, float]:
        if not self.terms:
            return {}
        totals: dict[str, float] = {}
        for _, weights in self._built().iter(f" {' '.join(words)} "):
            for area, w in weights:
                totals[area] = totals.get(area, 0.0) + w
        size = math.sqrt(len(words))
        return {a: s / size for a, s in totals.items()}

    def areas_of(self, words: list[str]) -> list[str]:
        """The areas a sentence is about: their scores exceed their thresholds and are no mere fraction of the greatest."""
        scores = self.scores(words)
        if not scores:
            return []
        least = self.rival * max(scores.values())
        return [a for a, s in scores.items() if s >= self.thresholds.get(a, math.inf) and s > least]


def seed_terms(examples: list[Row], least: int = 2, purity: float = 0.8) -> dict[str, str]:
    """Words of the labelled passages that surely tell one area."""
    counts: dict[str, Counter] = defaultdict(Counter)
    passages: Counter = Counter()
    for row in examples:
        passages[row["area"]] += 1
        for word in {w for s in sentences(row["text"]) for w in s}:
            counts[word][row["area"]] += 1
    out = {}
    for word, by in counts.items():
        area, n = by.most_common(1)[0]
        if n >= least and n >= purity * sum(by.values()) and len(word) > 2:
            out[word] = area
    return out


def _told(words: list[str], seeds: dict[str, str]) -> Counter:
    return Counter(seeds[w] for w in words if w in seeds)


def corpus_counts(pages: DataFrame, text_col: str, seeds: dict[str, str]) -> DataFrame:
    """Of the whole corpus: (term, area, n), the sentences with the term that its other words place in the area; and
    (key, beside, n), the sentences' keys, the keys of what stands beside them, and how often."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        beside: Counter = Counter()

        def flush() -> pa.RecordBatch:
            terms, pairs = list(counts), list(beside)
            low, high = [None] * len(terms), [None] * len(pairs)
            signed = lambda k: pa.array([*low, *(np.array([p[k] for p in pairs], dtype=np.uint64).view(np.int64).tolist())], pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.array([*(t[0] for t in terms), *high], pa.string()), pa.array([*(t[1] for t in terms), *high], pa.string()), signed(0), signed(1), pa.array([*counts.values(), *beside.values()], pa.int64())],
                names=["term", "area", "key", "beside", "n"],
            )
            counts.clear()
            beside.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = sentences(text)
                keys = [0, *map(sentence_key, found), 0]
                for before, key, after in zip(keys, keys[1:], keys[2:]):
                    beside[key, (before * 3 + after) & _ALL] += 1
                for words in found:
                    told = _told(words, seeds)
                    best, n = (told.most_common(1) or [("", 0)])[0]
                    second = sum(told.values()) - n
                    own = "" if n == 0 or second >= n else best
                    alone = n - second == 1  # without one of its words the sentence tells nothing
                    for word in set(words):
                        if len(word) > 2:
                            counts[word, "" if alone and word in seeds else own] += 1
            if len(counts) + len(beside) > 200_000:
                yield flush()
        yield flush()

    found = pages.select(F.col(f"`{text_col}`").alias("text")).where("text is not null").mapInArrow(run, "term string, area string, key bigint, beside bigint, n bigint")
    return found.groupBy("term", "area", "key", "beside").agg(F.sum("n").alias("n"))


def notice_keys(counts: DataFrame, least: int = 12, share: float = 0.6) -> DataFrame:
    """(key) of the sentences that stand in at least ``least`` different places, and in as many as ``share`` of the times they come."""
    each = counts.where("key is not null").groupBy("key").agg(F.count("*").alias("places"), F.sum("n").alias("times"))
    return each.where((F.col("places") >= least) & (F.col("places") >= share * F.col("times"))).select("key")


def collected(keys: DataFrame) -> Notices:
    place = keys.select(F.explode(F.array(F.shiftrightunsigned("key", 38), F.shiftrightunsigned("key", 12).bitwiseAND(F.lit((1 << 26) - 1)))).alias("p")).select((F.col("p") + 1).alias("p"))
    parts = place.groupBy(F.expr("bitmap_bucket_number(p)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    bits = bytearray(1 << 23)
    for row in parts.toLocalIterator():  # at most 2,048 rows of 4 KB
        bits[(row["part"] - 1) * 4096 : row["part"] * 4096] = row["bits"]
    return Notices(bytes(bits))


def thresholds_of(lexicon: Lexicon, held: list[Row], false_share: float = 0.005) -> dict[str, float]:
    """For each area the middle between what the held-out sentences of other areas reach, but for ``false_share`` of them,
    and the least score of its own (of those that reach more); without such a gap, what the others reach."""
    others: dict[str, list[float]] = defaultdict(list)
    own: dict[str, list[float]] = defaultdict(list)
    areas = {a for by in lexicon.terms.values() for a in by}
    for r in held:
        for words in sentences(r["text"]):
            scores = lexicon.scores(words)
            for a in areas:
                (own if a == r["area"] else others)[a].append(scores.get(a, 0.0))
    out = {}
    for a in areas:
        seen = sorted(others[a])
        edge = seen[min(len(seen) - 1, math.ceil((1 - false_share) * len(seen)))] if seen else 0.0
        out[a] = (edge + min((x for x in own[a] if x > edge), default=1.02 * edge)) / 2 or math.inf
    return out


def fit_lexicon(
    pages: DataFrame, examples: DataFrame, text_col: str = "target_text", id_col: str = "example_id", purity: float = 0.6, most_terms: int = 8192, least_count: int = 4, most_examples: int = 20_000, held_out: int = 4
) -> Lexicon:
    """The lexicon of a corpus and a labelled table (example_id, area, text).

    The first ``most_examples`` labelled rows by their id are read. Every ``held_out``-th passage of an area only
    calibrates its threshold, the others give the seeds. Statistics cover all pages; at most ``most_terms`` terms
    (the surest in the most sentences) are kept, since the lexicon goes to every task; ``lexicon.left_out`` says how many
    more there were. Rows of ``examples`` with a null area or text are left out.
    """
    labelled = examples.where("area is not null and text is not null").orderBy(id_col, "area", "text").select("area", "text").limit(most_examples).collect()
    nth: Counter = Counter()
    held, fitted = [], []
    for r in labelled:
        (held if nth[r["area"]] % held_out == held_out - 1 else fitted).append(r)
        nth[r["area"]] += 1
    seeds = seed_terms(fitted)
    if not seeds:
        return Lexicon({}, {})
    counts = materialize(corpus_counts(pages, text_col, seeds), "term-counts")
    placed = counts.where("area <> ''")
    by_term = counts.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.when(F.col("area") != "", F.col("n"))).alias("placed"))
    best = placed.groupBy("term").agg(F.max(F.struct("n", "area")).alias("best"))
    sure = by_term.join(best, "term").where((F.col("placed") >= least_count) & (F.col("best.n") >= purity * F.col("placed")) & (F.col("placed") >= 0.3 * F.col("df")))
    n_sure = sure.count()
    sure = sure.orderBy(F.desc(F.col("best.n") * F.col("best.n") / F.col("placed")), "term").limit(most_terms).select("term")
    rows = placed.join(sure, "term").select("term", "area", "n").collect()
    # every sentence counts for each of its words; the most frequent word bounds their number from below
    most = by_term.agg(F.max("df")).first()[0] or 1
    frequency = {r["term"]: r["df"] for r in by_term.join(sure, "term").select("term", "df").collect()}
    grouped: dict[str, dict[str, int]] = defaultdict(dict)
    for r in rows:
        grouped[r["term"]][r["area"]] = r["n"]
    terms: dict[str, dict[str, float]] = {}
    for term, by in grouped.items():
        total = sum(by.values())
        rarity = math.log(1 + most / frequency[term])
        terms[term] = {area: n / total * rarity for area, n in by.items() if n >= 0.15 * total}
    for term, area in seeds.items():
        terms.setdefault(term, {area: math.log(1 + most)})
    lexicon = Lexicon(terms, {}, collected(notice_keys(counts)))
    lexicon.thresholds = thresholds_of(lexicon, held or fitted)
    lexicon.left_out = max(0, n_sure - most_terms)
    return lexicon


def page_areas(pages: DataFrame, lexicon: Lexicon, id_col: str = "id", text_col: str = "target_text", least_share: float = 0.25) -> DataFrame:
    """(id, area, share, n_sentences): every area of at least ``least_share`` of a page's sentences.

    A page delivered again counts once; null ids, null and empty texts, and texts without sentences have no area;
    other columns are not read.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(lexicon)  # of bounded size, see fit_lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            ids, areas, shares, counts = [], [], [], []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [s for s in sentences(text) if sentence_key(s) not in lexicon.notices]
                for area, n in Counter(a for s in found for a in lexicon.areas_of(s)).items():
                    if n >= least_share * len(found):
                        ids.append(page)
                        areas.append(area)
                        shares.append(n / len(found))
                        counts.append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(areas, pa.string()), pa.array(shares, pa.float64()), pa.array(counts, pa.int64())], names=["id", "area", "share", "n_sentences"])

    source = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    return source.mapInArrow(run, "id string, area string, share double, n_sentences bigint").dropDuplicates(["id", "area"])
