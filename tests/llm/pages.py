"""Small invented pages with copies, edits, containments and all kinds of dirt, and plain versions of the operators."""

import random
import re
import unicodedata

NOUNS = "river stone harbour ledger candle orchard window signal bridge engine garden paper lantern valley copper meadow anchor basket thunder pepper".split()
VERBS = "carries follows lifts paints measures keeps turns finds covers opens guards mends".split()
ADJECTIVES = "grey quiet narrow heavy bright early broken distant patient hollow plain sudden".split()

_ZERO = re.compile("[­​-‍⁠﻿]")


def sentence(rnd):
    return f"The {rnd.choice(ADJECTIVES)} {rnd.choice(NOUNS)} {rnd.choice(VERBS)} the {rnd.choice(ADJECTIVES)} {rnd.choice(NOUNS)} near {rnd.randint(2, 999)} {rnd.choice(NOUNS)}s."


def text(rnd, n):
    return " ".join(sentence(rnd) for _ in range(n))


def edited(rnd, t, n):
    words = t.split(" ")
    for _ in range(n):
        k = rnd.randrange(len(words))
        words[k : k + 1] = rnd.choice([[], ["extra", words[k]], [rnd.choice(NOUNS)]])
    return " ".join(words)


def make(seed=3, n=60):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        t = text(rnd, rnd.randint(3, 14))
        rows.append((f"d{k}-p00000", "train", t))
        if k % 4 == 0:
            rows.append((f"e{k}-p00000", rnd.choice(["val", "test"]), edited(rnd, t, rnd.randint(0, 6))))
        if k % 5 == 0:
            parts = t.split(". ")
            rnd.shuffle(parts)
            rows.append((f"f{k}-p00000", rnd.choice(["train", "val", "test"]), ". ".join(parts)))
        if k % 6 == 0:
            rows.append((f"g{k}-p00000", "test", " ".join(t.split(" ")[: max(22, len(t.split(" ")) // 2)])))
    rows += [(f"h{k}-p00000", rnd.choice(["train", "val"]), rows[0][2].upper().replace(" ", " ")) for k in range(12)]
    rows += [(f"x{k}", "val", t) for k, t in enumerate([None, "", "   ", "short page of few words", "­​"])]
    rows += [(f"n{k}", s, rows[1][2]) for k, s in enumerate([None, "other"])]
    rows += rows[:5]  # delivered again
    return rows


def words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", _ZERO.sub("", t or "")).lower())


def triples(t):
    w = words(t)
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 20 else None


def plain_overlaps(rows, share=0.7):
    sets = {i: (s, triples(t)) for i, s, t in rows}
    out = set()
    for a, (sa, ta) in sets.items():
        for b, (sb, tb) in sets.items():
            if ta and tb and sa in ("val", "test") and sb == "train" and len(ta & tb) >= share * len(ta):
                out.add((min(a, b), max(a, b)))
    return out


def plain_groups(rows, share=0.6):
    sets = {i: triples(t) for i, _, t in rows}
    ids = sorted(i for i, t in sets.items() if t)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= share * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if find(a) == find(b)}
