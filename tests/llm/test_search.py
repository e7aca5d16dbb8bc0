"""Ranked search against a plain model: every score of every item and document, with tiers small enough to be fallen through."""

import math
import re
from collections import Counter

import pytest

from needledrop.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def model(docs, items, k=50):
    each = [(d, terms(t)) for d, t in docs]
    each = [(d, t) for d, t in each if t]
    n_docs, n_terms = len(each), sum(len(t) for _, t in each)
    df = Counter(w for _, t in each for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for d, t in each:
            tf, m = Counter(t), 50 + (50 * len(t) * n_docs) // n_terms
            score = sum(weight[w] * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in set(terms(text)) if w in tf)
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")


def made(seed, n=400, words=60):
    import random

    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(words)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 40)))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(60)]  # copies: many equal scores
    return docs, [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 12)))) for i in range(12)]


@pytest.mark.parametrize("tiers", [((1, 0), (2, 0)), ((30, 0.1), (60, 0.5)), ((2000, 0), (32000, 0))])
def test_equals_all_scores(spark, tiers):
    docs, items = made(int(tiers[0][0]))
    d, q = tables(spark, docs, items)
    for k in (3, 50)[tiers[0][0] > 1 :]:
        index = L.build(d, L.asked_terms(q), tiers)
        assert sorted(map(tuple, L.search(index, q, k).collect()), key=repr) == model(docs, items, k)


def test_items_fall_through_and_are_proven(spark, monkeypatch):
    """Of a frequent term's postings only the first tier is read where a rare term decides, and all of them where none does."""
    docs = [(i, "common " + "filler " * (i % 7)) for i in range(300)] + [(300 + i, "common rare") for i in range(60)]
    d, q = tables(spark, docs, [(1, "common rare"), (2, "common filler")])
    index, read = L.build(d, L.asked_terms(q), ((10, 0), (100, 0))), {}
    keep = L.written

    def spy(df, tag, *a, **o):
        out = keep(df, tag, *a, **o)
        if tag == "asked" and "open" in df.columns:
            read.update({(r["item"], bytes(r["term"])): r["read"] for r in out.collect()})
        return out

    monkeypatch.setattr(L, "written", spy)
    found = L.search(index, q)
    assert sorted(map(tuple, found.collect()), key=repr) == model(docs, [(1, "common rare"), (2, "common filler")])
    ids = {r["item_id"]: r["item"] for r in L.asked_terms(q).select("item", "item_id").distinct().collect()}
    assert read[ids[1], b"common"] < 2 and read[ids[1], b"rare"] > 0
    assert L.build(d, None, ((10, 0), (100, 0))).terms.count() >= index.terms.count()


def test_a_whole_index_gives_the_same(spark):
    docs, items = made(11)
    d, q = tables(spark, docs, items)
    assert sorted(map(tuple, L.search(L.build(d, None, ((20, 0), (80, 0))), q).collect()), key=repr) == model(docs, items)


def test_many_items_meet_in_joins(spark, monkeypatch):
    docs, items = made(5, n=120)
    d, q = tables(spark, docs, items)
    monkeypatch.setattr(L, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, L.ranked(d, q).collect()), key=repr) == model(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Äpfel äpfel ÄPFEL"), (4, "Äpfel"), (None, "äpfel x"), (5, "x" * 100_000 + " y"), (6, "KK k1"), (6, "KK k1")]
    items = [(1, "äpfel"), (2, None), (3, ""), (None, "x"), (1, "äpfel"), (4, "KK"), (5, "unknown"), (1, "y")]
    d, q = tables(spark, docs, items)
    d = d.selectExpr("*", "1 AS term", "'z' AS row", "2 AS item")
    assert sorted(map(tuple, L.ranked(d, q.selectExpr("*", "3 AS term")).collect()), key=repr) == model(docs, items)
    assert L.ranked(*tables(spark, [], items)).collect() == [] and L.ranked(*tables(spark, docs, [])).collect() == []
