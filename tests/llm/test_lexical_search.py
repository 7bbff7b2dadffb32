"""Ranked search against scoring every document, and the bounds against what they bound."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tempograin.llm import lexical_search as ls

FOLD = str.maketrans(ls.UPPER, ls.LOWER)


def terms(text):
    return re.findall(ls.TERM, (text or "").translate(FOLD))


def brute_force(docs, items, best):
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    big_n = sum(1 for _, c in counts if c)
    big_l = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc_id, c in counts:
            score = 0
            if c:
                m = 100 - 50 + (50 * sum(c.values()) * big_n) // big_l
                for t in own & c.keys():
                    score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    docs += [(n + i, docs[3 * i][1]) for i in range(n // 10)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 8, 30])))) for i in range(25)]
    return docs, items


def run(spark, docs, items, best):
    got = ls.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), best)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("best", [1, 10])
def test_equals_scoring_all_documents(spark, best, monkeypatch):
    monkeypatch.setattr(ls, "ENTRIES", 700)  # many parts, so that scores needed rise on the way
    docs, items = corpus(400, best)
    assert run(spark, docs, items, best) == brute_force(docs, items, best)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ls, "TERMS_PER_BLOCK", 80)
    docs, items = corpus(120, 5)
    assert run(spark, docs, items, 7) == brute_force(docs, items, 7)


def test_nulls_ties_repeats(spark):
    docs = [(None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (1, "Alpha BETA"), (2, None), (4, ""), (5, "gamma"), (6, "Éa alpha-beta_é")]
    items = [(1, "alpha"), (1, "beta ALPHA"), (None, "gamma"), (2, None), (3, "nowhere"), (4, " - ")]
    for best in (1, 3, 50):
        assert run(spark, docs, items, best) == brute_force(docs, items, best)


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, "same text", 0), (2, "x word", 1)], "item_id long, text string, score int")
    want = brute_force([(r.doc_id, r.text) for r in odd.collect()], [(1, "same text"), (2, "x word")], 50)
    assert sorted(map(tuple, ls.search(odd, items).collect()), key=str) == want
    assert ls.search(nothing, items).collect() == []
    assert ls.search(odd, items.limit(0)).collect() == []


def test_long_texts_in_slices(monkeypatch):
    text = "One two-three  Two é " * 50 + "end"
    whole = ls.term_counts(text, {b"two": 0, b"end": 1})
    monkeypatch.setattr(ls, "SLICE_BYTES", 7)
    assert ls.term_counts(text, {b"two": 0, b"end": 1}) == whole == (len(terms(text)), Counter({None: 150, 0: 100, 1: 1}))


def test_pair_bounds_are_tighter_and_hold():
    weights = ls.Weights(10, 100, np.array([10, 20, 30]))
    lists = {0: (50, None), 1: (60, None), 2: (70, None), 3: (80, None), 4: (90, None)}
    plan, = ls.plans([[0, 1, 2]], weights, lists, {(0, 1): 0, (1, 2): 1})
    # The pairs (0, 1) and (1, 2) reach 80 and 90 together; apart the terms would give 110 and 180.
    assert plan.bounds == [0, 50, 80, 140]
    assert [plan.heavy(n) for n in (1, 51, 81, 141)] == [0, 1, 2, 3]
