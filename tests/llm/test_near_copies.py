import random

import numpy as np
import pytest

import corpus_pipeline
from tempograin.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Smallest doc_id of each component, by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((find(d), find(e)))
                root[high] = low
    return {find(d) for d in root}


def test_stage_drops_every_near_copy(spark):
    """Chains of copies at similarities around 0.8, most of them more than four bits apart."""
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 120, 400]))]
        texts.append(base)
        for _ in range(6):
            copy = list(rng.choice([base, texts[-1]]))
            for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 45))):
                copy[at] = f"x{rng.randrange(4000)}"
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None), (902, " \t"), (903, "one two"), (904, "One  two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage = corpus_pipeline.STAGES[1][1]
    got = sorted(r.doc_id for r in stage(spark, df, "").collect())
    want = sorted(brute_kept(rows))
    assert got == want and 25 < len(want) < 150


def test_one_large_group_of_copies_with_edits(spark, monkeypatch):
    """Copies of copies of one text around the similarity: joined by rounds, not by all pairs of a cell."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    texts = [base]
    for _ in range(400):
        copy = list(rng.choice([base, base, texts[-1]]))
        for at in rng.sample(range(90), rng.choice([1, 2, 2, 3])):
            copy[at] = f"x{rng.randrange(12)}"
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    made = {}
    write = near_copies.stored

    def counted(df, stem):
        out = write(df, stem)
        made[stem] = made.get(stem, 0) + out.count() if stem in ("near-round", "near-pairs") else 0
        return out
    monkeypatch.setattr(near_copies, "stored", counted)
    got = sorted(r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_kept(rows)) and 1 < len(got) < 300
    assert made["near-round"] + made["near-pairs"] < 401 * 400 / 2 / 5


def test_sketches_of_near_copies_agree():
    """At 0.8 the fields that differ stay below the limit by a wide margin."""
    rng = random.Random(2)
    for _ in range(60):
        words = [str(rng.random()) for _ in range(220)]
        other = words[:-24]
        a, b = near_copies.shingle_set(" ".join(words)), near_copies.shingle_set(" ".join(other))
        x = near_copies.sketch(a) ^ near_copies.sketch(b)
        assert sum(bin(int(v | v >> 1) & 0x5555555555555555).count("1") for v in x.tolist()) <= near_copies.DIFFERING


def test_odd_and_empty(spark, odd, nothing):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert near_copies.keep_one(nothing).count() == 0


def test_band_keys_do_not_depend_on_batches():
    s = near_copies.shingle_set(" ".join(str(i) for i in range(9000)))
    assert len(s) == 8996 and (near_copies.band_keys(s) == near_copies.band_keys(s.copy())).all()


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_no_words_no_shingles(text):
    assert len(near_copies.shingle_set(text)) == 0


def test_simhash_components_are_candidates(spark):
    """Two near copies without any band in common are found through op10's components."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:-2] + ["x"]), " ".join(words[::-1])]
    sets = [near_copies.shingle_set(t) for t in texts]
    prints = [near_copies.simhash.fingerprint(t) for t in texts]
    assert bin(prints[0] ^ prints[1]).count("1") <= 4
    rows = [(i, len(s), p - (p >> 63 << 64), []) for i, (s, p) in enumerate(zip(sets, prints))]
    nodes = spark.createDataFrame(rows, "node long, n long, print long, keys array<long>")
    kept = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {r[0]: r[1] for r in near_copies.classes(nodes, lambda asked: kept.join(asked, "node")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("same", [True, False])
def test_blocks_join_what_pairs_join(same):
    """A block against itself or another: the components of its pairs, without a row a pair."""
    rng = random.Random(5)
    texts = [[f"w{i}" for i in range(60)]]
    for _ in range(120):
        copy = list(rng.choice(texts))
        for at in rng.sample(range(60), rng.choice([1, 2, 4])):
            copy[at] = f"x{rng.randrange(9)}"
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    sets = [near_copies.shingle_set(t) for t in texts]
    n = len(sets)
    left, right = (np.arange(n), np.arange(n)) if same else (np.arange(60), np.arange(60, n))
    both = near_copies._shared([sets[i] for i in left], [sets[i] for i in right])
    assert all(both[x, y] == len(np.intersect1d(sets[i], sets[j])) for x, i in enumerate(left) for y, j in enumerate(right))
    sketch = np.array([near_copies.sketch(s) for s in sets])
    a, b = near_copies._joined(np.arange(n), sketch, sets, left, right)

    def groups(pairs):
        root = list(range(n))
        for _ in range(n):
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
        return root
    linked = [(i, j) for i in left for j in right if i != j and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert groups(list(zip(a.tolist(), b.tolist()))) == groups(linked) and 1 < len(set(groups(linked))) < n and len(a) < n
