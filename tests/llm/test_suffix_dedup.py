import hashlib
import random

from tempograin.llm import suffix_dedup as sd


def brute(docs):
    """What is left of each row by definition; ids of None come last."""
    last = 1 << 63
    first = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            g = t[i:i + 50]
            first[g] = min(first.get(g, last), last - 1 if d is None else d)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i:i + 50]] < (last - 1 if d is None else d):
                gone[i:i + 50] = b"\1" * 50
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(c for c, x in zip(t, gone) if not x)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted([tuple(r) for r in sd.remove_repeats(df, **how).collect()], key=repr)


def test_small_table(spark, small_documents):
    docs = [(d, t) for d, t, _ in small_documents]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute([(d, t.encode()) for d, t in docs])
    assert got(df) == want
    assert got(df, run_bytes=20_000) == want
    assert sum(r[2] for r in want) > 0


def test_random_pieces(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab" if k % 2 else "abcdefgh é") for _ in range(rng.randint(40, 300))) for k in range(6)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            parts.append(b[i:i + rng.randint(10, 200)] if rng.random() < .6 else "".join(rng.choice("xyz") for _ in range(60)))
        docs.append((rng.choice([d, d, None, 7]), "".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(df, run_bytes=700) == brute([(d, t.encode()) for d, t in docs])


def test_odd_and_empty(spark, odd, nothing):
    assert got(odd) == brute([(r.doc_id, (r.text or "").encode()) for r in odd.collect()])
    assert got(nothing) == []


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "p" * 49 + "q" * 60), (2, "zz" + "q" * 55 + "yy")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(df, texts=True).collect()}
    assert kept == {1: b"p" * 49 + b"q" * 60, 2: b"zzyy"}


def test_loser_tree_merges_with_shared_lengths():
    rng = random.Random(2)
    def rec():
        return bytes(rng.choice(b"ab") for _ in range(6)).ljust(sd.RECORD, b"\0")
    runs = []
    for _ in range(5):
        rows, before, coded = sorted(rec() for _ in range(rng.randint(0, 30))), b"", []
        for r in rows:
            shared = next((i for i, (x, y) in enumerate(zip(before, r)) if x != y), sd.RECORD) if before else 0
            coded.append((shared, r, 1))
            before = r
        runs.append(coded)
    merged = list(sd.merge([iter(r) for r in runs]))
    assert [m[1] for m in merged] == sorted(x[1] for r in runs for x in r)
    for a, b in zip(merged, merged[1:]):
        assert b[0] == next((i for i, (x, y) in enumerate(zip(a[1], b[1])) if x != y), sd.RECORD)
