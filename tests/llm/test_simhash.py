import random

import xxhash

from tempograin.llm import simhash as sh


def brute_print(t):
    w = [x for x in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ")
         .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints, ids):
    """Component ids by comparing all pairs of distinct prints."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for p, d in zip(prints, ids):
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return [least.get(find(p)) for p in prints]


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    prints = [brute_print(t) for _, t in rows]
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, brute(prints, [d for d, _ in rows]))]
    got = [tuple(r) for r in sh.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_small_tables(spark, small_documents):
    check(spark.createDataFrame([(d, t) for d, t, _ in small_documents], "doc_id long, text string"))
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_odd_and_empty(spark, odd, nothing):
    check(odd)
    assert sh.near_duplicates(nothing).count() == 0
    kept = sh.keep_one(odd)
    assert kept.columns == odd.columns
    # Without words, x, word, same text, a and the last: the row that repeats the id 3 belongs to another component.
    assert kept.count() == 6
    assert sh.keep_one(nothing).count() == 0


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_every_link_is_found(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(12):  # chains of up to five bits, from random members
            q = rng.choice([p, *rng.sample(sorted(prints), 1)])
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    prints |= {0, (1 << 64) - 1, 1, 3, 7, 15, 31, 1 << 63}
    ordered = sorted(prints)
    df = spark.createDataFrame([(signed(p), signed(p)) for p in ordered], "print long, root long")
    got = {frozenset((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)) for r in sh.links(df).collect()}
    rows = sh.links(df).count()
    want = {frozenset((a, b)) for i, a in enumerate(ordered) for b in ordered[:i] if (a ^ b).bit_count() <= 4}
    assert got == want and rows == len(want)
    found = {r.print & (1 << 64) - 1: r["class"] for r in sh.classes(df.select("print")).collect()}
    ids = brute(ordered, list(range(len(ordered))))
    by_class, by_id = {}, {}
    for p, i in zip(ordered, ids):
        assert by_class.setdefault(found[p], i) == i and by_id.setdefault(i, found[p]) == found[p]


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(9)
    rows = [(signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F
    total = sum(sh._manhattan(sh._zone(sh.segment_counts(F.col("a")), z), sh._zone(sh.segment_counts(F.col("b")), z)) for z in range(3))
    for r in df.select("a", "b", total.alias("d")).collect():
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        want = sum(abs((a >> 2 * j & 3).bit_count() - (b >> 2 * j & 3).bit_count()) for j in range(32))
        assert r.d == want <= (a ^ b).bit_count()
