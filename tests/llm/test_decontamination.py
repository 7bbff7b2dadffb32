import hashlib
import re

import duckdb

from tempograin.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    grams = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - 9, 1) if w else 0):
            grams.setdefault(tuple(w[i:i + 10]), set()).add("" if item is None else str(item))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i:i + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    df, bench = docs, items
    if isinstance(docs, list):
        df = spark.createDataFrame(docs, "doc_id long, text string")
    if isinstance(items, list):
        bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in dc.contamination(df, bench).collect()], key=repr)


def test_small_table(spark, small_documents):
    docs = [(d, t) for d, t, _ in small_documents]
    items = duckdb.execute("SELECT item_id, text FROM '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert any(r[2] for r in want)


def test_short_repeated_and_overlapping_items(spark):
    long = " ".join(f"w{i % 7}" for i in range(40))
    items = [(1, "the"), (2, "THE"), (3, "of the"), (4, long), (4, long), (None, "of the"), (5, None), (6, "..."), (7, "é x")]
    docs = [(1, "The. of the,the OF"), (1, "The. of the,the OF"), (2, long + " " + long), (3, None), (None, "É x é X"), (4, "w0 w1 w2")]
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_and_empty(spark, odd, nothing):
    items = [(1, "word word word"), (2, "same text")]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(spark, odd, items) == brute(rows, items)
    assert run(spark, nothing, items) == []
    assert run(spark, odd, [(1, "a")][:0]) == brute(rows, [])
    left = dc.drop_contaminated(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == odd.columns
    clean = [r for r in brute(rows, items) if not r[5]]
    assert sorted([r.doc_id for r in left.collect()], key=repr) == [r[0] for r in clean]


def test_proximity(spark):
    item = "alpha beta gamma delta"
    docs = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "beta alpha gamma delta"),
            (4, "alpha y y y y y y beta gamma y y y delta"), (5, "alpha beta gamma")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    near, _ = dc.phrase_matches(df, bench, slop=2)
    assert {r.doc_id for r in near.filter("size(hits) > 0").collect()} == {1, 2, 3}
    exact, _ = dc.phrase_matches(df, bench)
    assert {r.doc_id for r in exact.filter("size(hits) > 0").collect()} == {1}
