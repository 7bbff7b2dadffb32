import zlib
from collections import Counter, defaultdict

import pytest

from tempograin.llm.sharding import shard_documents


def check_laws(rows, texts, shards):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)


def cut_edges(rows):
    """Neighbours in other shards, by text, against what a random assignment would cut."""
    groups = defaultdict(Counter)
    for r in rows:
        groups[(r.size, r.text_crc32)][r.shard] += 1
    pairs = sum(sum(c.values()) * (sum(c.values()) - 1) // 2 for c in groups.values())
    kept = sum(n * (n - 1) // 2 for c in groups.values() for n in c.values())
    return (pairs - kept) / max(pairs, 1)


def test_small_table(spark, small_documents):
    df = spark.createDataFrame([(d, t) for d, t, _ in small_documents], "doc_id long, text string")
    rows = shard_documents(df, shards=7).collect()
    check_laws(rows, [(d, t) for d, t, _ in small_documents], 7)
    assert cut_edges(rows) < 0.2


@pytest.mark.parametrize("block", [7, 50_000])
def test_hot_group_is_spread_and_others_stay_together(spark, block):
    texts = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"single {i}") for i in range(1200)]
    rows = shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), shards=10, block=block).collect()
    check_laws(rows, texts, 10)
    text = dict(texts)
    homes = {r.shard for r in rows if text[r.doc_id] == "hot"}
    assert 4 <= len(homes) <= 6
    pairs = defaultdict(set)
    for r in rows:
        if text[r.doc_id].startswith("pair"):
            pairs[text[r.doc_id]].add(r.shard)
    assert sum(len(s) == 1 for s in pairs.values()) > 0.9 * len(pairs)


def test_odd_and_empty(spark, odd, nothing):
    rows = shard_documents(odd, shards=3).collect()
    check_laws(rows, [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert shard_documents(nothing).count() == 0
