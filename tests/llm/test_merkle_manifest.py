"""The manifest against a tree built node by node, and what proofs are for."""

import hashlib
import random
import zlib

import pytest

from tempograin.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """(root, for each node its list of (left, right))."""
    paths = [[] for _ in nodes]
    places = list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, places):
            run = p // 8 * 8
            path.append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + 8])))
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        places = [p // 8 for p in places]
    return nodes[0], paths


def brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    made = {}
    for g, members in groups.items():
        leaves = sorted(((r[0] is not None, r[0] or 0, h(*map(enc, r))), r) for r in members)
        made[g] = leaves, *tree([k[2] for k, _ in leaves])
    names = sorted(groups, key=lambda g: g.encode())
    root, tops = tree([made[g][1] for g in names])
    out = []
    for g, top in zip(names, tops):
        leaves, subroot, paths = made[g]
        for ((*_, leaf), r), path in zip(leaves, paths):
            path = path + top
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                folded = h(*map(enc, (*r[:4], lower(r[4]))))
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r[0], leaf, subroot, root, h(*[a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    return sorted(map(tuple, mm.manifest(df).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [1, 1], [65, 1, 8, 64, 2, 3, 5, 1, 1, 7]])
def test_equals_a_tree_built_node_by_node(spark, sizes):
    rng = random.Random(str(sizes))
    rows = []
    for i, n in enumerate(sizes):
        lang = None if i == 1 else "abcdefghzé"[i] * (i + 1)
        rows += [(rng.randrange(10 ** 6), "s", lang, n, rng.choice(["Text", "plain", "", None, "ÄÖ A"]) ) for _ in range(n)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute_force(rows)


def test_nulls_repeats_and_ties(spark):
    rows = [(None, None, None, None, None)] * 2 + [(5, "s", "en", 1, "A")] * 9 + [(5, "s", "en", 1, "B"), (7, None, "en", None, None), (None, "x", "en", 2, "")]
    got = run(spark, rows)
    assert got == brute_force(rows) and len(got) == len(rows)


def test_other_columns_and_an_empty_table(odd, nothing):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert sorted(map(tuple, mm.manifest(odd).collect()), key=str) == brute_force(rows)
    assert mm.manifest(nothing).collect() == []


def test_dealing_does_not_matter(spark, small_documents):
    rows = [(i, "s", lang, len(t or ""), t) for i, t, lang in small_documents]
    df = spark.createDataFrame(rows, SCHEMA)
    once = {tuple(r) for r in mm.manifest(df.repartition(7)).collect()}
    assert once == {tuple(r) for r in mm.manifest(df.repartition(2, "text")).collect()} == set(brute_force(rows))


def test_only_changed_texts_fail(spark):
    rows = [(i, "s", "en", 1, "Big" if i % 2 else "small") for i in range(100)]
    for doc_id, *_, verified in run(spark, rows):
        assert verified == (not (doc_id % 2 and zlib.crc32(str(doc_id).encode()) % 3 == 0))


def test_lengths_keep_fields_apart(spark):
    rows = [(1, "ab", "c", 1, "x"), (1, "a", "bc", 1, "x"), (1, None, "c", 1, "x"), (1, "-", "c", 1, "x")]
    assert len({r[1] for r in run(spark, rows)}) == 4
