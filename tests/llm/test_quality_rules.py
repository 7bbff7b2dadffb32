import math
import re
from collections import Counter, defaultdict

import pytest

from tempograin.llm import quality_rules as qr


def counts(t):
    t = t or ""
    w = [x for x in re.split(r"[ \t-\r]+", t) if x]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [s for s in t.split("\n") if re.search(r"[^ \t-\r]", s)]
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed)


def base(rows):
    return sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows], key=repr)


def divergence(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_counts_and_word_distance(spark, small_documents):
    df = spark.createDataFrame(small_documents, "doc_id long, text string, lang string")
    rows = qr.judge(df).collect()
    assert base(rows) == sorted([(d, *counts(t)) for d, t, _ in small_documents], key=repr)
    hist, pooled = {}, defaultdict(Counter)
    for d, t, lang in small_documents:
        w = [x.lower() for x in re.split(r"[ \t-\r]+", t) if x]
        hist[d] = Counter(x if x in qr.COMMON_WORDS[lang] else "" for x in w)
        if not counts(t)[-1]:
            pooled[lang].update(hist[d])
    langs = {d: lang for d, _, lang in small_documents}
    for r in rows:
        assert (r.word_distance is None) == (r.n_words < qr.MIN_WORDS)
        if r.word_distance is not None:
            keys = [*qr.COMMON_WORDS[langs[r.doc_id]], ""]
            p, q = hist[r.doc_id], pooled[langs[r.doc_id]]
            want = divergence([p[k] / p.total() for k in keys], [q[k] / q.total() for k in keys])
            assert r.word_distance == pytest.approx(want, abs=1e-9)
        if r.base_failed:
            assert not r.kept


def test_clean_documents_are_kept_and_junk_is_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = qr.judge(docs).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert rows[rows.quality == 1].kept.all()
    assert rows[rows.quality == 0].kept.mean() < 0.6


def test_odd_and_empty(spark, odd, nothing):
    rows = qr.judge(odd).collect()
    assert base(rows) == sorted([(r.doc_id, *counts(r.text)) for r in odd.collect()], key=repr)
    assert qr.judge(nothing).count() == 0


def test_repeats_overlap_and_end(spark):
    texts = ["a " * 9, "a b c d e f g h " * 2 + "z", "x " + "a b c d e f g h " + "y " * 3 + "a b c d e f g h", "a b c d e f g", " ".join(map(str, range(500))) + " 1 2 3 4 5 6 7 8 9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "cast(null as string) lang")
    assert base(qr.judge(df).collect()) == [(i, *counts(t)) for i, t in enumerate(texts)]
