import zlib

import sentencepiece
from test_decontamination import brute as brute_hits
from test_near_copies import brute_kept

import corpus_pipeline
from tempograin.llm import pii, quality_classifier, sentencepieces

FOLDER = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    tables = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = tables["documents"]
    steps = dict(corpus_pipeline.STAGES)
    assert [name for name in steps] == [n for n, _ in corpus_pipeline.STAGES] and len(steps) == 5
    functions = list(steps.values())

    scores = {r.doc_id: r.predicted for r in quality_classifier.score_documents(docs, tables["labels"]).collect()}
    good = functions[0](spark, docs, FOLDER)
    rows = sorted((r for r in docs.collect() if scores[r.doc_id]), key=lambda r: r.doc_id)
    assert good.columns == docs.columns and sorted(good.collect(), key=lambda r: r.doc_id) == rows
    assert 0.5 * docs.count() < len(rows) < docs.count()

    first = brute_kept([(r.doc_id, r.text) for r in rows])
    left = [r for r in rows if r.doc_id in first]
    one = functions[1](spark, good, FOLDER)
    assert one.columns == docs.columns and sorted(one.collect(), key=lambda r: r.doc_id) == left
    assert len(left) < len(rows)

    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    bad = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in left], items) if r[5]}
    clean = functions[2](spark, one, FOLDER)
    assert bad and clean.columns == docs.columns
    assert sorted(clean.collect(), key=lambda r: r.doc_id) == [r for r in left if r.doc_id not in bad]

    safe = functions[3](spark, clean, FOLDER)
    assert safe.columns == docs.columns and safe.schema == docs.schema
    masked = {r.doc_id: r for r in safe.collect()}
    want = {r.doc_id: r.text for r in pii.pseudonymise(clean, pii.session_key(spark)).collect()}
    assert {d: r.text for d, r in masked.items()} == want and all(r.n_chars == len(r.text) for r in masked.values())

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL_PATH)
    last = {r.doc_id: r for r in functions[4](spark, safe, FOLDER).collect()}
    assert {d: list(r.ids) for d, r in last.items()} == {d: library.encode(t) for d, t in want.items()}
    assert all(r.round_trip for r in last.values())

    whole = {r.doc_id: zlib.crc32(repr(list(r.ids)).encode()) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == {d: zlib.crc32(repr(list(r.ids)).encode()) for d, r in last.items()}


def test_odd_documents_pass_through(spark, odd, nothing, tmp_path):
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
