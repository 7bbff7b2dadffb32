"""Source and sink queries: files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograin.functions.numeric import r6
from tempograin.plans.registry import query
from tempograin.sources import documents as docs
from tempograin.sources import sinks
from tempograin.sources.tables import Tables
from tempograin.session import scratch_path

# A session document per supplier; every ninth is cut short, every fifth has an empty block.
WHOLE = """CONCAT('{"hz_w": 120, "hz_r": ', CAST(100 + s_suppkey % 3 * 20 AS STRING), ', "joints": {"pelvis": [1, 2, 3]}, "dv_r": ',
  CASE WHEN s_suppkey % 5 = 0 THEN '[]' ELSE CONCAT('{"left": {"SPEED": ', CAST(s_nationkey AS STRING), ', "DONE": true, "NAME": "12"}, "right": {"SPEED": [', CAST(s_nationkey + 1 AS STRING), '], "PAIR": [1, 2], "CAD": 2.5}}') END,
  '}')"""
DOCUMENT = f"CASE WHEN s_suppkey % 9 = 0 THEN substr({WHOLE}, 1, length({WHOLE}) - 1) ELSE {WHOLE} END"
DOCS = f"docs AS (SELECT s_suppkey, {DOCUMENT} AS doc, {WHOLE} AS whole FROM supplier)"


def document_folder(t: Tables) -> str:
    rows = t.supplier.select("s_suppkey", F.expr(DOCUMENT).alias("doc"))
    return docs.write_one_per_file(rows, "doc", "sessions", "s_suppkey")


def key(path) -> object:
    return docs.path_key(path, "s_suppkey").cast("long").alias("s_suppkey")


@query("s01_string_csv", """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 'NaN' ELSE lang END AS level, md5(replace(text, chr(13), '')) AS text_digest FROM documents""")
def _(t):
    level = F.when(F.col("doc_id") % 6 == 0, F.lit(None)).when(F.col("doc_id") % 6 == 1, "NaN").otherwise(F.col("lang"))
    rows = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), level.alias("level"), F.regexp_replace("text", "\r", "").alias("text"))
    back = docs.string_csv(t.spark, docs.write_string_csv(rows, "meta"), ["doc_id", "level", "text"])
    return back.select("doc_id", "level", F.md5("text").alias("text_digest"))


@query("s02_session_documents", f"""WITH {DOCS}
SELECT s_suppkey, (100 + s_suppkey % 3 * 20)::DOUBLE AS hz_r, CASE WHEN s_suppkey % 5 = 0 THEN 'ARRAY' ELSE 'OBJECT' END AS dv_type FROM docs WHERE s_suppkey % 9 <> 0""")
def _(t):
    back = docs.whole_texts(t.spark, document_folder(t)).select("path", F.try_parse_json("value").alias("doc"))
    kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get("doc", "$.dv_r", "variant")), "^([A-Z]+)", 1)
    return back.filter(F.col("doc").isNotNull()).select(key(F.col("path")), F.try_variant_get("doc", "$.hz_r", "double").alias("hz_r"), kind.alias("dv_type"))


@query("s02_variant_scan", f"WITH {DOCS} SELECT s_suppkey, (100 + s_suppkey % 3 * 20)::DOUBLE AS hz_r, strlen(whole) + 1 AS bytes FROM docs")
def _(t):
    whole = t.supplier.select("s_suppkey", F.expr(WHOLE).alias("doc"))
    path = docs.write_one_per_file(whole, "doc", "whole", "s_suppkey")
    back = docs.variant_documents(t.spark, path)
    return back.select(key(F.col("path")), F.try_variant_get("doc", "$.hz_r", "double").alias("hz_r"), "bytes")


@query("s03_header_rate", f"WITH {DOCS} SELECT (100 + s_suppkey % 3 * 20)::DOUBLE AS hz_r, count(*) AS n FROM docs GROUP BY 1")
def _(t):
    return docs.header_rates(t.spark, document_folder(t), "hz_r").groupBy("hz_r").agg(F.count(F.lit(1)).alias("n"))


@query("s03_header_survey", f"""WITH {DOCS}, l AS (SELECT '120' AS hz_w, CAST(100 + s_suppkey % 3 * 20 AS VARCHAR) AS hz_r, s_suppkey % 5 = 0 AS matched FROM docs)
SELECT CASE WHEN matched THEN hz_w END AS hz_w, CASE WHEN matched THEN hz_r END AS hz_r, CASE WHEN matched THEN '[]' END AS dv_r, matched, count(*) AS n FROM l GROUP BY 1, 2, 3, 4""")
def _(t):
    """Both rates and the block by combination: an empty block is a level, a full one is not matched."""
    return docs.header_survey(t.spark, document_folder(t), ["hz_w", "hz_r", "dv_r"])


@query("s04_file_metadata", f"WITH {DOCS} SELECT s_suppkey, round((strlen(doc) + 1) / 1e6, 6) AS size_mb FROM docs")
def _(t):
    rows = t.spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(document_folder(t))
    meta = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return meta.select(key(F.col("path")), F.round(F.col("bytes") / 1e6, 6).alias("size_mb"))


@query("s05_glob_listing", "SELECT 'trial' || (s_suppkey % 10) AS trial, 'cam' || (s_suppkey % 3) AS camera, count(*) AS n FROM supplier GROUP BY 1, 2")
def _(t):
    """File stems of the form <trial>_<camera>, parsed from listed paths."""
    stem = F.concat(F.lit("trial"), (F.col("s_suppkey") % 10).cast("string"), F.lit("_cam"), (F.col("s_suppkey") % 3).cast("string"))
    rows = t.supplier.select(F.concat(stem, F.lit("."), F.col("s_suppkey").cast("string")).alias("stem"), "s_name")
    path = docs.write_one_per_file(rows, "s_name", "clips", "stem")
    found = docs.list_files(t.spark, path, "*.txt")
    return (found.select(F.regexp_extract("path", r"stem=([^_]+)_", 1).alias("trial"), F.regexp_extract("path", r"_(cam\d+)\.", 1).alias("camera"))
            .groupBy("trial", "camera").agg(F.count(F.lit(1)).alias("n")))


@query("s06_marker_tsv", """SELECT user_id, count(*) AS n, round((count(*) - 1) / (max(date_part('epoch', ts)) - min(date_part('epoch', ts))), 9) AS hz FROM events GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    """The true rate from the span of the time column, not the nominal one."""
    path = scratch_path(t.spark, "markers")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    t.events.select("user_id", seconds.alias("seconds"), "value").write.option("sep", "\t").option("header", True).csv(path)
    back = t.spark.read.schema("user_id bigint, seconds double, value double").option("sep", "\t").option("header", True).csv(path)
    span = F.max("seconds") - F.min("seconds")
    return back.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round((F.count(F.lit(1)) - 1) / F.nullif(span, F.lit(0.0)), 9).alias("hz")).filter("n > 1")


@query("s08_tensor_table", "SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE, 6) + 0.0) AS curve FROM embeddings")
def _(t):
    """Waveforms with their key in the row: no positional index to keep in step."""
    back = sinks.rewritten_parquet(t.embeddings.select("vec_id", F.col("embedding").alias("curve")), "waveforms")
    return back.select("vec_id", F.transform("curve", lambda v: F.round(v.cast("double"), 6) + 0.0).alias("curve"))


@query("s09_json_results", "SELECT l_suppkey AS subject, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    out = t.lineitem.groupBy(F.col("l_suppkey").alias("subject")).agg(r6(F.avg("l_discount")).alias("mean"), F.count(F.lit(1)).alias("n"))
    return t.spark.read.schema("subject bigint, mean double, n bigint").json(sinks.json_lines(out, "results"))


@query("s10_markdown_table", """WITH g AS (SELECT s_nationkey AS nation, count(*) AS suppliers, CAST(min(s_suppkey) AS VARCHAR) AS first_key FROM supplier GROUP BY 1)
SELECT 0::BIGINT AS line_no, '| nation | suppliers | first_key |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL
SELECT 1 + row_number() OVER (ORDER BY nation), '| ' || nation || ' | ' || suppliers || ' | ' || first_key || ' |' FROM g""")
def _(t):
    g = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"), F.min("s_suppkey").alias("first_key"))
    return sinks.markdown_table(g, ["nation", "suppliers", "first_key"], ["nation"])


@query("s11_hash_manifest", f"WITH {DOCS} SELECT s_suppkey, strlen(doc) + 1 AS bytes, sha256(doc || chr(10)) AS sha256 FROM docs")
def _(t):
    return docs.manifest(t.spark, document_folder(t)).select(key(F.col("path")), "bytes", "sha256")


STATUS = "CASE WHEN s_suppkey % 9 = 0 THEN 'not valid JSON' WHEN s_suppkey % 5 = 0 THEN 'block is empty' ELSE '' END"


@query("s12_batch_manifest", f"SELECT s_suppkey, {STATUS} AS err, {STATUS} = '' AS ok FROM supplier")
def _(t):
    texts = docs.whole_texts(t.spark, document_folder(t))
    return docs.batch_status(texts, "$.dv_r").select(key(F.col("path")), "err", "ok")


@query("s13_document_structure", """WITH d AS (SELECT s_suppkey % 5 = 0 AS empty FROM supplier WHERE s_suppkey % 9 <> 0), n AS (SELECT count(*) AS a, count(*) FILTER (WHERE NOT empty) AS f, count(*) FILTER (WHERE empty) AS e FROM d)
SELECT '$' AS path, 'OBJECT' AS type, a AS n FROM n UNION ALL SELECT '$.hz_w', 'BIGINT', a FROM n UNION ALL SELECT '$.hz_r', 'BIGINT', a FROM n UNION ALL SELECT '$.joints', 'OBJECT', a FROM n
UNION ALL SELECT '$.joints.pelvis', 'ARRAY', a FROM n UNION ALL SELECT '$.dv_r', 'OBJECT', f FROM n UNION ALL SELECT '$.dv_r', 'ARRAY', e FROM n WHERE e > 0 UNION ALL SELECT '$.dv_r.left', 'OBJECT', f FROM n UNION ALL SELECT '$.dv_r.right', 'OBJECT', f FROM n""")
def _(t):
    parsed = t.supplier.select(F.try_parse_json(F.expr(DOCUMENT)).alias("doc")).filter(F.col("doc").isNotNull())
    return docs.structure(parsed, "doc", 2)


@query("s14_reconciliation", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'failed' ELSE 'read' END AS state FROM supplier WHERE s_suppkey % 11 <> 0
  UNION ALL SELECT 'unexpected' FROM supplier WHERE s_suppkey % 11 = 0 UNION ALL SELECT 'missing' FROM supplier WHERE s_suppkey % 10 = 0) GROUP BY 1""")
def _(t):
    texts = docs.batch_status(docs.whole_texts(t.spark, document_folder(t)), "$.hz_r").select(
        key(F.col("path")), F.try_parse_json("value").isNotNull().alias("parsed"))
    known = t.supplier.filter("s_suppkey % 11 <> 0").select("s_suppkey")
    absent = t.supplier.filter("s_suppkey % 10 = 0").select((-1 - F.col("s_suppkey")).alias("s_suppkey"))
    return docs.reconcile(known.unionByName(absent), texts.filter("parsed"), texts.filter("not parsed"), "s_suppkey")


EVENT_DOC = """CONCAT('{"dv_r": {"left": {"K": ', CAST(k AS STRING), ', "F": true}, "right": {"K": [', CAST(k + 1 AS STRING), '], "G": [1, 2], "N": "7"}}}')"""


@query("t01_flatten_sides", """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 'left_K' AS key, k::DOUBLE AS value, false AS dropped FROM e UNION ALL SELECT event_id, 'right_K', k + 1, false FROM e
UNION ALL SELECT event_id, 'left_F', NULL, true FROM e UNION ALL SELECT event_id, 'right_G', NULL, true FROM e UNION ALL SELECT event_id, 'right_N', NULL, true FROM e""")
def _(t):
    rows = t.events.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
    parsed = rows.select("event_id", F.parse_json(F.expr(EVENT_DOC)).alias("doc"))
    return docs.flatten_blocks(parsed, ["event_id"], "doc", {"left": "$.dv_r.left", "right": "$.dv_r.right"})
