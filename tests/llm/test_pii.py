import datetime
import re

from pyspark.sql import functions as F

from tempograin.llm import pii


def luhn(s):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def run(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, list(r.pii_kinds)) for r in pii.pseudonymise(df, **{"key": "k", **how}).orderBy("doc_id").collect()]


def test_formats_are_kept_and_values_linked(spark):
    text = ("mail anna.22@mail2.example.com, card 4785380592391130 or 4111 1111 1111 1111; call +1 (017) 555-7713 "
            "from 152.143.123.131. Born 1999-02-28 or 31/12/1999, GB82WEST12345698765432 token = \"24be64439e3e49cf46b2d7c90f3602a3\"")
    text = text.replace("4785380592391130", "4539578763621486")
    (out, kinds), (again, _) = run(spark, [text, "again anna.22@mail2.example.com 4539578763621486 1999-02-28"])
    assert kinds == ["email", "card", "card", "phone", "ip", "date", "date", "iban", "secret"]
    assert len(out.split()) == len(text.split())
    for a, b in zip(re.findall(r"\w", text), re.findall(r"\w", out)):
        assert a.isdigit() == b.isdigit() or "24be" in text[text.index("24be"):]
    card, card2 = re.search(r"card (\d{16}) or ((?:\d{4} ?){4})", out).groups()
    assert luhn(card) and luhn(card2.replace(" ", "")) and "4539578763621486" not in out
    assert all(int(x) < 256 for x in re.search(r"from ([\d.]+)\.", out)[1].split("."))
    date = re.search(r"Born (\S+)", out)[1]
    datetime.date.fromisoformat(date)
    mail = re.search(r"mail (\S+),", out)[1]
    assert mail.endswith("@mail2.example.com") and re.fullmatch(r"[a-z]{4}\.\d\d", mail.split("@")[0])
    assert again.split()[1:] == [mail, card, date]
    iban = re.search(r"GB\d{2}[A-Z]{4}\d{14}", out)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r'token = "[0-9a-f]{32}"', out)
    assert run(spark, [text], key="other")[0][0] != out


def test_what_is_not_valid_stays(spark):
    texts = ["4785380592391138 is no card", "300.1.2.3 and 1.2.3.4.5", "2023-02-30 and 2023-13-01", "GB83WEST12345698765432",
             "12345 words 2.5 1,234", "a@b", "+1 22", None, "", "deadbeefdeadbeefdeadbeefdead"]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_permutation_is_undone_and_one_to_one(spark):
    values = [f"{i:05d}" for i in range(2000)] + ["", "7", "aZ9-é", "x" * 90, "0" * 40]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    there = pii.feistel(F.col("v"), "k", "t")
    rows = df.select("v", there.alias("w")).select("*", pii.feistel(F.col("w"), "k", "t", inverse=True).alias("back")).collect()
    assert all(r.back == r.v and len(r.w) == len(r.v) for r in rows)
    assert len({r.w for r in rows}) == len(rows)
    assert sum(r.w != r.v for r in rows) > 1990
    pairs = spark.range(189 * 773).select("id", pii.feistel_pair(F.floor(F.col("id") / 773), F.col("id") % 773, 189, 773, "k", "d").alias("p"))
    assert pairs.select(F.count_distinct("p.a", "p.b"), F.max("p.a"), F.max("p.b")).first() == (189 * 773, 188, 772)
    back = pairs.select("id", pii.feistel_pair(F.col("p.a"), F.col("p.b"), 189, 773, "k", "d", inverse=True).alias("q"))
    assert back.filter("q.a * 773 + q.b != id").count() == 0


def test_all_dates_and_addresses_are_one_to_one(spark):
    days = spark.range(0, 146097, 13).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = pii.pseudonymise(days.withColumn("doc_id", F.lit(1)), "k")
    assert out.select("text").distinct().count() == days.count() and out.filter("size(pii_kinds) = 1").count() == days.count()
    ips = spark.range(3000).select(F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(F.col("id") / 250), F.col("id") % 250).alias("text"), "id")
    assert pii.pseudonymise(ips, "k").select("text").distinct().count() == 3000


def test_odd_empty_and_clashing(spark, odd, nothing):
    clashing = {"PII_Kinds": F.lit(1), "_found": F.lit(2), "found": F.lit("found"), "doc": F.col("text"), "a.b": F.lit(3.5)}
    mail = spark.createDataFrame([(100, "ask ann@example.org")], "doc_id long, text string")
    rows = odd.unionByName(mail, allowMissingColumns=True).withColumns(clashing)
    out = pii.pseudonymise(rows, "k")
    assert out.columns == [*odd.columns, *[c for c in clashing if c != "PII_Kinds"], "pii_kinds"]
    want = rows.drop("PII_Kinds", "text").withColumn("kinds", F.when(F.col("doc_id") == 100, F.lit("email")))
    got = out.withColumn("kinds", F.get("pii_kinds", F.lit(0))).drop("pii_kinds")
    assert sorted(map(repr, got.drop("text").collect())) == sorted(map(repr, want.collect()))
    assert sorted(repr((r.doc_id, r.text)) for r in got.filter("kinds is null").collect()) == sorted(repr((r.doc_id, r.text)) for r in odd.collect())
    out.write.format("noop").mode("overwrite").save()
    assert pii.pseudonymise(nothing, "k").count() == 0


def test_every_planted_value_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = re.compile(r"[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)|(?<!\d)\d{16}(?!\d)")
    out = {r.doc_id: r.text for r in pii.pseudonymise(docs, "k").collect()}
    seen = 0
    for r in docs.collect():
        values = {v for v in planted.findall(r.text) if not (v.isdigit() and not luhn(v))}
        seen += len(values)
        assert not any(v in out[r.doc_id] for v in values)
        if not re.search(r"\d", r.text):
            assert out[r.doc_id] == r.text
    assert seen > 50
