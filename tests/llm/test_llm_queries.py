"""The registered queries of the operators, against SQL where there is some."""

import check
import pytest

from tempograin import llm

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.all_oracles()))
def test_query_matches_sql(spark, name):
    names, got = check.spark_rows(llm.all_queries()[name](spark, FOLDER))
    want_names, want, _ = check.duck_rows(check.connect(FOLDER), llm.all_oracles()[name])
    assert names == want_names and got == want


@pytest.mark.parametrize("name", sorted(set(llm.all_queries()) - set(llm.all_oracles())))
def test_query_has_a_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith("op8_") else "documents"
    assert llm.all_queries()[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.all_queries()) == list(range(1, 14))
