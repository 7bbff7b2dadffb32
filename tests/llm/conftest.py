import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

import duckdb  # noqa: E402
import pytest  # noqa: E402

SMALL = "/root/testdata/sf0.001"
#: Texts that every operator must stand: null, empty, blank, very long, repeated and tied rows.
ODD_TEXTS = [None, "", " \t\n", "x", "word " * 30_000, "same text twice", "same text twice", "a" * 3000, "\x00\x01 é漢🙂 ﷺ\n\n|#"]


@pytest.fixture(scope="session")
def small_documents():
    return duckdb.execute(f"SELECT doc_id, text, lang FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all odd kinds, with a null id, a repeated row and columns whose names operators use."""
    texts = [*ODD_TEXTS, *ODD_TEXTS[3:6]]
    ids = [None, *range(len(texts) - 2), 3]
    rows = [(i, t, None if i == 1 else "en", "s", 5, "extra", 1.0, "c", [1]) for i, t in zip(ids, texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, score double, shard string, hits array<int>")


@pytest.fixture
def nothing(odd):
    return odd.limit(0)
