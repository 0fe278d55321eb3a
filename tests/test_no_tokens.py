"""Documents without a token, against SQL: null, empty and blank texts."""

import duckdb
import pytest
from test_queries import plain

from tidemark import catalog

TEXTS = [None, "", " \n\t ", "The cat, the CAT", "le chat . le chat", "the", "Cat cat the .", "chat le , chat", None, "", "le the cat", "."]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("odd")
    rows = [(i, t, ("en", "fr", "de")[i % 3], "src0", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{where}/documents.parquet")
    return where


@pytest.mark.parametrize("name", ["numericalize", "text_data", "textify_roundtrip"])
def test_they_go(spark, data, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet/*.parquet')")
    found = duck.sql(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, f"file://{data}")
    rows = [tuple(plain(r[c]) for c in found.columns) for r in df.collect()]
    want = [tuple(map(plain, r)) for r in found.fetchall()]
    assert len(want) == 7
    assert sorted(rows, key=repr) == sorted(want, key=repr)
