import duckdb
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF

#: Rows with every odd case: nulls, empty, blank, very long, repeated; and columns whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, component long, score double, lines string, rank int, key string, rep long, h long, block int, a long, b long, node long, n_lines long"


def rows_of(pairs):
    return [(i, t, lang, None, None, 1, 2, 0.5, "x", 1, "k", 3, 4, 5, 6, 7, 8, 9) for i, t, lang in pairs]


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"word{k % 997}" for k in range(60_000))
    pairs = [(1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, long, "en"), (5, long.upper(), None), (6, "same text of five words", "en"), (7, "Same text of FIVE words", "de"), (7, "Same text of FIVE words", "de"), (8, "!!! ... 123", None), (None, "a row without id here", "en"), (9, "é ü ñ ß 日本語 ́x", "fr"), (10, "one", "en")]
    return spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] for r in t}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con
