import duckdb
import pytest

from conftest import SF_SMALL
from ruleweave.llm.queries import ORACLE, QUERIES

TABLES = ["documents", "embeddings", "pages", "labels", "benchmark"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want, got = con.execute(ORACLE[name]), QUERIES[name](spark, SF_SMALL)
    cols = sorted(got.columns)
    order = [d[0] for d in want.description]
    assert sorted(order) == cols
    key = lambda r: [(x is not None, x) for x in r]
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(r[order.index(c)] for c in cols) for r in want.fetchall()), key=key)
    assert a == b


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:4] in {"op3_", "op6_", "op8_", "op10"}))
def test_whole_table_rows(spark, name):
    got = QUERIES[name](spark, SF_SMALL)
    table = "embeddings" if name.startswith("op6") else "documents"
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()
