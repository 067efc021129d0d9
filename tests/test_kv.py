import duckdb
import pytest

from strata.operators import kv
from strata.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    ours = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    cur = duck.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})")
    assert ours == sorted(map(repr, cur.fetchall()))


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, seq long, is_tombstone boolean")


def test_empty_value_is_not_a_delete(spark):
    rows = [("", "", 1, False), ("a", "x", 2, False), ("a", None, 3, True), ("a\x00", "y", 4, False)]
    assert [tuple(r) for r in kv.scan(log(spark, rows)).collect()] == [("", ""), ("a\x00", "y")]


def test_partial_merge_keeps_tombstones(spark):
    layers = spark.createDataFrame([("a", "x", 1, False, 0), ("a", None, 2, True, 1)], "key string, value string, seq long, is_tombstone boolean, layer long")
    newest = kv.merge_layers(layers.filter("layer = 1"), False)
    assert kv.merge_layers(newest.unionByName(layers.filter("layer = 0")), True).count() == 0
