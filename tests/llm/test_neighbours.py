import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strata.llm.neighbours import nearest
from strata.llm.registry import QUERIES

DIR = "/root/testdata/sf0.01"


def test_recall_and_scores(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], "f8") for r in pq.read_table(f"{DIR}/embeddings.parquet").to_pylist()}
    cos = lambda a, b: float(rows[a] @ rows[b] / np.linalg.norm(rows[a]) / np.linalg.norm(rows[b]))
    got = QUERIES["op9_nearest"](spark, DIR).collect()
    hit = n = 0
    for q in (i for i in rows if i % 50 == 0):
        want = sorted((-cos(q, i), i) for i in rows if i != q)[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(cos(q, i) - s) < 1e-12 for _, i, s in own)
        hit, n = hit + len({i for _, i in want} & {i for _, i, _ in own}), n + 5
    assert hit >= 0.9 * n and len(got) == n


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [4.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score")
    got = sorted(tuple(r) for r in nearest(t, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, -1.0)]
    assert nearest(t.limit(0), F.lit(True)).count() == 0 and nearest(t, F.lit(False)).count() == 0
