"""Nearest neighbours by a forest of random-projection trees and exact reranking.

Trees split at medians of a bounded sample; every row is placed in every tree.
A query takes leaves of all trees from one queue ordered by margin, until they
hold SHARE times the rows (one row counts in each tree), and all their rows are ranked by exact cosine. SHARE is
high because unstructured vectors of 64 dimensions need it for recall 0.9.

Vectors that are null, zero, hold null or non-finite components, or differ in
length from the most frequent length take no part. Rows of one vec_id count as
one candidate, the nearest; a query never finds its own vec_id. Ties go to the
smaller vec_id. Too few candidates are all returned; none give no rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import stored

TREES, DEPTH, SHARE, SAMPLE = 8, 6, 1.3, 20_000
#: Queries sent to the tasks together, and rows compared at once.
QUERY_BLOCK, ROW_BLOCK = 65_536, 8192


def grow(sample, trees: int, depth: int):
    """Directions and medians, trees x nodes, in heap order."""
    import numpy as np

    rng = np.random.default_rng(17)
    turn = rng.normal(size=(trees, 2**depth - 1, sample.shape[1]))
    turn /= np.linalg.norm(turn, axis=2, keepdims=True)
    cut = np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        node = np.zeros(len(sample), int)
        for i in range(2**depth - 1):
            here = node == i
            p = sample[here] @ turn[t, i]
            cut[t, i] = np.median(p) if len(p) else 0.0
            node[here] = 2 * i + 1 + (p > cut[t, i])
    return turn, cut


def leaves(v, forest):
    """Leaf of each vector in each tree."""
    import numpy as np

    turn, cut = forest
    out = np.zeros((len(v), len(turn)), int)
    for t in range(len(turn)):
        right = v @ turn[t].T > cut[t]
        node, each = np.zeros(len(v), int), np.arange(len(v))
        while len(v) and node[0] < len(cut[t]):
            node = 2 * node + 1 + right[each, node]
        out[:, t] = node - len(cut[t])
    return out


def visits(q, forest, counts, need: float):
    """queries x (trees * leaves): leaves taken from the shared queue by margin until they hold `need` rows."""
    import numpy as np

    turn, cut = forest
    margin = []
    for t in range(len(turn)):
        m = q @ turn[t].T - cut[t]
        level = np.full((len(q), 1), np.inf)
        first = 0
        while first < len(cut[t]):
            own = m[:, first : first + level.shape[1]]
            level, first = np.stack([np.minimum(level, -own), np.minimum(level, own)], 2).reshape(len(q), -1), first + level.shape[1]
        margin.append(level)
    order = np.argsort(-np.hstack(margin), axis=1, kind="stable")
    held = counts.ravel()[order]
    take = np.cumsum(held, axis=1) - held < need
    out = np.zeros(take.shape, bool)
    np.put_along_axis(out, order, take, axis=1)
    return out


def nearest(rows: DataFrame, is_query, k: int = 5, trees: int = TREES, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    import numpy as np

    base = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).filter("vec_id is not null")
    base = base.filter("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    spark, out = rows.sparkSession, "query_id long, vec_id long, score double"
    usual = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.filter(F.size("v") == usual.d)

    def unit(vs):
        v = np.stack(vs)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    forest = grow(unit([r.v for r in base.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()]), trees, depth)
    flat = np.arange(trees) * 2**depth

    def tally(batches):
        import pandas as pd

        n = np.zeros(trees * 2**depth, int)
        for pdf in batches:
            if len(pdf):
                np.add.at(n, leaves(unit(pdf["v"]), forest) + flat, 1)
        yield pd.DataFrame({"leaf": np.arange(len(n)), "n": n})

    counts = np.zeros(trees * 2**depth, int)
    for r in base.select("v").mapInPandas(tally, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # one row a leaf
        counts[r.leaf] = r.n
    need = max(share * usual["count"], trees * (k + 1))

    def block(queries):
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in queries]), unit([r.v for r in queries])))

        def merge(best, rows_, ids, scores):
            """Puts scores (queries x candidates) into the running best of those queries."""
            have_s, have_i = best[0][rows_], best[1][rows_]
            s, i = np.hstack([have_s, scores]), np.hstack([have_i, ids])
            order = np.lexsort((i, -s))
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            again = np.zeros(s.shape, bool)
            for c in range(1, s.shape[1]):
                again[:, c] = (i[:, :c] == i[:, c : c + 1]).any(axis=1)
            s = np.where(again, -np.inf, s)
            order = np.lexsort((i, -s))[:, :k]
            best[0][rows_], best[1][rows_] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

        def search(batches):
            import pandas as pd

            qid, q = sent.value
            seen = np.vstack([visits(q[a : a + 2048], forest, counts, need) for a in range(0, len(q), 2048)])
            best = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
            for pdf in batches:
                for a in range(0, len(pdf), ROW_BLOCK):
                    ids, v = pdf["vec_id"].to_numpy()[a : a + ROW_BLOCK], unit(pdf["v"].iloc[a : a + ROW_BLOCK])
                    place = leaves(v, forest) + flat
                    for leaf in np.unique(place):
                        own = np.flatnonzero((place == leaf).any(axis=1))
                        asked = np.flatnonzero(seen[:, leaf])
                        for b in range(0, len(asked), 4096):
                            who = asked[b : b + 4096]
                            s = q[who] @ v[own].T
                            s[qid[who][:, None] == ids[own]] = -np.inf
                            better = s.max(axis=1) >= best[0][who, -1]
                            who, s = who[better], s[better]
                            if len(who):
                                # Equal scores at the border are all kept for the tie rule.
                                edge = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                                wide = int((s >= edge[:, None]).sum(axis=1).max())
                                top = np.argpartition(-s, min(wide, s.shape[1]) - 1, axis=1)[:, :wide]
                                merge(best, who, ids[own][top], np.take_along_axis(s, top, 1))
            r, c = np.nonzero(np.isfinite(best[0]))
            yield pd.DataFrame({"query_id": qid[r], "vec_id": best[1][r, c], "score": best[0][r, c]})

        found = stored(base.select("vec_id", "v").mapInPandas(search, out))
        sent.destroy()
        return found

    # Queries go out in blocks of a fixed size, ordered by id; each block passes once over the rows.
    wanted, parts, after = stored(base.filter("q").select("vec_id", "v").dropDuplicates(["vec_id"])), [], None
    while queries := (wanted if after is None else wanted.filter(F.col("vec_id") > after)).orderBy("vec_id").limit(QUERY_BLOCK).collect():
        parts.append(block(queries))
        after = queries[-1].vec_id
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("x"))
    return best.select("query_id", F.posexplode("x").alias("at", "y")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "y.vec_id", (-F.col("y.far")).alias("score"))
