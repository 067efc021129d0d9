"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics are those of the whole text, never its language, source or id. A
null or wordless text has the statistics of an empty one and is scored like any
other. Without labels of both kinds every score is the share of label 1, or 0.5.
Labels of rows outside `documents` are ignored; of several labels of one doc_id
each counts. Repeated documents are judged alone; an empty table gives an empty
result.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.language import held_out
from strata.llm.shared import stored

STATS, FEATURES, RIDGE, WIDTH = 14, 128, 1e-2, 3.0
#: Raw scores are pooled on a grid of this step before the isotonic fit.
GRID = 0.002


def statistics(text) -> list[float]:
    import math
    import zlib
    from collections import Counter

    t = text if isinstance(text, str) else ""
    words, lines, n = t.split(), t.split("\n"), max(1, len(t))
    tally, low = Counter(w.lower() for w in words), t.lower()
    m = max(1, len(words))
    raw = t.encode("utf-8", "surrogatepass")
    return [
        math.log1p(len(words)),
        math.log1p(len(lines)),
        min(30.0, len(t) / m),
        len(tally) / m,
        max(tally.values(), default=0) / m,
        sum(map(len, re.findall(r"[^\w\s.,]", t))) / n,
        len(re.findall(r"[.,]", t)) / n,
        len(re.findall(r"[0-9]", t)) / n,
        sum(a != b for a, b in zip(t, low)) / n,
        len(set(lines)) / len(lines),
        sum(c for w, c in tally.items() if not w[-1].isalnum() and w[-1] not in ".,") / m,
        sum(c for w, c in tally.items() if len(w) <= 3) / m,
        min(1.0, len(zlib.compress(raw, 1)) / max(1, len(raw))),
        len(re.findall(r"https?:|www\.|\|", t)) / m,
    ]


def _pool(score, label, weight):
    """Increasing fit by pooling adjacent violators."""
    blocks = []
    for x, y, w in zip(score, label, weight):
        blocks.append([x, x, y * w, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, s, w = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = hi, blocks[-1][2] + s, blocks[-1][3] + w
    return [p for lo, hi, s, w in blocks for p in ((lo, s / w), (hi, s / w))]


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    import numpy as np

    def measure(batches):
        for pdf in batches:
            yield pdf[["doc_id"]].astype({"doc_id": "Int64"}).assign(x=[statistics(t) for t in pdf["text"]])

    own = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(measure, "doc_id long, x array<double>"))
    train = own.filter(~held_out()).join(labels.filter("quality is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")), "doc_id").select("x", "y")
    each = [v for i in range(STATS) for v in (F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i]))]
    n, share, *rest = train.agg(F.count("*"), F.avg("y"), *each).first()
    if not n or share in (0.0, 1.0):
        flat = F.lit(0.5 if share is None else share)
        return own.select("doc_id", held_out().alias("held_out"), flat.alias("score"), (flat >= 0.3).cast("int").alias("predicted"))
    mean, scale = np.array(rest[::2]), np.maximum(np.array(rest[1::2]), 1e-9)
    rng = np.random.default_rng(3)
    turn, phase = rng.normal(size=(STATS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)

    def lift(xs):
        z = np.clip((np.stack(xs) - mean) / scale, -6, 6)
        return np.hstack([np.cos(z @ turn + phase) * np.sqrt(2 / FEATURES), z / 10, np.ones((len(z), 1))])

    size = FEATURES + STATS + 1
    at, to = np.triu_indices(size + 1)

    def sums(batches):
        import pandas as pd

        total = np.zeros((size + 1, size + 1))
        for pdf in batches:
            if len(pdf):
                z = np.hstack([lift(pdf["x"]), pdf[["y"]].to_numpy()])
                total += z.T @ z
        if total.any():
            yield pd.DataFrame({"i": at, "j": to, "v": total[at, to]})

    m = np.zeros((size + 1, size + 1))
    for r in train.mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # size^2 / 2 rows
        m[r.i, r.j] = m[r.j, r.i] = r.v
    beta = np.linalg.solve(m[:size, :size] + RIDGE * np.eye(size), m[:size, size])

    def raw(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.drop(columns="x").assign(raw=np.clip(lift(pdf["x"]) @ beta, -1, 2))

    pooled = train.mapInPandas(raw, "y double, raw double").groupBy(F.round(F.col("raw") / GRID).alias("g")).agg(F.avg("y").alias("y"), F.count("*").alias("w"))
    fit = sorted(tuple(r) for r in pooled.collect())  # at most 3 / GRID rows
    curve = np.array(_pool([g * GRID for g, _, _ in fit], [y for _, y, _ in fit], [w for _, _, w in fit]))

    def calibrate(batches):
        for pdf in raw(batches):
            yield pdf[["doc_id"]].assign(score=np.clip(np.interp(pdf["raw"], curve[:, 0], curve[:, 1]), 0, 1))

    out = own.mapInPandas(calibrate, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
