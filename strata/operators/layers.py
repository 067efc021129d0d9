"""Segments, flush points and merges of a changelog."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import kv


def _fold(log: DataFrame, size, schema: str, step) -> DataFrame:
    """Runs step over (seq, size) in order of seq.

    A limit that starts anew after each cut makes the cuts sequential, so one task
    streams the two narrow columns, sorted with spill, in constant memory.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        state, names = step(), [c.split()[0] for c in schema.split(", ")]
        next(state)
        for b in batches:
            rows = [state.send((s, n)) for s, n in zip(b["seq"].to_pylist(), b["size"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    narrow = log.select("seq", size.cast("long").alias("size"))
    return narrow.repartition(1).sortWithinPartitions("seq").mapInArrow(run, schema)


def segments(log: DataFrame, limit: int) -> DataFrame:
    """seq, segment, bytes: the log cut before a write that finds `limit` bytes or more in the segment."""

    def step():
        segment, held, out = 0, 0, None
        while True:
            seq, size = yield out
            if held >= limit:
                segment, held = segment + 1, 0
            held += size
            out = seq, segment, size

    return _fold(log, kv.record_bytes(), "seq long, segment long, bytes long", step)


def flush_points(log: DataFrame, limit: int) -> DataFrame:
    """seq, flush, bytes: writes after which the table in memory holds `limit` bytes or more and is flushed.

    A put costs its key and value even if it replaces one, a delete its key and one byte.
    """

    def step():
        flush, held, out = 0, 0, None
        while True:
            seq, size = yield out
            held += size
            out = seq, flush, held
            if held >= limit:
                flush, held = flush + 1, 0

    cost = F.octet_length("key") + F.when(F.col("is_tombstone"), 1).otherwise(F.octet_length("value"))
    runs = _fold(log, cost, "seq long, flush long, bytes long", step)
    ends = runs.groupBy("flush").agg(F.max("seq").alias("seq"), F.max("bytes").alias("bytes"))
    return ends.filter(F.col("bytes") >= limit).select("flush", "seq", "bytes")


def layer_facts(layers: DataFrame) -> DataFrame:
    """layer, n_rows (deletes included), min_key, max_key, n_violations (keys not above the one before)."""
    before = F.lag("key").over(Window.partitionBy("layer").orderBy("key", "seq"))
    low, high = F.min("key").alias("min_key"), F.max("key").alias("max_key")
    bad = F.count_if(F.col("before") >= F.col("key")).alias("n_violations")
    return layers.withColumn("before", before).groupBy("layer").agg(F.count("*").alias("n_rows"), low, high, bad)


def merge_newest(log: DataFrame, since: int) -> DataFrame:
    """The live view through a partial merge: layers from `since` on merge with their deletes kept, then all do.

    One shuffle by key serves the layers' own merge and both others.
    """
    own = kv.layer_contents(log.repartition("key")).withColumn("new", F.col("layer") >= since)
    newest = F.row_number().over(Window.partitionBy("key", "new").orderBy(F.desc("layer")))
    partial = own.withColumn("rn", newest).filter("rn = 1 or not new").drop("rn", "new")
    return kv.merge_layers(partial, includes_bottom=True)
