"""A live view of a stream of log rows (an extension): newest version of each key in state, deletes hidden."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_stream(log: DataFrame) -> DataFrame:
    """key, value, seq; for output mode complete, since a delete takes a row away."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("value", "seq", "is_tombstone"), "seq").alias("v"))
    return newest.filter("not v.is_tombstone").select("key", "v.value", "v.seq")


def into_store(log: DataFrame, store, checkpoint: str):
    """Appends each micro-batch of a stream (key, value, is_tombstone, at) to a store.

    A batch that is run again after a failure is appended again under newer seqs;
    its rows are the same, so the view is too unless another writer came between.
    """
    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: store.apply(rows)).start()
