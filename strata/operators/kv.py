"""Key-value operators over a changelog DataFrame (key, value, seq, is_tombstone).

Recency is seq alone. Filters on key go below the newest-per-key step; filters
on tombstones always follow it.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER_BYTES = 20
#: Log rows whose running sums one task makes.
STRETCH = 1_000_000


def changelog(df: DataFrame, key, value, seq, tombstone) -> DataFrame:
    dead = F.coalesce(tombstone, F.lit(False))
    return df.select(key.alias("key"), F.when(~dead, F.coalesce(value, F.lit(""))).alias("value"), seq.cast("long").alias("seq"), dead.alias("is_tombstone"))


def latest(log: DataFrame, by: str = "window") -> DataFrame:
    """Newest version of each key, tombstones kept."""
    if by == "max_by":
        newest = F.max_by(F.struct("value", "seq", "is_tombstone"), "seq").alias("v")
        return log.groupBy("key").agg(newest).select("key", "v.value", "v.seq", "v.is_tombstone")
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def live(log: DataFrame, by: str = "window") -> DataFrame:
    return latest(log, by).filter(~F.col("is_tombstone"))


def scan(log: DataFrame, start=None, end=None) -> DataFrame:
    """Both bounds inclusive; None is unbounded."""
    if start is not None:
        log = log.filter(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.filter(F.col("key") <= F.lit(end))
    return live(log).select("key", "value").orderBy("key")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per requested key: key, value, found."""
    wanted = keys.select("key").distinct()
    hits = live(log.join(wanted, "key", "left_semi")).select("key", "value", F.lit(True).alias("hit"))
    return wanted.join(hits, "key", "left").select("key", "value", F.coalesce("hit", F.lit(False)).alias("found"))


def exists(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The requested keys that are live, each once. Only their versions are merged."""
    return live(log.join(keys.select("key").distinct(), "key", "left_semi")).select("key")


def delete_count(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that exist when deleted in turn: a repeated key counts once."""
    return multi_get(log, keys).agg(F.coalesce(F.sum(F.col("found").cast("long")), F.lit(0)).cast("long").alias("n_deleted"))


def record_bytes():
    return F.lit(HEADER_BYTES) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def layer_contents(log: DataFrame) -> DataFrame:
    """Flush: newest per (layer, key), tombstones kept; larger layers are newer."""
    w = Window.partitionBy("layer", "key").orderBy(F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def merge_layers(layers: DataFrame, includes_bottom: bool) -> DataFrame:
    """Newest layer wins. Tombstones go only if no older layer is left out."""
    w = Window.partitionBy("key").orderBy(F.desc("layer"))
    merged = layers.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return merged.filter(~F.col("is_tombstone")) if includes_bottom else merged


def transitions(log: DataFrame) -> DataFrame:
    """+1, 0 or -1 per write as it changes the number of live keys."""
    was = F.coalesce(~F.lag("is_tombstone").over(Window.partitionBy("key").orderBy("seq")), F.lit(False))
    return log.withColumn("delta", ((~F.col("is_tombstone")).cast("long") - was.cast("long")))


def running_count(log: DataFrame) -> DataFrame:
    """key, seq, delta and n_live, the number of live keys after each write.

    Sums run within stretches of the log; one row a stretch carries on from the one before.
    """
    moved = transitions(log).withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    each = moved.groupBy("stretch").agg(F.sum("delta").alias("total"))
    before = each.select("stretch", (F.sum("total").over(Window.orderBy("stretch")) - F.col("total")).alias("base"))
    upto = F.sum("delta").over(Window.partitionBy("stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return moved.withColumn("upto", upto).join(F.broadcast(before), "stretch").select("key", "seq", "delta", (F.col("base") + F.col("upto")).alias("n_live"))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live view after the write numbered seq."""
    return live(log.filter(F.col("seq") <= seq))


def snapshot_diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """key, change (added, removed, changed), old_value, new_value between two places in the log, in one pass over it."""
    at = lambda t: F.max_by(F.struct("value", "seq", "is_tombstone"), F.when(F.col("seq") <= t, F.col("seq")))
    both = log.filter(F.col("seq") <= new).groupBy("key").agg(at(old).alias("a"), at(new).alias("b"))
    alive = lambda x: F.col(x).isNotNull() & (F.col(f"{x}.seq") <= (old if x == "a" else new)) & ~F.col(f"{x}.is_tombstone")
    both = both.withColumn("was", F.coalesce(alive("a"), F.lit(False))).withColumn("is", F.coalesce(alive("b"), F.lit(False)))
    change = F.when(~F.col("was") & F.col("is"), "added").when(F.col("was") & ~F.col("is"), "removed").when(F.col("was") & F.col("is") & (F.col("a.value") != F.col("b.value")), "changed")
    shown = lambda flag, x: F.when(F.col(flag), F.col(f"{x}.value"))
    return both.select("key", change.alias("change"), shown("was", "a").alias("old_value"), shown("is", "b").alias("new_value")).filter("change is not null")
