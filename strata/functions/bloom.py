"""Bloom filters as DataFrames of set positions, by built-in functions.

Ten bits a key, rounded up to bytes, and seven probes, from two halves of one
64-bit hash. A key that was added is always found.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, PROBES = 10, 7


def size(n: int) -> int:
    """Bits for n keys, at least one."""
    return 8 * -(-BITS_PER_KEY * max(n, 1) // 8)


def positions(key: Column, bits: int) -> Column:
    h = F.xxhash64(key)
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(low + i * high, F.lit(bits)))


def build(keys: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """The set positions (column `bit`), and the number of bits."""
    bits = size(keys.count())
    return keys.select(F.explode(positions(F.col(key), bits)).alias("bit")).distinct(), bits


def probe(keys: DataFrame, bloom: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """Distinct keys and whether they may have been added."""
    asked = keys.select(key).distinct().withColumn("bit", F.explode(F.array_distinct(positions(F.col(key), bits))))
    held = asked.join(bloom.withColumn("set", F.lit(1)), "bit", "left")
    return held.groupBy(key).agg((F.count("*") == F.count("set")).alias("maybe"))


def to_bytes(bloom: DataFrame, bits: int) -> bytes:
    """The bit array; a byte's lowest bit is its first."""
    bytes_ = bloom.groupBy(F.floor(F.col("bit") / 8).alias("i")).agg(F.sum(F.pow(F.lit(2.0), F.col("bit") % 8)).cast("int").alias("b"))
    out = bytearray(bits // 8)
    for r in bytes_.collect():  # at most bits / 8 rows
        out[r.i] = r.b
    return bytes(out)


def from_bytes(spark, data: bytes) -> tuple[DataFrame, int]:
    bits = [(8 * i + k,) for i, b in enumerate(data) for k in range(8) if b >> k & 1]
    return spark.createDataFrame(bits, "bit long"), 8 * len(data)
