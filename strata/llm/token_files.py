"""Writes token ids as directly addressable codes in doc_id order and reads them back.

A row of a file holds its shard, the place of its first id in the shard, and the
codes of one document; the shards' totals are the directory from a token's number
in the corpus to its row. Repeated doc_ids keep their rows, in any order among
themselves, null doc_ids come first; null and empty texts hold the end id alone;
texts of any length are encoded whole. Other columns of documents are ignored;
an empty table gives no rows.
"""

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.shared import shared_folder
from strata.llm.tokens import encoder, portions, texts

ROWS = "doc_id long, shard int, at long, n_tokens long, code binary"


def write(docs: DataFrame, tokenizer_file: str, end_id: int, path: str) -> None:
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from strata.llm import dac

        encode, shard, at = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in portions(batch):
                ids = [np.frombuffer(x + end, "<u4") for x in encode(texts(part))]
                sizes = np.array([len(x) for x in ids], "i8")
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                codes = pa.array([dac.pack(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([shard] * len(ids), pa.int32()), pa.array(starts), pa.array(sizes), codes], names=["doc_id", "shard", "at", "n_tokens", "code"])

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # Codes are dense already; without a page codec a row is read by its place alone.
    ranged.mapInArrow(run, ROWS).write.option("compression", "uncompressed").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: the ids before each shard; one row a file."""
    totals = spark.read.schema(ROWS).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files."""

    def run(batches):
        import pyarrow as pa

        from strata.llm import dac

        for batch in batches:
            size, crc = [], []
            for x in batch.column("code"):
                ids = dac.Reader(x.as_py()).all()
                size.append(len(ids))
                crc.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "shard", "at")), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    own = spark.read.schema(ROWS).parquet(path).select("doc_id", "shard", "at", "code").mapInArrow(run, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    placed = own.join(F.broadcast(shards(spark, path)), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, number: int) -> int:
    """The token with this number in the corpus: the directory names its row, the row's levels its code."""
    from strata.llm import dac

    home = shards(spark, path).filter(F.col("base") <= number).orderBy(F.desc("base"), F.desc("shard")).first()
    rows = spark.read.schema(ROWS).parquet(path)
    at = number - home.base if home else number
    row = home and rows.filter((F.col("shard") == home.shard) & (F.col("at") <= at) & (F.col("at") + F.col("n_tokens") > at)).select("at", "code").first()
    if number < 0 or not row:
        raise IndexError(number)
    return dac.Reader(bytes(row.code))[at - row.at]


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    path = shared_folder(docs.sparkSession)
    write(docs, tokenizer_file, end_id, path)
    return digest(docs.sparkSession, path)
