"""Tables cut from their lineage in the shared folder, and joins that spread hot keys."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than one row in this many are hot; there are fewer of them than this.
HOT = 1000
#: Bytes of rows sent to a Python worker at once: neither side holds more, however long the rows.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Shuffle partitions of tables with many rows a document: WIDER times the session's, as long as these are below Spark's default.
PARTITIONS, WIDER, USUAL = "spark.sql.shuffle.partitions", 4, 200


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; a local one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/strata-shared"
    return f"{root}/{uuid.uuid4().hex}"


def narrow(spark: SparkSession) -> None:
    """Sends rows to Python workers by BATCH_BYTES from now on in this session."""
    spark.conf.set(BATCH, BATCH_BYTES)


def stored(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_wide(df: DataFrame) -> DataFrame:
    """As `stored`, with smaller shuffle partitions: for tables with many rows a document."""
    conf = df.sparkSession.conf
    before = conf.get(PARTITIONS)
    conf.set(PARTITIONS, max(int(before), min(WIDER * int(before), USUAL)))
    try:
        return stored(df)
    finally:
        conf.set(PARTITIONS, before)


def attach(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one small row a key and in `n` how many rows of left hold it.

    Hot keys, fewer than HOT, are broadcast; so no task gets all rows of one key.
    """
    many = max(total // HOT, 10_000)
    if total <= many:
        return left.join(right.drop("n"), on, how)
    hot = right.filter(F.col("n") > many).drop("n")
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.filter(F.col("n") <= many).drop("n"), on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    spark = df.sparkSession
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
