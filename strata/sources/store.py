"""A key-value store on Parquet: an append log, sorted tables, and a manifest that commits each change.

Every write is a batch: a folder of log rows, then a new manifest. Keys and values
are binary; null values are empty, a delete is a row of its own. Recency is seq
alone, which tables keep, so any set of layers merges by the newest seq of a key.
Reads are lazy DataFrames over the folders of the manifest they began with. One
writer at a time: a second one's commit fails and changes nothing.
"""

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.frames import MAX_KEY_BYTES, MAX_VALUE_BYTES
from strata.operators import kv
from strata.sources import manifest as m
from strata.sources.files import Files

SCHEMA = "key binary, value binary, seq long, is_tombstone boolean, ts long"


@dataclass(frozen=True)
class Options:
    max_segment_bytes: int = 4 << 20
    max_mem_bytes: int = 4 << 20
    #: Rows of a table's files; keys are ranged over as many files as that takes.
    rows_per_file: int = 5_000_000


def _inside(table: m.Table, start, end) -> bool:
    if table.min_key is None:
        return False
    low, high = bytes.fromhex(table.min_key), bytes.fromhex(table.max_key)
    return (end is None or low <= end) and (start is None or high >= start)


class Store:
    def __init__(self, spark: SparkSession, root: str, options: Options = Options()):
        """Opens or creates; folders that no manifest names (a crashed write) are removed."""
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.files = Files(spark, self.root)
        self.now = m.load(self.files) or m.commit(self.files, m.Manifest(version=1))
        self.open = True
        self.vacuum()

    def _ready(self) -> None:
        if not self.open:
            raise ValueError("the store is closed")

    def close(self) -> None:
        """Nothing is held back: the log has all writes."""
        self.open = False

    def vacuum(self, versions: int = 1) -> list[str]:
        """Removes folders outside the manifest and all but the newest versions of it."""
        known = [n for n in self.files.names() if n.startswith(m.PREFIX)]
        kept = set().union(*(m.Manifest.decode(self.files.read(n)).folders() for n in known[-versions:]))
        gone = [n for n in self.files.names() if n not in kept and n not in known[-versions:] and n.split("-")[0] in ("log", "table", "manifest")]
        for n in gone:
            self.files.delete(n)
        return gone

    # Writes

    def apply(self, ops: DataFrame) -> None:
        """Rows key, value, is_tombstone and, if keys repeat, `at`: their order in the batch.

        A key or value over its limit or a null key is an error, and nothing is written.
        """
        self._ready()
        at = F.col("at").cast("long") if "at" in ops.columns else F.lit(0).cast("long")
        dead = F.coalesce("is_tombstone", F.lit(False))
        value = F.when(~dead, F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
        ops = ops.select(F.col("key").cast("binary").alias("key"), value.alias("value"), at.alias("at"), dead.alias("is_tombstone"))
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
        check = ops.agg(
            F.count("*").alias("n"), F.count("key").alias("keyed"), F.min("at").alias("low"), F.max("at").alias("high"),
            F.max(F.octet_length("key")).alias("key"), F.max(F.octet_length("value")).alias("value"),
            F.sum(size + kv.HEADER_BYTES).alias("log"), F.sum(size + F.col("is_tombstone").cast("int")).alias("mem"),
        ).first()
        if not check.n:
            return
        if check.keyed < check.n:
            raise ValueError("a key is null")
        if check.key > MAX_KEY_BYTES or (check.value or 0) > MAX_VALUE_BYTES:
            raise ValueError(f"a key of {check.key} or a value of {check.value} bytes is too long")
        if ops.groupBy("key", "at").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            raise ValueError("a key repeats without an order: give the column `at`")
        now, segments, taken = self.now, list(self.now.segments), self.now.next_id
        if segments[-1].bytes >= self.options.max_segment_bytes:
            segments.append(m.Segment(taken))
            taken += 1
        folder = self._folder("log")
        rows = ops.withColumn("seq", F.col("at") - check.low + now.next_seq).withColumn("ts", F.unix_millis(F.current_timestamp()))
        rows.select("key", "value", "seq", "is_tombstone", "ts").write.parquet(f"{self.root}/{folder}")
        segments[-1] = replace(segments[-1], parts=(*segments[-1].parts, folder), bytes=segments[-1].bytes + check.log)
        self._commit(segments=tuple(segments), next_id=taken, next_seq=now.next_seq + check.high - check.low + 1, mem_bytes=now.mem_bytes + check.mem)
        if self.now.mem_bytes >= self.options.max_mem_bytes:
            self.flush()

    def put_many(self, rows: DataFrame) -> None:
        self.apply(rows.withColumn("is_tombstone", F.lit(False)))

    def delete_many(self, keys: DataFrame) -> None:
        """Blind: absent keys are no error."""
        self.apply(keys.select("key").distinct().select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("is_tombstone")))

    def set(self, key: bytes, value: bytes | None) -> None:
        self.put_many(self.spark.createDataFrame([(bytearray(key), bytearray(value or b""))], "key binary, value binary"))

    def delete(self, key: bytes) -> None:
        self.delete_many(self._keys([key]))

    def _keys(self, keys: list[bytes]) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")

    def _folder(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _commit(self, **changes) -> None:
        self.now = m.commit(self.files, self.now.next(**changes))

    # Layers

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], SCHEMA)

    def log(self) -> DataFrame:
        """Rows not yet in a table."""
        return self._read([p for s in self.now.segments for p in s.parts])

    def table(self, t: m.Table) -> DataFrame:
        return self._read([t.folder])

    def rows(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All versions in all layers; tables wholly outside the bounds are left out."""
        self._ready()
        return self._read([p for s in self.now.segments for p in s.parts] + [t.folder for t in self.now.tables if _inside(t, start, end)])

    def _write_table(self, rows: DataFrame) -> m.Table | None:
        folder, n = self._folder("table"), rows.count()
        if not n:
            return None
        files = -(-n // self.options.rows_per_file)
        rows.repartitionByRange(files, "key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.root}/{folder}")
        written = self._read([folder])
        low, high = written.agg(F.min("key"), F.max("key")).first()
        if order_violations(written):
            raise ValueError(f"{folder} is out of order")
        return m.Table(self.now.next_id, folder, n, self.files.size(folder), bytes(low).hex(), bytes(high).hex())

    def flush(self) -> None:
        """The log becomes a table, newest version of each key with deletes kept, and a new segment begins."""
        self._ready()
        if not any(s.parts for s in self.now.segments):
            return
        made = self._write_table(kv.latest(self.log()))
        self._commit(tables=(*self.now.tables, made), segments=(m.Segment(made.id + 1),), next_id=made.id + 2, mem_bytes=0)

    def compact(self) -> None:
        """Merges all but the active segment. Deletes go only if no table lies below."""
        self._ready()
        old, active = self.now.segments[:-1], self.now.segments[-1]
        if not old:
            return
        merged = kv.latest(self._read([p for s in old for p in s.parts]))
        merged = merged if self.now.tables else merged.filter(~F.col("is_tombstone"))
        folder = self._folder("log")
        merged.write.parquet(f"{self.root}/{folder}")
        left = self._read([folder]).agg(F.coalesce(F.sum(kv.record_bytes()), F.lit(0)).cast("long")).first()[0]
        self._commit(segments=(replace(old[-1], parts=(folder,), bytes=left), active))

    def compact_tables(self) -> None:
        """Merges all tables, the oldest included, so deletes go."""
        self._ready()
        if len(self.now.tables) < 2:
            return
        made = self._write_table(kv.live(self._read([t.folder for t in self.now.tables])))
        self._commit(tables=(made,) if made else (), next_id=self.now.next_id + 1)

    # Reads

    def get(self, key: bytes) -> bytes | None:
        row = self.find(key).first()
        return None if row is None else bytes(row.value)

    def find(self, key: bytes) -> DataFrame:
        """key, value; no row if absent. The filter on key reaches each layer's scan."""
        return kv.live(self.rows(key, key).filter(F.col("key") == F.lit(bytearray(key)))).select("key", "value")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return kv.multi_get(self.rows(), keys)

    def exists(self, keys: DataFrame) -> DataFrame:
        return kv.exists(self.rows(), keys)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        bound = lambda b: None if b is None else bytearray(b)
        return kv.scan(self.rows(start, end), bound(start), bound(end))

    def as_of(self, seq: int) -> DataFrame:
        """The state after a write, as far as no merge has dropped versions since."""
        return kv.as_of(self.rows(), seq).select("key", "value")

    def __len__(self) -> int:
        return kv.live(self.rows()).count()

    def table_count(self) -> int:
        return len(self.now.tables)

    def segment_count(self) -> int:
        return len(self.now.segments)

    def disk_usage(self) -> dict[str, int]:
        """Logical bytes of the log and bytes of the tables' files."""
        return {"log": sum(s.bytes for s in self.now.segments), "tables": sum(t.bytes for t in self.now.tables)}

    def stats(self) -> dict[str, int]:
        return {"keys": len(self), "segments": self.segment_count(), "tables": self.table_count(), **{f"{k}_bytes": v for k, v in self.disk_usage().items()}}


def order_violations(table: DataFrame) -> int:
    """Rows of a stored table whose key is not above the one before it in the file."""
    from pyspark.sql import Window

    placed = table.select("key", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag("key").over(Window.partitionBy("file").orderBy("row"))
    return placed.withColumn("before", before).filter("before >= key").count()
