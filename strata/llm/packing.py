"""Packs token pieces into sequences: greedy matching of large pieces, best fit of the others.

Every text is encoded whole and ends with one end id; a null text holds the end
id alone. Only longer documents are cut, their first piece taking the rest.
Plans are made on the histogram of piece lengths, at most `size` rows however
many documents there are; pieces find their place by their rank within their
length. Repeated rows are packed alone, null doc_ids like any other; other
columns are ignored; an empty table gives an empty result.
"""

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.shared import stored
from strata.llm.tokens import encoder, portions, texts

PLACE = "length long, first long, last long, each long, base long, at long"


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places (length, first and last rank, pieces a sequence, first sequence, offset)."""
    left, places, bins = dict(counts), [], 0
    gaps, sizes = defaultdict(list), []

    def put(length, n, each, base, at):
        rank = counts[length] - left[length]
        places.append((length, rank, rank + n - 1, each, base, at))
        left[length] -= n

    def room(base, n, gap):
        if n and gap:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((base, n))

    large = sorted(x for x in counts if 3 * x > size)
    for x in reversed(large):
        while left[x]:
            y = next((y for y in reversed(large[: bisect_left(large, size - x + 1)]) if left[y] and (y != x or left[x] > 1)), None)
            n = left[x] if y is None else left[x] // 2 if y == x else min(left[x], left[y])
            put(x, n, 1, bins, 0)
            if y is not None:
                put(y, n, 1, bins, x)
            room(bins, n, size - x - (y or 0))
            bins += n
    for x in sorted((x for x in counts if 3 * x <= size), reverse=True):
        while left[x]:
            k = bisect_left(sizes, x)
            if k == len(sizes):
                fresh = -(-left[x] // (size // x))
                room(bins, fresh, size)
                bins += fresh
                continue
            gap = sizes[k]
            base, n = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(k)
            each = gap // x
            full = min(n, left[x] // each)
            if full:
                put(x, full * each, each, base, size - gap)
                room(base, full, gap - each * x)
            if full < n and (rest := left[x]):
                put(x, rest, rest, base + full, size - gap)
                room(base + full, 1, gap - rest * x)
                full += 1
            room(base + full, n - full, gap)
    return places


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, size: int, keep_ids: bool = False) -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import zlib

        import pyarrow as pa

        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        encode = encoder(tokenizer_file)
        for batch in batches:
            for part in portions(batch):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts(part))):
                    ids += end
                    n = len(ids) // 4
                    ends = list(range(n, 0, -size))[::-1]
                    for k, (a, b) in enumerate(zip([0, *ends], ends)):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(own), own if keep_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 0, size: int = 2048, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; ids too if wanted."""
    own = stored(pieces(docs, tokenizer_file, end_id, size, keep_ids).withColumn("shard", F.spark_partition_id()))
    tally = own.groupBy("length", "shard").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    spark = docs.sparkSession
    places = spark.createDataFrame(plan(counts, size), PLACE)
    before = tally.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    # A length's rows are numbered shard by shard, so a frequent length stays spread.
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece")
    ranked = own.withColumn("r", F.row_number().over(within)).join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    p = places.withColumnRenamed("length", "l")
    placed = ranked.join(F.broadcast(p), (F.col("length") == F.col("l")) & F.col("rank").between(F.col("first"), F.col("last")))
    step = F.col("rank") - F.col("first")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("at") + step % F.col("each") * F.col("length")).alias("offset")]
    return placed.select(*out, *(["ids"] if keep_ids else []))
