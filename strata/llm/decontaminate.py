"""Benchmark windows in documents, by DataFrame operations only.

Words are runs of ASCII letters, digits and all other non-ASCII characters,
after lower-casing A-Z. An item of fewer words than the window is one window.
Null and wordless texts have no words and no hits. Rows are judged by doc_id and
text together, so repeated and null doc_ids stand for themselves; repeated item_ids
are one item; a null item_id counts as no item but its windows are hits. Texts of
any length are read whole; other columns of both tables are ignored; an empty
benchmark hits nothing, an empty documents table gives an empty result.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ASCII, and what becomes of it: lower case, digits, and spaces for all else.
ASCII = "".join(map(chr, range(128)))
PLAIN = "".join(c.lower() if c.isalnum() else " " for c in ASCII)
#: The benchmark's windows are broadcast up to this many; beyond it the join shuffles.
MAX_BROADCAST_WINDOWS = 1_000_000


def words(text):
    spaced = F.translate(F.coalesce(text, F.lit("")), ASCII, PLAIN)
    return F.array_remove(F.split(spaced, " "), "")


def _window(at, n: int):
    """Hash of the n words of column w from `at`, over no array of their own."""
    return F.xxhash64(F.lit(n), *[F.get("w", at + j) for j in range(n)])


def _gram(at, n):
    return F.array_join(F.slice("w", at + 1, n), " ")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of a row, k1 and k2: its doc_id (null too) and text. Equal rows share their hits."""
    return docs.withColumn("k1", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("k2", F.xxhash64("doc_id", "text"))


def found_in(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """k1, k2, n_hit, found (sorted item_ids) of rows with hits; docs is keyed."""
    item = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    item = item.select("item_id", F.least(F.size("w"), F.lit(n)).alias("n"), "w")
    sizes = [r.n for r in item.select("n").distinct().collect()]  # at most n of them
    doc = docs.select("k1", "k2", words(F.col("text")).alias("w"))
    if not sizes:
        return docs.select("k1", "k2", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("found")).limit(0)

    def windows(rows: DataFrame, *kept: str) -> DataFrame:
        # The outer explode keeps Spark from splitting every text once more to test for words.
        starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
        placed = rows.withColumn("at", F.explode_outer(starts)).filter("at is not null")
        each = F.array(*[F.struct(F.lit(k).alias("n"), _window(F.col("at"), k).alias("h")) for k in sizes])
        return placed.withColumn("x", F.explode(each)).filter(F.col("at") + F.col("x.n") <= F.size("w")).select(*kept, "at", "x.n", "x.h")

    own = windows(item.withColumnRenamed("n", "own"), "item_id", "own", "w").filter("n = own")
    grams = own.select(F.col("item_id").cast("string").alias("item"), "h", _gram(F.col("at"), F.col("n")).alias("gram")).distinct()
    small = grams.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS
    held = grams.groupBy("h", "gram").agg(F.sort_array(F.collect_set("item")).alias("items")).groupBy("h").agg(F.collect_list(F.struct("gram", "items")).alias("same"))
    if small:
        seen = windows(doc, "k1", "k2", "w").join(F.broadcast(held), "h")
    else:
        # Hashes alone are shuffled; of the few rows with a hit the words are read again.
        named = windows(doc, "k1", "k2").join(held.select("h"), "h", "left_semi")
        seen = named.distinct().join(doc.select("k1", "k2", "w").dropDuplicates(["k1", "k2"]), ["k1", "k2"]).join(held, "h")
    # A hash names candidates; the words decide.
    real = seen.withColumn("gram", _gram(F.col("at"), F.col("n"))).select("k1", "k2", "at", (F.col("at") + F.col("n")).alias("end"), F.explode(F.filter("same", lambda g: g["gram"] == F.col("gram"))).alias("g"))
    # Words of a window beyond the furthest end of those before it.
    upto = F.max("end").over(Window.partitionBy("k1", "k2").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), F.coalesce(upto, F.lit(0))))
    return real.withColumn("fresh", fresh).groupBy("k1", "k2").agg(F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("g.items")))).alias("found"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 8, least: int = 2) -> DataFrame:
    docs = keyed(docs.select("doc_id", "text"))
    totals = docs.select("doc_id", "k1", "k2", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = totals.join(found_in(docs, items, n), ["k1", "k2"], "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    items = F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(found).cast("long").alias("n_items"), items, (F.size(found) >= least).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII[65:91]}', '{ASCII[97:123]}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 8) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS k FROM i)),
s AS (SELECT DISTINCT n FROM i),
p AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, s WHERE len(w) >= n)),
h AS (SELECT r, k, p.n, item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
a AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS x FROM h) GROUP BY r),
b AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN a ON d.r = a.r LEFT JOIN b ON d.r = b.r
"""
