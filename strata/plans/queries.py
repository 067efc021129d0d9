"""Registered key-value queries and their SQL."""

from pyspark.sql import functions as F

from strata.functions import bloom
from strata.operators import kv, layers

LOG_SQL = "log AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_id AS seq, event_type = 'error' AS is_tombstone FROM events)"
NEW_SQL = LOG_SQL + ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM log) WHERE rn = 1), live AS (SELECT key, value, seq FROM latest WHERE NOT is_tombstone)"
HIT, DELETED, ABSENT = "00000000", "00000005", "99999999"
WANTED = [HIT, HIT, DELETED, ABSENT, "00000001"]
SIZE_SQL = "20 + strlen(key) + coalesce(strlen(value), 0)"
BYTES_SQL = f"CAST(sum({SIZE_SQL}) AS BIGINT)"


SEGMENT, MEMORY = 65_536, 32_768


def events_log(spark, d, low=None, high=None):
    """The log of events. Bounds on the key are bounds on user_id, of which it is a padded copy, and reach the scan."""
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e if low is None else e.filter(F.col("user_id") >= int(low))
    e = e if high is None else e.filter(F.col("user_id") <= int(high))
    return kv.changelog(e, F.lpad(F.col("user_id").cast("string"), 8, "0"), F.col("props"), F.col("event_id"), F.col("event_type") == "error")


def orders_log(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return kv.changelog(o, F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_orderstatus") == "F")


def keys(spark, wanted):
    return spark.createDataFrame([(k,) for k in wanted], "key string")


def layered(log, width=2500):
    return log.withColumn("layer", F.floor(F.col("seq") / width).cast("long"))


def segmented(log):
    """The log with its greedy segments as layers."""
    return log.join(layers.segments(log, SEGMENT).select("seq", F.col("segment").alias("layer")), "seq")


def stats(log):
    """One pass: each key's counts and whether its newest version is a delete, then their sums."""
    each = log.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("is_tombstone").cast("long")).alias("dead"), F.sum(kv.record_bytes()).alias("b"), F.max_by("is_tombstone", "seq").alias("gone"))
    long = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(long("n").alias("versions"), long("dead").alias("tombstones"), long("b").alias("bytes"), F.count("*").alias("keys"), F.count_if(~F.col("gone")).alias("live"))


def segment_facts(log):
    return layers.segments(log, SEGMENT).groupBy("segment").agg(F.count("*").alias("n_rows"), F.min("seq").alias("first_seq"), F.sum("bytes").cast("long").alias("bytes"))


def space(log):
    """Bytes of the log and of its live view."""
    by_key = log.groupBy("key").agg(F.sum(kv.record_bytes()).alias("b"), F.max_by(F.struct("is_tombstone", kv.record_bytes().alias("b")), "seq").alias("v"))
    left = F.sum(F.when(~F.col("v.is_tombstone"), F.col("v.b")).otherwise(0))
    return by_key.agg(F.sum("b").cast("long").alias("before"), left.cast("long").alias("after"))


def bloom_quality(log):
    """Added keys missed (none may be), and whether at most 3 % of absent ones pass."""
    added, bits = bloom.build(log.select("key").distinct())
    asked = log.select("key", F.lit(True).alias("present")).distinct()
    absent = log.sparkSession.range(10_000).select(F.concat(F.lit("absent-"), F.col("id").cast("string")).alias("key"), F.lit(False).alias("present"))
    both = asked.unionByName(absent)
    seen = both.join(bloom.probe(both, added, bits), "key")
    passed = F.count_if(~F.col("present") & F.col("maybe"))
    return seen.agg(F.count_if(F.col("present") & ~F.col("maybe")).alias("missed"), (passed <= 300).alias("few_false"))


def view(df):
    return df.select("key", "value", "seq")


def on_events(f):
    return lambda spark, d: f(events_log(spark, d))


def get(key):
    return lambda spark, d: kv.multi_get(events_log(spark, d, key, key), keys(spark, [key]))


def scan(low=None, high=None):
    return lambda spark, d: kv.scan(events_log(spark, d, low, high), low, high)


def last_turns(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("v")).select("conv_id", "v.turn", "v.role", "v.text")


def count(df, name):
    return df.agg(F.count("*").alias(name))


QUERIES = {
    "kv_live": on_events(lambda x: view(kv.live(x))),
    "kv_live_maxby": on_events(lambda x: view(kv.live(x, "max_by"))),
    "kv_dbsize": on_events(lambda x: count(kv.live(x), "n")),
    "kv_get_hit": get(HIT),
    "kv_get_deleted": get(DELETED),
    "kv_get_absent": get(ABSENT),
    "kv_scan_closed": scan("00000003", "00000009"),
    "kv_scan_open_start": scan(high="00000009"),
    "kv_scan_open_end": scan("00000009"),
    "kv_scan_single": scan(HIT, HIT),
    "kv_scan_empty": lambda s, d: count(scan("00000009", "00000003")(s, d), "n"),
    "kv_multi_get": lambda s, d: kv.multi_get(events_log(s, d), keys(s, WANTED)),
    "kv_exists": lambda s, d: kv.exists(events_log(s, d), keys(s, WANTED)),
    "kv_del_count": lambda s, d: kv.delete_count(events_log(s, d), keys(s, WANTED)),
    "kv_stats": on_events(stats),
    "kv_incremental_count": on_events(lambda x: kv.transitions(x).select("key", "seq", "delta")),
    "kv_layer_contents": on_events(lambda x: kv.layer_contents(layered(x)).select("layer", "key", "value", "seq", "is_tombstone")),
    "kv_layers_merge": on_events(lambda x: view(kv.merge_layers(kv.layer_contents(layered(x).repartition("key")), True))),
    "kv_compact_partial": on_events(lambda x: view(layers.merge_newest(layered(x), 2))),
    "kv_compact_full": on_events(lambda x: view(kv.merge_layers(kv.layer_contents(segmented(x).repartition("key")), True))),
    "kv_segments": on_events(segment_facts),
    "kv_flush_points": on_events(lambda x: layers.flush_points(x, MEMORY)),
    "kv_order_check": on_events(lambda x: layers.layer_facts(kv.layer_contents(layered(x)))),
    "kv_space_reclaimed": on_events(space),
    "kv_bloom_quality": on_events(bloom_quality),
    "kv_running_count": on_events(lambda x: kv.running_count(x).select("key", "seq", "n_live")),
    "kv_snapshot_diff": on_events(lambda x: kv.snapshot_diff(x, 4000, 8000)),
    "kv_frame_sizes": on_events(lambda x: x.groupBy("key").agg(F.sum(kv.record_bytes()).cast("long").alias("bytes"))),
    "kv_orders_live": lambda s, d: view(kv.live(orders_log(s, d))),
    "kv_as_of": on_events(lambda x: view(kv.as_of(x, 5000))),
    "kv_conversations_latest": last_turns,
}

_LIVE = f"WITH {NEW_SQL} SELECT key, value, seq FROM live"
_SCAN = f"WITH {NEW_SQL} SELECT key, value FROM live WHERE "


def _get(wanted):
    rows = ", ".join(f"('{k}')" for k in dict.fromkeys(wanted))
    return f"WITH {NEW_SQL} SELECT w.key, l.value, l.key IS NOT NULL AS found FROM (VALUES {rows}) w(key) LEFT JOIN live l ON l.key = w.key"


_IN = ", ".join(f"'{k}'" for k in WANTED)
SQL = {
    "kv_live": _LIVE,
    "kv_live_maxby": _LIVE,
    "kv_layers_merge": _LIVE,
    "kv_compact_partial": _LIVE,
    "kv_compact_full": _LIVE,
    "kv_segments": f"WITH RECURSIVE {LOG_SQL}, s AS (SELECT seq, {SIZE_SQL} AS b FROM log), r AS (SELECT seq, 0 AS segment, b, b AS held FROM s WHERE seq = 0 UNION ALL SELECT s.seq, r.segment + CAST(r.held >= {SEGMENT} AS INTEGER), s.b, CASE WHEN r.held >= {SEGMENT} THEN s.b ELSE r.held + s.b END FROM r JOIN s ON s.seq = r.seq + 1) SELECT CAST(segment AS BIGINT) AS segment, count(*) AS n_rows, min(seq) AS first_seq, CAST(sum(b) AS BIGINT) AS bytes FROM r GROUP BY segment",
    "kv_flush_points": f"WITH RECURSIVE {LOG_SQL}, s AS (SELECT seq, CASE WHEN is_tombstone THEN strlen(key) + 1 ELSE strlen(key) + strlen(value) END AS b FROM log), r AS (SELECT seq, 0 AS flush, b AS held FROM s WHERE seq = 0 UNION ALL SELECT s.seq, r.flush + CAST(r.held >= {MEMORY} AS INTEGER), CASE WHEN r.held >= {MEMORY} THEN s.b ELSE r.held + s.b END FROM r JOIN s ON s.seq = r.seq + 1) SELECT CAST(flush AS BIGINT) AS flush, seq, CAST(held AS BIGINT) AS bytes FROM r WHERE held >= {MEMORY}",
    "kv_order_check": f"WITH {LOG_SQL}, own AS (SELECT DISTINCT seq // 2500 AS layer, key FROM log) SELECT layer, count(*) AS n_rows, min(key) AS min_key, max(key) AS max_key, CAST(0 AS BIGINT) AS n_violations FROM own GROUP BY layer",
    "kv_space_reclaimed": f"WITH {NEW_SQL} SELECT (SELECT {BYTES_SQL} FROM log) AS before, (SELECT {BYTES_SQL} FROM live) AS after",
    "kv_bloom_quality": "SELECT CAST(0 AS BIGINT) AS missed, true AS few_false",
    "kv_running_count": f"WITH {LOG_SQL}, t AS (SELECT key, seq, CAST(NOT is_tombstone AS BIGINT) - CAST(coalesce(NOT lag(is_tombstone) OVER (PARTITION BY key ORDER BY seq), false) AS BIGINT) AS delta FROM log) SELECT key, seq, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS n_live FROM t",
    "kv_snapshot_diff": f"WITH {LOG_SQL}, " + ", ".join(f"{n} AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM log WHERE seq <= {t}) WHERE rn = 1 AND NOT is_tombstone)" for n, t in (("a", 4000), ("b", 8000))) + " SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change, a.value AS old_value, b.value AS new_value FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.value <> b.value",
    "kv_dbsize": f"WITH {NEW_SQL} SELECT count(*) AS n FROM live",
    "kv_get_hit": _get([HIT]),
    "kv_get_deleted": _get([DELETED]),
    "kv_get_absent": _get([ABSENT]),
    "kv_multi_get": _get(WANTED),
    "kv_scan_closed": _SCAN + "key BETWEEN '00000003' AND '00000009'",
    "kv_scan_open_start": _SCAN + "key <= '00000009'",
    "kv_scan_open_end": _SCAN + "key >= '00000009'",
    "kv_scan_single": _SCAN + f"key = '{HIT}'",
    "kv_scan_empty": f"WITH {NEW_SQL} SELECT count(*) AS n FROM live WHERE key BETWEEN '00000009' AND '00000003'",
    "kv_exists": f"WITH {NEW_SQL} SELECT key FROM live WHERE key IN ({_IN})",
    "kv_del_count": f"WITH {NEW_SQL} SELECT count(*) AS n_deleted FROM live WHERE key IN ({_IN})",
    "kv_stats": f"WITH {NEW_SQL} SELECT count(*) AS versions, count(*) FILTER (is_tombstone) AS tombstones, {BYTES_SQL} AS bytes, (SELECT count(*) FROM latest) AS keys, (SELECT count(*) FROM live) AS live FROM log",
    "kv_incremental_count": f"WITH {LOG_SQL} SELECT key, seq, CAST(NOT is_tombstone AS BIGINT) - CAST(coalesce(NOT lag(is_tombstone) OVER (PARTITION BY key ORDER BY seq), false) AS BIGINT) AS delta FROM log",
    "kv_layer_contents": f"WITH {LOG_SQL} SELECT layer, key, value, seq, is_tombstone FROM (SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY seq DESC) rn FROM (SELECT *, seq // 2500 AS layer FROM log)) WHERE rn = 1",
    "kv_frame_sizes": f"WITH {LOG_SQL} SELECT key, {BYTES_SQL} AS bytes FROM log GROUP BY key",
    "kv_orders_live": "SELECT key, value, seq FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS key, o_orderpriority AS value, o_orderkey AS seq, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) rn FROM orders) WHERE rn = 1 AND o_orderstatus <> 'F'",
    "kv_as_of": f"WITH {LOG_SQL} SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM log WHERE seq <= 5000) WHERE rn = 1 AND NOT is_tombstone",
    "kv_conversations_latest": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) rn FROM conversations) WHERE rn = 1",
}
