import random

import pytest
from pyspark.sql import functions as F

from strata.operators import kv
from strata.sources import manifest as m
from strata.sources.store import Options, Store, order_violations

OPS = "key binary, value binary, is_tombstone boolean, at long"
TINY = Options(max_segment_bytes=1024, max_mem_bytes=1 << 30)


def batch(spark, ops):
    """Rows of (key, value or None to delete), in order."""
    rows = [(bytearray(k), None if v is None else bytearray(v), v is None, i) for i, (k, v) in enumerate(ops)]
    return spark.createDataFrame(rows, OPS)


def contents(store, start=None, end=None):
    return [(bytes(r.key), bytes(r.value)) for r in store.scan(start, end).collect()]


def test_set_get_delete_reopen(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    for k, v in ((b"a", b"1"), (b"b", b"2"), (b"a", b"3"), (b"empty", None)):
        s.set(k, v)
    s.delete(b"b")
    s.delete(b"never")
    assert (s.get(b"a"), s.get(b"b"), s.get(b"empty"), len(s)) == (b"3", None, b"", 2)
    s.close()
    with pytest.raises(ValueError):
        s.set(b"x", b"y")
    again = Store(spark, f"{tmp_path}/s")
    again.set(b"b", b"back")
    assert contents(again) == [(b"a", b"3"), (b"b", b"back"), (b"empty", b"")]


def test_keys_are_ordered_bytes(spark, tmp_path):
    s, keys = Store(spark, f"{tmp_path}/s"), [b"", b"a", b"a\x00", b"a\x00b", b"a" * 100, b"a" * 100 + b"b", b"\x7f", b"\x80", b"\xff"]
    s.apply(batch(spark, [(k, k) for k in reversed(keys)]))
    s.flush()
    assert contents(s) == [(k, k) for k in sorted(keys)]
    assert [k for k, _ in contents(s, b"a\x00", b"\x7f")] == [b"a\x00", b"a\x00b", b"a" * 100, b"a" * 100 + b"b", b"\x7f"]
    assert contents(s, b"z", b"b") == [] and contents(s, b"b", b"c") == []


def test_limits_are_checked_before_any_write(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    before = s.files.names()
    for bad in ([(b"k" * 65537, b"v")], [(b"a", b"1"), (b"k" * 65537, None)]):
        with pytest.raises(ValueError):
            s.apply(batch(spark, bad))
    with pytest.raises(ValueError, match="null"):
        s.put_many(spark.createDataFrame([(None, bytearray(b"v"))], "key binary, value binary"))
    with pytest.raises(ValueError, match="order"):
        s.put_many(spark.createDataFrame([(bytearray(b"k"), bytearray(b"v"))] * 2, "key binary, value binary"))
    assert s.files.names() == before
    s.apply(batch(spark, [(b"k" * 65536, b"v")]))
    assert len(s) == 1


@pytest.mark.parametrize("seed", [7, 42])
def test_model_with_flushes_merges_and_reopens(spark, tmp_path, seed):
    rng, model, s = random.Random(seed), {}, Store(spark, f"{tmp_path}/s", TINY)
    for step in range(8):
        ops = []
        for _ in range(rng.randint(1, 120)):
            k = bytes([97 + rng.randrange(20)])
            v = None if rng.random() < 0.3 else b"v%d" % rng.randrange(1000)
            ops.append((k, v))
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        s.apply(batch(spark, ops))
        match step:
            case 1 | 3 | 5:
                s.flush()
            case 2 | 6:
                s.compact()
            case 4:
                s.compact_tables()
        if step % 3 == 2:
            s = Store(spark, f"{tmp_path}/s", TINY)
        assert dict(contents(s)) == model and len(s) == len(model)
    low, high = sorted(bytes([97 + rng.randrange(20)]) for _ in "ab")
    assert contents(s, low, high) == sorted((k, v) for k, v in model.items() if low <= k <= high)
    s.flush()
    s.compact_tables()
    assert s.table_count() == 1 and dict(contents(Store(spark, f"{tmp_path}/s"))) == model
    assert s.table(s.now.tables[0]).filter("is_tombstone").count() == 0


def test_a_delete_outlives_log_merges_over_tables(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", Options(max_segment_bytes=1))
    s.set(b"k", b"old")
    s.flush()
    s.delete(b"k")
    s.set(b"other", b"x")
    s.compact()
    assert s.segment_count() == 2 and s.get(b"k") is None
    assert Store(spark, f"{tmp_path}/s").get(b"k") is None


def test_rollover_then_reopen_keeps_tables(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", Options(max_segment_bytes=1))
    s.set(b"k", b"v")
    s.flush()
    s.set(b"a", b"1")
    s.set(b"b", b"2")
    assert s.segment_count() == 2
    assert contents(Store(spark, f"{tmp_path}/s")) == [(b"a", b"1"), (b"b", b"2"), (b"k", b"v")]


def test_flush_by_size_and_merges_without_work(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", Options(max_mem_bytes=8))
    s.compact()
    s.compact_tables()
    s.flush()
    assert (s.table_count(), s.segment_count(), s.now.version) == (0, 1, 1)
    s.apply(batch(spark, [(b"key", b"12345"), (b"gone", None)]))
    assert s.table_count() == 1 and s.now.mem_bytes == 0
    assert s.table(s.now.tables[0]).count() == 2 and order_violations(s.table(s.now.tables[0])) == 0
    s.delete(b"x" * 7)
    assert s.table_count() == 2
    s.compact_tables()
    usage = s.disk_usage()
    assert s.table_count() == 1 and usage["log"] == 0 and usage["tables"] > 0 and s.stats()["keys"] == 1


def test_merges_reclaim_space(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", TINY)
    for _ in range(3):
        s.apply(batch(spark, [(b"k%d" % i, b"v" * 200) for i in range(5)] * 4))
    before = s.disk_usage()["log"]
    s.compact()
    assert s.disk_usage()["log"] < before and len(s) == 5


def test_crashed_write_and_leftovers(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.set(b"a", b"1")
    # A batch whose commit never came.
    kv.changelog(spark.range(3), F.col("id").cast("string").cast("binary"), F.lit(b"x"), F.col("id"), F.lit(False)).withColumn("ts", F.lit(0).cast("long")).write.parquet(f"{tmp_path}/s/log-dead")
    assert contents(s) == [(b"a", b"1")]
    again = Store(spark, f"{tmp_path}/s")
    assert "log-dead" not in again.files.names() and contents(again) == [(b"a", b"1")]


def test_a_second_writer_fails_and_changes_nothing(spark, tmp_path):
    one = Store(spark, f"{tmp_path}/s")
    two = Store(spark, f"{tmp_path}/s")
    one.set(b"a", b"1")
    with pytest.raises(FileExistsError):
        two.set(b"a", b"2")
    assert Store(spark, f"{tmp_path}/s").get(b"a") == b"1"


def test_snapshots_stay(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.apply(batch(spark, [(b"a", b"1"), (b"b", b"2")]))
    seen, at = s.scan(), s.now.next_seq - 1
    s.apply(batch(spark, [(b"a", None), (b"c", b"3")]))
    s.flush()
    assert [bytes(r.key) for r in seen.collect()] == [b"a", b"b"] and [k for k, _ in contents(s)] == [b"b", b"c"]
    assert s.as_of(at).count() == 1  # the flush dropped the older version of a


def test_damaged_manifests_are_errors(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    for bad in (b"junk", b"{}", s.now.encode().replace(b"next_seq", b"next_sex")):
        s.files.create(m.name(2), bad)
        with pytest.raises(m.ManifestError):
            Store(spark, f"{tmp_path}/s")
        s.files.delete(m.name(2))
    for wrong in (dict(segments=()), dict(segments=(m.Segment(1), m.Segment(1))), dict(next_id=1), dict(segments=(m.Segment(3), m.Segment(1)), next_id=9)):
        with pytest.raises(m.ManifestError):
            m.Manifest(version=1, **wrong).encode()
    assert m.Manifest.decode(s.now.encode()) == s.now


def test_key_filters_reach_every_scan(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.apply(batch(spark, [(b"k%02d" % i, b"v") for i in range(20)]))
    s.flush()
    s.apply(batch(spark, [(b"z", b"v")]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan(s.find(b"k07")) and s.get(b"k07") == b"v"
    both = plan(s.scan(b"k03", b"k05"))
    assert "GreaterThanOrEqual(key" in both and "LessThanOrEqual(key" in both
    # A table wholly outside the bounds is not read at all.
    assert len(s.scan(b"y", None).inputFiles()) < len(s.scan().inputFiles())


def test_multi_get_and_exists(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.apply(batch(spark, [(b"a", b"1"), (b"b", b"2"), (b"b", None)]))
    asked = s._keys([b"a", b"b", b"c", b"a"])
    assert {(bytes(r.key), r.found) for r in s.multi_get(asked).collect()} == {(b"a", True), (b"b", False), (b"c", False)}
    assert [bytes(r.key) for r in s.exists(asked).collect()] == [b"a"]
