import threading

import pytest
from pyspark.sql import functions as F

from strata.functions.wire import OK, Reply
from strata.plans.commands import Client, CommandError, Server, console, run
from strata.sources.store import Options, Store
from strata.streaming.live import into_store, live_stream


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/s", Options(max_segment_bytes=1))


def test_each_command(store):
    do = lambda *a: run(store, list(a))
    assert do(b"ping") == Reply("simple", "PONG") and do(b"PING", b"hi") == Reply("bulk", b"hi")
    assert do(b"SET", b"k", b"") == OK and do(b"GET", b"k") == Reply("bulk", b"") and do(b"GET", b"x") == Reply("bulk", None)
    do(b"SET", b"a", b"1")
    assert do(b"SCAN") == Reply("array", [Reply("bulk", x) for x in (b"a", b"1", b"k", b"")])
    assert len(do(b"SCAN", b"b", b"", b"more").value) == 2 and do(b"SCAN", b"x").value == []
    assert do(b"DEL", b"a", b"a", b"none") == Reply("integer", 1) and do(b"DBSIZE") == Reply("integer", 1)
    assert do(b"COMPACT") == OK and do(b"COMPACT-SST") == Reply("simple", "OK sstables=0")
    assert do(b"nope") == Reply("error", "unknown command 'NOPE'")
    for bad in ([b"SET", b"k"], [b"GET"], [b"GET", b"a", b"b"], [b"DEL"], [b"SET", b"k" * 65537, b"v"]):
        assert run(store, bad).kind == "error"


def test_console(store):
    assert console(store, "set k a value") == "OK" and console(store, "get k") == '"a value"' and console(store, "get x") == "(nil)"
    assert console(store, "scan a") == '"k" -> "a value"\n(1 keys)' and console(store, "keys") == "1"
    assert console(store, "stats").startswith("keys=1 segments=1 sstables=0") and console(store, "delete k") == "OK"
    assert console(store, "get").startswith("usage") and "unknown" in console(store, "what") and "scan" in console(store, "help")
    assert console(store, "compact") == "OK" and console(store, "compact-sst") == "OK (sstables=0)" and console(store, "exit") is None


def test_clients_over_a_socket(store):
    with Server(store) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        one, two = Client(server.server_address), Client(server.server_address)
        assert one.ping() == "PONG"
        work = [threading.Thread(target=c.set, args=(k, b"\r\n\x00")) for c, k in ((one, b"a"), (two, b"b"), (one, b"c"))]
        [t.start() for t in work]
        [t.join() for t in work]
        assert two.scan(b"b") == [(b"b", b"\r\n\x00"), (b"c", b"\r\n\x00")] and one.dbsize() == 3 and two.get(b"none") is None
        assert one.delete(b"a", b"none") == 1 and one.compact() is None and two.compact_tables() == "OK sstables=0"
        with pytest.raises(CommandError, match="unknown"):
            one.call(b"FLY")
        one.close()
        two.close()
        server.shutdown()


def test_streams_into_a_view_and_a_store(spark, store, tmp_path):
    rows = [("a", "1", 1, False), ("a", None, 2, True), ("b", "2", 3, False), ("b", "3", 4, False)]
    spark.createDataFrame(rows, "key string, value string, seq long, is_tombstone boolean").write.parquet(f"{tmp_path}/log")
    log = spark.readStream.schema("key string, value string, seq long, is_tombstone boolean").parquet(f"{tmp_path}/log")
    query = live_stream(log).writeStream.format("memory").queryName("live_view").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("live_view").collect()] == [("b", "3", 4)]
    query = into_store(log.withColumn("at", F.col("seq")), store, f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert store.get(b"b") == b"3" and store.get(b"a") is None
