import io
import json
import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions import bloom, frames, wire
from strata.functions.wire import Reply


@given(st.lists(st.tuples(st.binary(max_size=300), st.none() | st.binary(max_size=300), st.integers(0, 2**64 - 1)), max_size=5))
def test_frames_round_trip(records):
    data = b"".join(frames.encode(*r) for r in records)
    assert frames.decode_all(data, sealed=True) == (records, len(data))
    assert len(data) == sum(frames.HEADER_BYTES + len(k) + len(v or b"") for k, v, _ in records)


def test_frames_reject_damage_and_cut_torn_ends():
    one, two = frames.encode(b"key", b"value", 5), frames.encode(b"k", None, 6)
    for i in range(len(one)):
        with pytest.raises(frames.FrameError):
            frames.decode_all(one[:i] + bytes([one[i] ^ 1]) + one[i + 1 :] + two, sealed=True)
    for cut in range(1, len(two)):
        # A tear just behind a header is a tear too.
        assert frames.decode_all(one + two[:cut], sealed=False) == ([(b"key", b"value", 5)], len(one))
        with pytest.raises(frames.TornFrame):
            frames.decode_all(one + two[:cut], sealed=True)
    with pytest.raises(frames.FrameError):
        frames.encode(b"k" * 65537, b"", 0)
    with pytest.raises(frames.FrameError):
        frames.decode(struct.pack(">IQII", 0, 0, 70000, 1) + b"x" * 80000)


def test_frame_column_equals_codec(spark):
    rows = [(bytearray(k), None if v is None else bytearray(v), ts) for k, v, ts in ((b"a", b"b", 1), (b"", b"", 0), (b"\x00\xff", None, 1 << 40), (b"k" * 300, b"v" * 70000, 7))]
    df = spark.createDataFrame(rows, "key binary, value binary, ts long").withColumn("f", frames.frame(F.col("key"), F.col("value"), F.col("ts")))
    for r in df.collect():
        body = bytes(r.f)
        assert body == frames.encode(bytes(r.key), None if r.value is None else bytes(r.value), r.ts) and zlib.crc32(body[4:]) == struct.unpack(">I", body[:4])[0]


def test_bloom_finds_all_and_few_others(spark):
    added = spark.range(1000).select(F.concat(F.lit("present-"), F.col("id").cast("string")).alias("key"))
    other = spark.range(10_000).select(F.concat(F.lit("absent-"), F.col("id").cast("string")).alias("key"))
    bits, n = bloom.build(added)
    assert n == 10_000 and bloom.size(0) == 16 and bloom.size(3) == 32
    assert bloom.probe(added, bits, n).filter("maybe").count() == 1000
    assert bloom.probe(other, bits, n).filter("maybe").count() <= 300
    again, m = bloom.from_bytes(spark, bloom.to_bytes(bits, n))
    assert m == n and sorted(r.bit for r in again.collect()) == sorted(r.bit for r in bits.collect())
    assert bloom.probe(other.limit(5), *bloom.build(added.limit(0))).filter("maybe").count() == 0


@given(st.recursive(st.builds(Reply, st.just("integer"), st.integers(-(2**63), 2**63 - 1)) | st.builds(Reply, st.just("bulk"), st.none() | st.binary()) | st.builds(Reply, st.just("simple"), st.text("abc ", max_size=9)), lambda x: st.builds(Reply, st.just("array"), st.lists(x, max_size=3)), max_leaves=5))
def test_replies_round_trip(reply):
    assert wire.Reader(io.BytesIO(wire.encode(reply))).reply() == reply


def test_commands_on_the_wire():
    read = lambda data: wire.Reader(io.BufferedReader(io.BytesIO(data)))
    assert read(wire.command(b"SET", b"k\r\n", b"")).args() == [b"SET", b"k\r\n", b""]
    assert read(b"set  k 'v w'\r\n").args() == [b"set", b"k", b"'v", b"w'"] and read(b"\r\n").args() == []
    assert wire.encode(Reply("error", "no\nsuch")) == b"-ERR no such\r\n" and wire.encode(Reply("bulk", None)) == b"$-1\r\n"
    for bad in (b"*x\r\n", b"*1\r\n:5\r\n", b"*-1\r\n"):
        with pytest.raises(wire.WireError):
            read(bad).args()
    for cut in (b"", b"*2\r\n$1\r\na\r\n", b"*1\r\n$5\r\nab"):
        with pytest.raises(EOFError):
            read(cut).args()
    assert json.dumps(read(b"-ERR x\r\n").reply()) == '["error", "ERR x"]'
