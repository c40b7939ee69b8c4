import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from streams import make, read

from strandloom.core import CodecError
from strandloom.operators import nested, relational
from strandloom.sources import files, messages
from strandloom.streaming import chunks

R = random.Random(9)
POINT = {1: "sint32", 2: "double"}
SCHEMA = {1: "int32", 2: "int64", 3: "uint32", 4: "uint64", 5: "bool", 6: "enum", 7: "string", 8: "float", 9: "fixed64", 10: "sfixed32", 11: POINT, 12: "bytes"}


def field(number, wire, payload):
    return messages.to_varint(number << 3 | wire) + payload


def message():
    out = b""
    for _ in range(R.randrange(12)):
        n = R.randrange(1, 13)
        if n in (1, 2, 3, 4, 6):
            out += field(n, 0, messages.to_varint(R.getrandbits(R.choice([3, 31, 64]))))
        elif n == 5:
            out += field(n, 0, bytes([R.randrange(2)]))
        elif n in (7, 12):
            x = R.randbytes(R.randrange(200))
            out += field(n, 2, messages.to_varint(len(x)) + x)
        elif n in (8, 10):
            out += field(n, 5, R.randbytes(4))
        elif n == 9:
            out += field(n, 1, R.randbytes(8))
        else:
            x = field(1, 0, messages.to_varint(R.getrandbits(20))) + field(2, 1, struct.pack("<d", 1.5))
            out += field(n, 2, messages.to_varint(len(x)) + x)
    return out


def test_protocol_buffers(spark):
    chunks_ = {0: [message() for _ in range(60)], 1: [b""], 2: [message()]}
    m = messages.Messages(SCHEMA)
    e = m.encode(make(spark, chunks_, "binary"))
    assert read(m.decode(e)) == chunks_
    one = m.encode(make(spark, {0: [field(1, 0, b"\x05") + field(7, 2, b"\x02hi")]}, "binary"))
    assert read(m.stream(one, "int32"))[0] == [5] and read(m.stream(one, "string"))[0] == [b"hi"] and read(m.stream(one, "length"))[0] == [2]


@pytest.mark.parametrize("data", [b"\x08", b"\x08\x80\x00", b"\x7a\x00", b"\x08\x01\x3a\x05a", b"\x0d\x00\x00\x00\x00", b"\x28\x02"])
def test_other_protocol_buffers_are_errors(data):
    with pytest.raises(CodecError):
        messages.proto_read(data, SCHEMA, {n: [] for n in messages.PROTO_STREAMS})


def thrift():
    z = lambda x: messages.to_varint(messages.zigzag(x))
    inner = b"\x11" + b"\x12" + b"\0"
    return b"\x15" + z(-7) + b"\x06" + z(400) + z(1 << 40) + b"\x18\x03abc" + b"\x19\xf5\x10" + b"".join(z(k) for k in range(16)) + b"\x1b\x02\x5c" + z(1) + inner + z(2) + inner + b"\x1b\x00" + b"\x17" + struct.pack("<d", 2.5) + b"\x1a\x21\x01\x02" + b"\x13\x09" + b"\x1c" + inner + b"\0"


def test_compact_thrift(spark):
    m = messages.Messages()
    chunks_ = {0: [thrift(), b"\0", thrift()], 1: [b"\0"]}
    e = m.encode(make(spark, chunks_, "binary"))
    assert read(m.decode(e)) == chunks_
    assert read(m.stream(e, "i32"))[0][:3] == [-7, 0, 1] and read(m.stream(e, "binary"))[0] == [b"abc"] * 2
    for bad in (b"", b"\x15", b"\x10", b"\0x", b"\x1f\0", b"\x18\x05a\0"):
        with pytest.raises(CodecError):
            messages.thrift_read(bad, messages.Parts(messages.THRIFT_STREAMS))


def test_binary_thrift_and_paths(spark):
    def text(x):
        return struct.pack(">i", len(x)) + x

    inner = b"\x02" + struct.pack(">hB", 1, 1) + b"\0"
    whole = (
        b"\x08" + struct.pack(">hi", 1, -7) + b"\x0b" + struct.pack(">h", 2) + text("né".encode()) + b"\x04" + struct.pack(">hd", 3, -2.5) + b"\x0f" + struct.pack(">hBi", 4, 10, 3) + struct.pack(">qqq", 5, -6, 7)
        + b"\x0d" + struct.pack(">hBBi", 5, 6, 12, 2) + struct.pack(">h", 9) + inner + struct.pack(">h", -9) + inner + b"\x0e" + struct.pack(">hBi", 6, 3, 1) + b"\xff" + b"\x0c" + struct.pack(">h", 7) + inner + b"\0"
    )
    chunks_ = {0: [whole, b"\0", whole], 1: [b"\0"]}
    for paths in (None, {"mine": (1,), "elements": (4, messages.ELEMENT), "keys": (5, messages.KEY), "deep": (5, messages.VALUE, 1), "texts": (2,)}):
        m = messages.Messages(protocol="binary", paths=paths)
        e = m.encode(make(spark, chunks_, "binary"))
        assert read(m.decode(e)) == chunks_
        if paths:
            assert read(m.stream(e, "elements"))[0] == [5, -6, 7] * 2 and read(m.stream(e, "keys"))[0] == [9, -9] * 2 and read(m.stream(e, "deep"))[0] == [1] * 4
            assert read(m.stream(e, "texts", "binary"))[0] == ["né".encode()] * 2 and read(m.stream(e, "bool"))[0] == [1] * 2
    for bad in (b"", b"\x08\0\x01\0", whole[:-1], whole + b"x", b"\x0b" + struct.pack(">hi", 1, -1) + b"\0", b"\x01\0\x01\0"):
        with pytest.raises(CodecError):
            messages.binary_read(bad, messages.Parts(messages.BINARY_STREAMS))
    with pytest.raises(CodecError):
        messages.Messages(protocol="other")


def test_paths_of_compact_thrift(spark):
    chunks_ = {0: [thrift(), b"\0", thrift()]}
    m = messages.Messages(paths={"first": (1,), "long list": (202, messages.ELEMENT)})
    e = m.encode(make(spark, chunks_, "binary"))
    assert read(m.decode(e)) == chunks_ and read(m.stream(e, "first"))[0] == [-7] * 2


def test_feature_maps(spark):
    """Maps by kind, wherever they are in a record but within maps; the rest and the separators as they are."""
    z = lambda x: messages.to_varint(messages.zigzag(x))
    floats = b"\x02\x5d" + z(1) + struct.pack(">f", 1.5) + z(2) + struct.pack(">f", 2.5)
    lists = b"\x02\x59" + z(7) + b"\x26" + z(1) + z(2) + z(8) + b"\x06"
    nested_lists = b"\x01\x59" + z(3) + b"\x29" + b"\x06" + b"\x16" + z(4)
    scores = b"\x01\x5b" + z(3) + b"\x01\x6d" + z(9) + struct.pack(">f", 0.5)
    texts = b"\x01\x58" + z(1) + b"\x02ab"
    record = b"\x80\0" + b"\x1b" + floats + b"\x1b" + lists + b"\x1c" + b"\x1b" + nested_lists + b"\0" + b"\x1b" + scores + b"\x1b" + texts + b"\x1b\0" + b"\0"
    assert [(k, record[a:b]) for k, a, b in messages.feature_stretches(record) if k != messages.OTHER] == [("float", floats), ("id_list", lists), ("id_list_list", nested_lists), ("id_score_list", scores)]
    chunks_ = {0: [record, b"", record + b"\n" + record + b"\0"], 1: [b"\x80\0\0\n"]}
    c = messages.FeatureMaps()
    e = c.encode(make(spark, chunks_, "binary"))
    assert read(c.decode(e)) == chunks_ and read(c.stream(e, "float"))[0] == [floats] * 3
    for bad in (b"x", b"\x80", record[:-1], b"\x80\0\x1b\x01\x5d", b"\x80\0" + b"\x1c" * 40):
        with pytest.raises(CodecError):
            messages.feature_stretches(bad)


@pytest.mark.parametrize("kind, values", [
    ("array<int>", [[1, 2], [], [3], None and [], [4, 5, 6]]), ("array<array<bigint>>", [[[1], []], [], [[2, 3], [4]]]), ("map<int,float>", [{1: 0.5, 2: 1.5}, {}, {7: 2.0}]),
    ("map<int,array<bigint>>", [{1: [1, 2], 3: []}, {}, {2: [9]}]), ("map<int,map<bigint,float>>", [{1: {5: 0.5}, 2: {}}, {3: {1: 1.0, 2: 2.0}}]), ("map<int,array<array<bigint>>>", [{1: [[1], [2, 3]]}, {4: []}]),
])
def test_nested(spark, kind, values):
    values = [v for v in values if v is not None]
    chunks_ = {0: values, 1: values[:1], 2: values[::-1]}
    n = nested.Nested()
    assert read(n.decode(n.encode(make(spark, chunks_, kind)))) == chunks_


def test_joins(spark):
    left = [(k, R.randrange(3), R.randrange(100)) for k in range(60)]
    right = [(R.randrange(3), R.randrange(100), j) for j in range(30)]
    right = list({(b, t): (b, t, v) for b, t, v in right}.values())
    want = {k: max(((t2, v) for b2, t2, v in right if b2 == b and t2 <= t), default=(0, None))[1] for k, b, t in left}
    got = relational.asof_join(spark.createDataFrame(left, "k int, b int, t int"), spark.createDataFrame(right, "b int, t int, v int"), "b", "t", "v")
    assert {r.k: r.v for r in got.collect()} == want
    spans = [(j, s, s + R.randrange(0, 40)) for j in range(20) for s in [R.randrange(100)]]
    got = relational.interval_join(spark.createDataFrame(left, "k int, b int, t int"), spark.createDataFrame(spans, "j int, s int, e int"), "t", "s", "e", 7)
    assert sorted((r.k, r.j) for r in got.collect()) == sorted((k, j) for k, _, t in left for j, s, e in spans if s <= t < e)


def test_full_buckets_of_intervals_are_cut(spark, monkeypatch):
    monkeypatch.setattr(relational, "PART_ROWS", 8)
    monkeypatch.setattr(relational, "TASK_PAIRS", 64)
    points = [(k, 5 if k % 4 else R.randrange(300)) for k in range(400)] + [(400, None)]
    spans = [(j, s, s + R.choice([0, 3, 30, 200])) for j in range(60) for s in [R.randrange(12) if j % 3 else R.randrange(300)]]
    p, i = spark.createDataFrame(points, "k int, t int"), spark.createDataFrame(spans, "j int, s int, e int")
    want = sorted((k, j) for k, t in points if t is not None for j, s, e in spans if s <= t < e)
    for rows in (100_000, 0):
        monkeypatch.setattr(relational, "BROADCAST_ROWS", max(rows, 1))
        found = relational.interval_join(p, i, "t", "s", "e", 7)
        assert found.columns == ["k", "t", "j", "s", "e"] and sorted((r.k, r.j) for r in found.collect()) == want
    monkeypatch.setattr(relational, "BROADCAST_ROWS", 100_000)
    one = relational.interval_join(p.where("t = 5"), i, "t", "s", "e", 7).select(F.spark_partition_id().alias("task")).distinct().count()
    assert one > 20  # a single value, of one bucket at each of four levels


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack("<3H", 1, 2, 65535))
    got = read(files.integers(files.whole_files(spark, f"file://{tmp_path}", "*.bin"), "le-u16"))
    assert list(got.values()) == [[1, 2, 65535]]
    buffer = io.BytesIO()
    r = np.random.default_rng(1)
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("m/data/0", (1 + r.random(20000)).astype(np.float32).tobytes())
        z.writestr("m/data/1", (1 + r.random(20000)).tobytes())
        z.writestr("m/data.pkl", b"pickle")
        z.writestr("m/packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    s = make(spark, {5: [buffer.getvalue()]}, "binary")
    assert {x.name: x.route for x in files.model_members(s).collect()} == {"m/data/0": "f32", "m/data/1": "f64", "m/data.pkl": "metadata", "m/packed": "precompressed"}
    files.canonical_parquet(spark.range(5), f"file://{tmp_path}/plain")
    assert spark.read.parquet(f"file://{tmp_path}/plain").count() == 5


def test_streams_by_batches(spark, tmp_path):
    rows = [(k, k % 2, k * k) for k in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "t long, k long, x long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("t long, k long, x long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = chunks.encode_to(source, lambda b: b.withColumn("x", F.col("x") + 1), f"{tmp_path}/out", f"{tmp_path}/c1")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.x for r in got.collect()) == sorted(x + 1 for _, _, x in rows) and got.select("batch").distinct().count() == 4
    q = chunks.running_deltas(source, "k", "t", "x").writeStream.format("memory").queryName("deltas").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("deltas").groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n")).collect()
    assert {r.k: (r.v, r.n) for r in got} == {0: (38 * 38, 20), 1: (39 * 39, 20)}


def test_windows_and_sessions(spark):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 2, float(m)) for m in (0, 1, 5, 31, 40, 59)]
    d = spark.createDataFrame(rows, "t string, k int, x double").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.window.start.minute: (r.n, r.low, r.high) for r in chunks.profile(d, "t", "x", "30 minutes").collect()}
    assert got == {0: (3, 0.0, 5.0), 30: (3, 31.0, 59.0)}
    assert chunks.profile(d, "t", "x", "30 minutes", "10 minutes", by="k").count() > 4
    assert sorted((r.k, r.n) for r in chunks.sessions(d, "t", "k", "20 minutes").collect()) == [(0, 1), (0, 1), (1, 1), (1, 1), (1, 2)]
