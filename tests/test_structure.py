import random
import re

import pytest
from pyspark.sql import functions as F
from streams import STRING_EDGE, ints, make, ok, read

from strandloom import core
from strandloom.core import CodecError
from strandloom.operators import structure as op
from strandloom.operators.numeric import Delta, ZigZag

R = random.Random(5)
BYTES = {k: [R.randbytes(8 * k)] for k in range(6)}


def test_records(spark):
    s = make(spark, BYTES, "binary")
    for size in (1, 2, 8):
        c = op.SerialToRecords(size)
        e = c.encode(s)
        assert read(c.decode(e)) == BYTES
        assert read(e["v"]).get(3) == [BYTES[3][0][k : k + size] for k in range(0, 24, size)]
    assert ok(op.SerialToRecords(16).check(s)) == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("width", [8, 16, 32, 64])
def test_numbers(spark, width, big):
    s = make(spark, BYTES, "binary")
    order = "big" if big else "little"
    n = width // 8
    want = {k: [int.from_bytes(v[0][i : i + n], order, signed=width == 64) for i in range(0, 8 * k, n)] for k, v in BYTES.items() if k}
    c = op.SerialToNumbers(width, big, signed=width == 64)
    e = c.encode(s)
    assert read(e["v"]) == want and read(c.decode(e)) == BYTES
    records, r = op.SerialToRecords(n).encode(s)["v"], op.RecordsToNumbers(width, big)
    e = r.encode(records)
    assert read(e["v"]) == want and read(r.decode(e)) == read(records)


def test_strings_and_lengths(spark):
    c = op.SeparateStrings()
    e = c.encode(make(spark, STRING_EDGE, "string"))
    assert read(c.decode(e)) == STRING_EDGE
    assert read(e["lengths"])[2] == [2, 3, 3, 1, 4, 8]
    short = make(spark, {0: [b"abc"]}, "binary")
    assert ok(op.SetStringLengths().check(short, make(spark, {0: [1, 1]}))) == {0: False}
    assert read(op.SetStringLengths().encode(short, make(spark, {0: [1, 0, 2]}))["v"])[0] == [b"a", b"", b"bc"]


@pytest.mark.parametrize("width", [16, 32, 64])
def test_transpose(spark, width):
    chunks = ints(2, width)
    c = op.TransposeSplit(width)
    assert read(c.decode(c.encode(make(spark, chunks)))) == chunks


def test_split_by_struct(spark):
    chunks = {0: [R.randbytes(7) for _ in range(5)], 1: [b"1234567"]}
    c = op.SplitByStruct([4, 1, 2])
    s = make(spark, chunks, "binary")
    e = c.encode(s)
    assert read(c.decode(e)) == chunks and read(e["field_1"])[1] == [b"5"]
    assert ok(op.SplitByStruct([4, 4]).check(s)) == {0: False, 1: False}


def test_split_n(spark):
    chunks = {0: list(range(10)), 1: list(range(20, 30))}
    for sizes in ([3, 7], [2, 5, 0], [10], [0]):
        c = op.SplitN(sizes)
        assert all(ok(c.check(make(spark, chunks))).values())
        assert read(c.decode(c.encode(make(spark, chunks)))) == chunks
    assert not ok(op.SplitN([3, 3]).check(make(spark, chunks)))[0]
    with pytest.raises(CodecError):
        op.SplitN([0, 3])
    got = op.split_with(lambda v: [1, len(v) - 1], make(spark, chunks))["segments"]
    assert {(r.segment, r["count"]) for r in got.groupBy("segment").count().collect()} == {(0, 2), (1, 18)}


def test_dispatch(spark):
    chunks = ints(9)
    s = make(spark, chunks)
    tags = make(spark, {k: [(x * 7 + 3) % 4 for x in range(len(v))] for k, v in chunks.items()})
    c = op.DispatchByTag(5)
    e = c.encode(s, tags)
    assert read(c.decode(e)) == chunks
    assert read(e["tag_4"]) == {}
    assert not any(ok(op.DispatchByTag(1).check(s, tags.where("pos > 0 OR chunk_id > 0"))).values())
    segments = spark.createDataFrame([(0, 0, (2, 1)), (0, 1, (0, 0)), (0, 2, (3, 0))], "chunk_id long, pos long, v struct<size:long,tag:long>")
    assert read(op.segments_to_tags(segments))[0] == [1, 1, 0, 0, 0]
    with pytest.raises(CodecError):
        op.DispatchString(2049)


def test_concat_and_interleave(spark):
    a, b, c = ints(1), {k: v for k, v in ints(2).items() if k != 3}, ints(3)
    x = op.Concat()
    assert [read(d) for d in x.decode(x.encode(*(make(spark, y) for y in (a, b, c))))] == [a, b, c]
    with pytest.raises(CodecError):
        x.encode(make(spark, a), make(spark, STRING_EDGE, "string"))
    other = {k: [y + "'" for y in v] for k, v in STRING_EDGE.items()}
    i = op.Interleave()
    pair = make(spark, STRING_EDGE, "string"), make(spark, other, "string")
    assert [read(d) for d in i.decode(i.encode(*pair))] == [STRING_EDGE, other]
    assert not ok(i.check(pair[0], pair[1].where("pos = 0")))[1]


def test_n_to_n_and_split(spark):
    s = make(spark, {0: [1, 4, 9]})
    assert read(op.n_to_n([s, s], [Delta(), ZigZag()])[0]["deltas"])[0] == [3, 5]
    assert read(op.split_to(op.SplitN([1, 2]).encode(s), [ZigZag(), Delta()])["segment_1"]["deltas"])[0] == [5]


def test_a_long_chunk_is_concatenated_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(core, "STRETCH_BITS", 4)
    chunks = [{0: list(range(n)), 1: [n]} for n in (500, 16, 333)]
    c = op.Concat()
    e = c.encode(*(make(spark, x) for x in chunks))
    assert read(e["v"]) == {0: [v for x in chunks for v in x[0]], 1: [500, 16, 333]}
    assert [read(x) for x in c.decode(e)] == chunks
    numbered = re.findall(r"row_number\(\) windowspecdefinition\((.*?) ASC", e["v"]._jdf.queryExecution().executedPlan().toString())
    assert numbered and all("stretch" in w for w in numbered)
    gaps = make(spark, {0: list(range(100))}).where("pos % 3 = 0")  # places with gaps are closed
    assert read(c.encode(gaps, gaps)["v"]) == {0: 2 * list(range(0, 100, 3))}


@pytest.mark.parametrize("codec, n", [(op.TransposeSplit(64), 8), (op.TransposeSplit(32), 4), (op.SplitByStruct([1, 2, 5]), 3)])
def test_streams_are_dealt_before_they_are_put_together(spark, codec, n):
    d = spark.createDataFrame([(k, R.randbytes(8)) for k in range(300)], "k long, b binary")
    value = "b" if isinstance(codec, op.SplitByStruct) else "k"
    s = core.stream(d, value, "k", F.floor(F.col("k") / 100))
    back = codec.decode(codec.encode(s))
    union = back._jdf.queryExecution().executedPlan().toString().partition("Union\n")[2]
    assert len(re.findall(r"[:+]- Exchange hashpartitioning\(chunk_id#\d+L?, pos#\d+L?, \d+\), REPARTITION_BY_COL", union)) == n  # no task sorts every stream's chunks
    assert read(back) == read(s)
