import pytest
from streams import STRING_EDGE, ints, make, naturals, read

from strandloom.core import Codec, CodecError, Encoded
from strandloom.plans import graph as op


@pytest.mark.parametrize("name", ["le-u64", "le-i64", "sorted", "dictionary", "bytes"])
def test_profiles_of_integers(spark, name):
    chunks = ints(6)
    assert read(op.encode(op.PROFILES[name], make(spark, chunks)).decode()) == chunks


@pytest.mark.parametrize("name", ["strings", "text-column", "serial"])
def test_profiles_of_strings(spark, name):
    kind = "binary" if name == "serial" else "string"
    chunks = {k: [x.encode() if kind == "binary" else x for x in v] for k, v in STRING_EDGE.items()}
    assert read(op.encode(op.PROFILES[name], make(spark, chunks, kind)).decode()) == chunks


def test_frames_are_decoded_without_their_graph(spark, tmp_path):
    chunks = naturals(1000, 4)
    op.encode(op.PROFILES["sorted"], make(spark, chunks)).write(f"{tmp_path}/frame")
    frame = op.Frame.read(spark, f"{tmp_path}/frame")
    assert read(frame.decode()) == chunks
    assert frame.info()["plan"]["codec"] == "delta" and frame.info()["streams"] == {"/deltas/v": "bigint"}


def test_each_chunk_goes_its_own_way(spark):
    chunks = {0: list(range(0, 6000, 2)), 1: [7, 1 << 50] * 800, 2: [5]}
    g = op.choose(op.node("store"), op.node("delta", {"deltas": op.node("zigzag")}), op.node("tokenize"))
    frame = op.encode(g, make(spark, chunks))
    assert read(frame.decode()) == chunks
    ways = {r.chunk_id: r.way for r in frame.headers["/route"].collect()}
    assert ways[0] == 1


def test_checks_decide(spark):
    chunks = {0: [3, 3, 3], 1: [1, 2]}
    g = op.when(op.node("constant"), op.node("constant"), op.node("delta"))
    frame = op.encode(g, make(spark, chunks))
    assert read(frame.decode()) == chunks
    assert {r.chunk_id: r.way for r in frame.headers["/route"].collect()} == {0: 0, 1: 1}
    only = op.choose(op.node("parse_int"), op.node("store"))
    texts = {0: ["1", "2"], 1: ["x"]}
    assert read(op.encode(op.choose(op.node("store"), op.node("store")), make(spark, texts, "string")).decode()) == texts and only


def test_slots_and_names(spark):
    g = op.node("delta", {"deltas": op.slot("place")})
    assert op.replace(g, "place", op.node("zigzag"))["outputs"]["deltas"]["codec"] == "zigzag"
    assert op.unknown_codecs(op.choose(op.node("x"), op.when(op.node("y"), op.node("store", {"v": op.node("z")}), op.node("delta")))) == {"x", "y", "z"}
    with pytest.raises(CodecError):
        op.encode(op.node("x"), make(spark, {0: [1]}))


class Negate(Codec):
    def encode(self, s):
        return Encoded({"v": s.selectExpr("chunk_id", "pos", "-v AS v")})

    def decode(self, enc):
        return self.encode(enc["v"])["v"]


def test_own_codecs(spark):
    op.register("negate", Negate)
    frame = op.encode(op.node("negate"), make(spark, {0: [1, -2]}))
    assert read(frame.streams["/v"])[0] == [-1, 2] and read(frame.decode())[0] == [1, -2]


def test_dump_sizes_and_samples(spark, tmp_path):
    s = make(spark, {0: list(range(50)), 1: [5, 5, 9]})
    g = op.node("delta", {"deltas": op.slot("inner", op.node("zigzag"))})
    frame = op.encode(g, s)
    index = {r.path: r for r in frame.dump(f"{tmp_path}/d").collect()}
    assert (index["/deltas/v"].n, index["/deltas/v"].bytes, index["/deltas/v"].kind) == (51, 408, "stream")
    assert spark.read.parquet(f"{tmp_path}/d/stream=-deltas-v").count() == 51 and spark.read.json(f"{tmp_path}/d/index").count() == len(index)
    assert read(op.samples_at(g, s, "inner")[0]) == {0: [1] * 49, 1: [0, 4]}
    seen = []
    op.encode(g, s, lambda path, node, x: seen.append((path, node["codec"])))
    assert seen == [("", "delta"), ("/deltas", "zigzag")]
