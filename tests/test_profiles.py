import json

import pytest
from streams import ints, make, naturals, read
from test_text_sources import CSV, json_texts

from strandloom.__main__ import main
from strandloom.operators import backends, numeric
from strandloom.plans import graph, profiles, search


@pytest.mark.parametrize("name", ["delta_huffman", "delta_flatpack", "delta_zstd", "delta_field_lz", "range_pack_zstd", "tokenize_delta_field_lz"])
def test_fixed_pipelines(spark, name):
    chunks = ints(3)
    assert read(graph.encode(graph.PROFILES[name], make(spark, chunks)).decode()) == chunks


@pytest.mark.parametrize("mode", ["any", "huffman", "fse"])
def test_entropy_coder(spark, mode):
    chunks = {k: [x % 256 for x in v] for k, v in naturals(256, 5).items()} | {50: [3], 51: [9] * 400, 52: [0, 200] * 500, 53: list(range(256)) * 3, 54: [min(255, k * k % 17) for k in range(900)]}
    s = make(spark, chunks)
    c = backends.Entropy(mode)
    e = c.encode(s)
    assert read(c.decode(e)) == chunks
    assert len({r.way for r in e.header.collect()}) > 2
    assert read(graph.encode(graph.node("entropy"), s).decode()) == chunks


def test_colours(spark):
    r, g, b = ({0: [x % 256 for x in naturals(256, k)[0]][:5]} for k in (1, 2, 3))
    n = min(len(x[0]) for x in (r, g, b))
    rgb = [{0: x[0][:n]} for x in (r, g, b)]
    c = numeric.YCoCg()
    e = c.encode(*(make(spark, x) for x in rgb))
    assert [read(x) for x in c.decode(e)] == rgb


def test_learned_routes(spark):
    chunks = {0: [k * 9 for k in range(300)], 1: [(k * 7919) % 1009 for k in range(300)], 2: [4]}
    model = {"features": search.FEATURES, "labels": ["a", "b"], "forests": [[[{"feature": 5, "value": 1.0, "left": 1, "right": 2, "missing": 1}, {"feature": -1, "value": -1.0}, {"feature": -1, "value": 1.0}]]]}
    g = graph.learned(model, {"a": graph.node("store"), "b": graph.node("delta", {"deltas": graph.slot("x")})})
    frame = graph.encode(graph.replace(g, "x", graph.node("zigzag")), make(spark, chunks))
    assert read(frame.decode()) == chunks
    assert {r.chunk_id: r.way for r in frame.headers["/route"].collect()} == {0: 1, 1: 1, 2: 0}


def test_checksums(spark):
    chunks = ints(4)
    frame = graph.encode(graph.PROFILES["le-i64"], make(spark, chunks))
    sums = frame.checksums()
    assert frame.differences(sums).count() == 0
    other = graph.encode(graph.PROFILES["le-i64"], make(spark, {**chunks, 0: [6]}))
    assert {r.path for r in other.differences(sums).collect()} == {"#"}


def test_csv_and_json_inputs(spark):
    for texts, there, back in ((CSV, profiles.csv_frames, profiles.csv_back), (json_texts()[2:60], profiles.json_frames, profiles.json_back)):
        texts = [t for t in texts if t and all(c < 128 for c in t)]
        chunks = {k: [t] for k, t in enumerate(texts)}
        assert read(back(*there(make(spark, chunks, "binary")))) == chunks


def test_command_line(spark, tmp_path, capsys):
    make(spark, {0: list(range(0, 900, 3))}).selectExpr("pos AS k", "v").write.parquet(f"{tmp_path}/t")
    where = ["--table", f"{tmp_path}/t", "--value", "v", "--key", "k", "--chunk", "100"]
    assert main(["profiles"]) == main(["encode", "--profile", "sorted", "--to", f"{tmp_path}/f", *where]) == main(["decode", "--frame", f"{tmp_path}/f", "--to", f"{tmp_path}/o"]) == 0
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/o").collect()) == list(range(0, 900, 3))
    capsys.readouterr()
    main(["inspect", "--frame", f"{tmp_path}/f"])
    assert json.loads(capsys.readouterr().out)["plan"]["codec"] == "delta"
    main(["bench", "--profile", "serial,sorted".split(",")[1], *where])
    assert json.loads(capsys.readouterr().out)["rows"] == 300
    main(["train", "--generations", "0", "--to", f"{tmp_path}/g", *where])
    made = json.loads(spark.read.text(f"{tmp_path}/g").first().value)
    assert made["columns"] == ["v"] and made["groups"] == [[0]] and made["fronts"][0]["bytes"] > 0
    capsys.readouterr()
    main(["dump", "--frame", f"{tmp_path}/f", "--to", f"{tmp_path}/d"])
    assert {json.loads(x)["kind"] for x in capsys.readouterr().out.splitlines()} == {"stream", "header"}
