"""Graphs of codecs.

A node is a codec with its parameters and, for each of its outputs, the node that the output goes to; an output
without one is stored.  Nodes are described by name and keywords, so a graph is JSON and a frame carries its own
plan: it is decoded without the graph that made it.

A selector stands where a node may: ``{"choose": [node, ...]}`` takes, for each chunk, the node whose stored form is
smallest (the first of equals), ``{"if": check, "then": node, "else": node}`` follows a codec's own check, and
``{"model": trees, "nodes": {label: node}}`` a learned model over the chunk's features.  All send each chunk its own
way, so encoding stays one lazy plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Codec, CodecError, Encoded
from ..functions.statistics import feature_vector
from ..operators import backends, dictionary, numeric, structure
from ..operators.backends import stored_size
from ..operators.selectors import BoostedTrees

CODECS: dict[str, Callable[..., Codec]] = {
    "store": backends.Store, "delta": numeric.Delta, "zigzag": numeric.ZigZag, "range_pack": numeric.RangePack, "divide_by": numeric.DivideBy, "float_deconstruct": numeric.FloatDeconstruct,
    "merge_sorted": numeric.MergeSorted, "quantize": numeric.Quantize, "bitpack": numeric.BitPack, "parse_int": numeric.ParseInt, "try_parse_int": numeric.TryParseInt, "parse_float": numeric.ParseFloat, "try_parse_float": numeric.TryParseFloat, "tokenize": dictionary.Tokenize,
    "constant": dictionary.Constant, "prefix": dictionary.Prefix, "flatpack": dictionary.FlatPack, "transpose_split": structure.TransposeSplit, "separate_strings": structure.SeparateStrings,
    "split": structure.SplitN, "records": structure.SerialToRecords, "numbers": structure.RecordsToNumbers, "split_by_struct": structure.SplitByStruct, "huffman": backends.Huffman, "fse": backends.Fse,
    "field_lz": backends.FieldLz, "zstd": backends.Zstd, "lz4": backends.Lz4, "entropy": backends.Entropy, "bytes_of": structure.NumbersToSerial,
}


def register(name: str, codec: Callable[..., Codec]) -> None:
    """Make a codec of one's own known to graphs, and to whoever decodes what they made."""
    CODECS[name] = codec


def node(codec: str, outputs: dict | None = None, **params) -> dict:
    return {"codec": codec, "params": params, "outputs": outputs or {}}


def choose(*nodes: dict) -> dict:
    return {"choose": list(nodes)}


def when(check: dict, then: dict, other: dict) -> dict:
    return {"if": check, "then": then, "else": other}


def learned(model: dict, nodes: dict[str, dict]) -> dict:
    return {"model": model, "nodes": nodes}


def unknown_codecs(graph: dict) -> set[str]:
    """Names in a graph that aren't registered."""
    if "model" in graph:
        return set().union(*map(unknown_codecs, graph["nodes"].values()))
    if "choose" in graph:
        return set().union(*map(unknown_codecs, graph["choose"]))
    if "if" in graph:
        return unknown_codecs(graph["if"]) | unknown_codecs(graph["then"]) | unknown_codecs(graph["else"])
    return ({graph["codec"]} - set(CODECS)).union(*map(unknown_codecs, graph["outputs"].values()))


def _make(graph: dict) -> Codec:
    if graph["codec"] not in CODECS:
        raise CodecError(f"no codec {graph['codec']}")
    return CODECS[graph["codec"]](**graph["params"])


class Frame:
    """What a graph makes of a stream: stored streams by path, headers by path, and the plan."""

    def __init__(self, plan: dict, streams: dict[str, DataFrame], headers: dict[str, DataFrame]):
        self.plan, self.streams, self.headers = plan, streams, headers

    def write(self, path: str) -> None:
        """Parquet for each stream and header, and the manifest."""
        for kind, tables in (("stream", self.streams), ("header", self.headers)):
            for name, df in tables.items():
                df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{kind}={_file(name)}")
        spark = next(iter(self.streams.values())).sparkSession
        manifest = json.dumps({"plan": self.plan, "streams": sorted(self.streams), "headers": sorted(self.headers)})
        spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Frame:
        m = json.loads(spark.read.text(f"{path}/manifest").first().value)
        load = lambda kind, name: spark.read.parquet(f"{path}/{kind}={_file(name)}")
        return cls(m["plan"], {n: load("stream", n) for n in m["streams"]}, {n: load("header", n) for n in m["headers"]})

    def info(self) -> dict:
        """What a frame has: its plan, and the streams with their types."""
        return {"plan": self.plan, "streams": {n: s.schema["v"].dataType.simpleString() for n, s in self.streams.items()}, "headers": {n: h.columns for n, h in self.headers.items()}}

    def sizes(self) -> DataFrame:
        """path, kind, type, n, bytes of every stream and header: rows, and what their values take as they are."""
        out = None
        for kind, tables in (("stream", self.streams), ("header", self.headers)):
            for name, df in tables.items():
                columns = [c for c in df.columns if c not in ("chunk_id", "pos")]
                width = sum((_width(df, c) for c in columns), F.lit(0))
                types = ",".join(df.schema[c].dataType.simpleString() for c in columns)
                part = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("path"), F.lit(kind).alias("kind"), F.lit(types).alias("type"), "n", "bytes")
                out = part if out is None else out.unionByName(part)
        return out

    def dump(self, path: str) -> DataFrame:
        """Every stream and header as a table of its own below `path`, and an index of them with their sizes."""
        for kind, tables in (("stream", self.streams), ("header", self.headers)):
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{path}/{kind}={_file(name)}")
        index = self.sizes()
        index.coalesce(1).write.mode("overwrite").json(f"{path}/index")
        return index

    def decode(self) -> DataFrame:
        return _decode(self.plan, self, "")

    def checksums(self) -> DataFrame:
        """path, n, checksum of every stream and header: of their rows in any order."""
        out = None
        for name, df in {**self.streams, **{f"{k}#": h for k, h in self.headers.items()}}.items():
            row = F.crc32(F.to_json(F.struct(*sorted(df.columns))).cast("binary")) if df.columns else F.lit(0)
            part = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"), F.coalesce(F.sum(row), F.lit(0)).alias("s")).select(F.lit(name).alias("path"), "n", F.xxhash64("x", "s").alias("checksum"))
            out = part if out is None else out.unionByName(part)
        return out

    def differences(self, sums: DataFrame) -> DataFrame:
        """Paths whose checksums aren't those of `sums`."""
        mine = self.checksums()
        return mine.join(sums.withColumnsRenamed({"n": "n0", "checksum": "c0"}), "path", "full").where("n0 IS NULL OR n IS NULL OR n != n0 OR checksum != c0").select("path")


def _width(df: DataFrame, column: str) -> Column:
    """Bytes of a value: of text and binary their own, of numbers those of their type."""
    fixed = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4}
    kind = df.schema[column].dataType.typeName()
    return F.coalesce(F.octet_length(column), F.lit(0)) if kind in ("string", "binary") else F.lit(fixed.get(kind, 8))


def _file(name: str) -> str:
    return (name or "root").replace("/", "-")


#: Called with (path, node, stream that enters it).
Observer = Callable[[str, dict, DataFrame], None]


def encode(graph: dict, s: DataFrame, observe: Observer | None = None) -> Frame:
    """The stream through the graph, as lazy tables; `observe` sees what enters each node."""
    if missing := unknown_codecs(graph):
        raise CodecError(f"no codecs {sorted(missing)}")
    frame = Frame({}, {}, {})
    frame.plan = _encode(graph, s, frame, "", observe or (lambda path, node, s: None))
    return frame


def samples_at(graph: dict, s: DataFrame, name: str) -> list[DataFrame]:
    """The streams that enter the nodes named `name`, in the order of the graph: what a search for the slot works on."""
    found: list[DataFrame] = []

    def observe(path: str, node: dict, s: DataFrame) -> None:
        if node.get("name") == name:
            found.append(s)

    encode(graph, s, observe)
    return found


def _encode(graph: dict, s: DataFrame, frame: Frame, path: str, observe: Observer) -> dict:
    observe(path, graph, s)
    if "codec" not in graph:
        nodes = graph["choose"] if "choose" in graph else list(graph["nodes"].values()) if "model" in graph else [graph["then"], graph["else"]]
        routes = _routes(graph, s)
        parts = []
        frame.headers[f"{path}/route"] = routes
        for k, inner in enumerate(nodes):
            mine = s.join(routes.where(F.col("way") == k).select("chunk_id"), "chunk_id", "left_semi")
            parts.append(_encode(inner, mine, frame, f"{path}/{k}", observe))
        return {"ways": parts}
    codec = _make(graph)
    enc = codec.encode(s)
    if enc.header is not None:
        frame.headers[path] = enc.header
    outputs = {}
    for name, out in enc.streams.items():
        inner, at = graph["outputs"].get(name), f"{path}/{name}"
        if inner is None:
            frame.streams[at] = out
        else:
            outputs[name] = _encode(inner, out, frame, at, observe)
    return {"codec": graph["codec"], "params": graph["params"], "made": enc.params, "names": list(enc.streams), "outputs": outputs}


def _routes(graph: dict, s: DataFrame) -> DataFrame:
    """chunk_id, way."""
    if "model" in graph:
        label, way = BoostedTrees(graph["model"]).label(), None
        for k, name in enumerate(graph["nodes"]):
            way = F.when(label == name, k) if way is None else way.when(label == name, k)
        return feature_vector(s).select("chunk_id", F.coalesce(way, F.lit(0)).alias("way"))
    if "if" in graph:
        return _make(graph["if"]).check(s).select("chunk_id", F.when(F.col("ok"), 0).otherwise(1).alias("way"))
    out = None
    for k, n in enumerate(graph["choose"]):
        size = size_of(n, s).withColumn("way", F.lit(k))
        out = size if out is None else out.unionByName(size)
    # A codec that can't take a chunk must not be chosen for it.
    for k, n in enumerate(graph["choose"]):
        if "codec" in n:
            ok = _make(n).check(s).withColumnRenamed("ok", f"ok_{k}")
            out = out.join(ok, "chunk_id", "left").withColumn("bytes", F.when((F.col("way") != k) | F.col(f"ok_{k}"), F.col("bytes"))).drop(f"ok_{k}")
    return out.where("bytes IS NOT NULL").groupBy("chunk_id").agg(F.min_by("way", F.struct("bytes", "way")).alias("way"))


def size_of(graph: dict, s: DataFrame) -> DataFrame:
    """chunk_id, bytes: the stored form of a stream by way of a graph, numbers as compressed 64-bit values."""
    frame = encode(graph, s)
    every = None
    for out in frame.streams.values():
        kind = out.schema["v"].dataType.typeName()
        if kind in ("binary", "string"):
            size = out.groupBy("chunk_id").agg((F.sum(F.octet_length("v")) + F.count("*") * (4 if kind == "string" else 0)).alias("bytes"))
        else:
            size = stored_size(out)
        every = size if every is None else every.unionByName(size)
    return every.groupBy("chunk_id").agg(F.sum("bytes").alias("bytes"))


def _decode(plan: dict, frame: Frame, path: str) -> DataFrame:
    if "ways" in plan:
        out = None
        for k, inner in enumerate(plan["ways"]):
            part = _decode(inner, frame, f"{path}/{k}")
            out = part if out is None else out.unionByName(part)
        return out
    streams = {}
    for name in plan["names"]:
        at = f"{path}/{name}"
        streams[name] = _decode(plan["outputs"][name], frame, at) if name in plan["outputs"] else frame.streams[at]
    return _make(plan).decode(Encoded(streams, frame.headers.get(path), plan["made"]))


def replace(graph: dict, name: str, new: dict) -> dict:
    """The graph with the node named `name` (a node's "name" key) replaced: a slot that a search fills."""
    if graph.get("name") == name:
        return dict(new, name=name)
    if "choose" in graph:
        return {**graph, "choose": [replace(g, name, new) for g in graph["choose"]]}
    if "model" in graph:
        return {**graph, "nodes": {k: replace(g, name, new) for k, g in graph["nodes"].items()}}
    if "if" in graph:
        return {**graph, "then": replace(graph["then"], name, new), "else": replace(graph["else"], name, new)}
    return {**graph, "outputs": {k: replace(g, name, new) for k, g in graph["outputs"].items()}}


def slot(name: str, default: dict | None = None) -> dict:
    """A named place in a graph; it does what its default does until it is replaced."""
    return dict(default or node("store"), name=name)


#: Pipelines by name.
PROFILES = {
    "serial": node("zstd"),
    "le-u64": node("range_pack"),
    "le-i64": node("delta", {"deltas": node("zigzag")}),
    "sorted": node("delta", {"deltas": node("range_pack")}),
    "dictionary": node("tokenize", {"indices": node("huffman")}),
    "bytes": node("transpose_split"),
    "strings": node("prefix"),
    "text-column": node("try_parse_int", {"numbers": node("delta", {"deltas": node("zigzag")}), "exceptions": node("tokenize")}),
    "delta_huffman": node("delta", {"deltas": node("zigzag", {"v": node("huffman")})}),
    "delta_flatpack": node("delta", {"deltas": node("zigzag", {"v": node("range_pack", {"v": node("bitpack")})})}),
    "delta_zstd": node("delta", {"deltas": node("bytes_of", {"v": node("zstd")})}),
    "delta_field_lz": node("delta", {"deltas": node("field_lz")}),
    "range_pack_zstd": node("range_pack", {"v": node("bytes_of", {"v": node("zstd")})}),
    "tokenize_delta_field_lz": node("tokenize", {"alphabet": node("delta", {"deltas": node("field_lz")}), "indices": node("field_lz")}, sort=True),
    "csv-column": node("try_parse_int", {"numbers": node("field_lz"), "exceptions": node("tokenize", {"indices": node("field_lz")})}),
    "json-keys": node("tokenize", {"indices": node("field_lz")}, sort=True),
    "json-numbers": node("try_parse_int", {"numbers": node("field_lz"), "exceptions": node("separate_strings")}),
    "json-values": node("tokenize", {"alphabet": node("separate_strings", {"content": node("zstd")}), "indices": node("field_lz")}),
    "automatic-integers": choose(node("store"), node("delta", {"deltas": node("zigzag")}), node("tokenize", sort=True), node("range_pack"), node("divide_by")),
}
