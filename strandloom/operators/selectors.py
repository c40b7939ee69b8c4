"""Choosing what to do with a stream from its data: sizes as expressions, rules as CASE, one choice for each chunk.

Choices are columns, so a plan stays lazy and every chunk can take its own way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import stretch, whole_chunk

NEVER = 1 << 62


# Estimated sizes in bytes.  n values, k of them distinct, top the largest, h their entropy in bits.


def bits_for(x: Column) -> Column:
    """Bits that tell x things apart: the logarithm, rounded up."""
    return F.when(x <= 1, 0).otherwise(F.length(F.bin(x - 1)))


def bitpacked_size(n: Column, top: Column) -> Column:
    return F.when(n == 0, 0).otherwise(F.floor((n * bits_for(top + 1) + 7) / 8))


def flatpacked_size(n: Column, k: Column) -> Column:
    return F.floor((n * bits_for(k) + 7) / 8) + k


def varint_size(x: Column) -> Column:
    """Bytes of a number at seven bits a byte."""
    return F.when(x == 0, 1).otherwise(F.ceil(F.length(F.bin(x)) / 7))


def constant_size(n: Column, k: Column) -> Column:
    return F.when(k == 1, 1 + varint_size(n)).otherwise(NEVER)


def fast_huffman_size(n: Column, h: Column) -> Column:
    return F.when(h > 7, n).otherwise(F.floor(F.greatest(h, F.lit(1.0)) * n / 8))


def entropy_coded_size(n: Column, h: Column) -> Column:
    return F.floor((F.floor(h * n) + 7) / 8)


def huffman_or_fse(n: Column, h: Column) -> Column:
    return F.when(entropy_coded_size(n, h) + F.floor(n / 32) < fast_huffman_size(n, h), "fse").otherwise("huffman")


def byte_backend(n: Column, k: Column, top: Column, h: Column, mode: str = "any") -> Column:
    """The back end of a chunk of bytes: store, constant, bitpack, flatpack, huffman or fse."""
    coder = F.lit(mode) if mode in ("huffman", "fse") else huffman_or_fse(n, h)
    estimate = F.when(coder == "huffman", fast_huffman_size(n, h)).otherwise(entropy_coded_size(n, h))
    base = F.least(estimate + F.greatest(F.lit(10), F.floor(k / 4)), n)
    bit, flat = bitpacked_size(n, top), flatpacked_size(n, k)
    packed = F.least(bit, flat)
    return F.when(n <= 1, "store").when(k == 1, "constant").when(packed < base, F.when(bit <= flat, "bitpack").otherwise("flatpack")).when(n <= base, "store").otherwise(coder)


def two_byte_backend(n: Column, k: Column, top: Column, h: Column) -> Column:
    """The back end of a chunk of two-byte values."""
    huffman = F.floor((F.floor(F.greatest(h, F.lit(1.0)) * n) + 7) / 8) + F.greatest(F.lit(100), F.floor(top / 4))
    bit = bitpacked_size(n, top)
    return (
        F.when(k == 1, "constant").when((bit <= huffman) & (bit < 2 * n), "bitpack").when((h > 15) | (huffman >= 2 * n), "store")
        .when(k < 256, "tokenize").otherwise("huffman")
    )


#: Values from which a stream is cut for entropy coding, and the values of a piece.
ENTROPY_WHOLE, ENTROPY_PIECE = 100_000, 32_768


def entropy_pieces(s: DataFrame) -> DataFrame:
    """The stream with its chunks cut for entropy coding: chunk_id, piece, pos (in the piece), v."""
    counts = s.groupBy("chunk_id", stretch().alias("stretch")).agg(F.count("*").alias("n"))
    n = counts.withColumn("n", F.sum("n").over(whole_chunk()))  # of each stretch, so that a long chunk is joined by many tasks
    piece = F.when(F.col("n") < ENTROPY_WHOLE, 0).otherwise(F.floor(F.col("pos") / ENTROPY_PIECE)).cast("long")
    x = s.withColumn("stretch", stretch()).join(n, ["chunk_id", "stretch"]).withColumn("piece", piece)
    return x.select("chunk_id", "piece", (F.col("pos") - F.when(F.col("n") < ENTROPY_WHOLE, 0).otherwise(F.col("piece") * ENTROPY_PIECE)).alias("pos"), "v")


def _less(size: Column, percent: int) -> Column:
    """A size with a handicap: what it must win by, in percent."""
    return size + F.floor(size * percent / 100)


def literal_backend(n: Column, k: Column, huffman: Column, delta_huffman: Column, zstd: Column, delta_zstd: Column) -> Column:
    """The back end of literals by the sizes of candidates.

    One value: constant.  Under 200 values: stored.  Differences are taken if their code is smaller by four percent;
    then the smallest of store, Huffman (handicap two percent) and zstandard (four percent).
    """
    delta = _less(delta_huffman, 4) < huffman
    h = F.when(delta, delta_huffman).otherwise(huffman)
    z = F.when(delta, delta_zstd).otherwise(zstd)
    ways = F.when(_less(h, 2) < n, F.when(_less(z, 4) < _less(h, 2), "zstd").otherwise("huffman")).when(_less(z, 4) < n, "zstd").otherwise("store")
    best = F.when(_less(h, 2) >= n, "store").otherwise(ways)
    named = F.when(delta & (best != "store"), F.concat(F.lit("delta_"), best)).otherwise(best)
    return F.when((k == 1) & (n > 1), "constant").when(n < 200, "store").otherwise(named)


def brute_force(sizes: DataFrame, raw: str, candidates: Sequence[str]) -> DataFrame:
    """sizes with choice and size: the smallest of the candidates' columns, the first of equals; store if none is smaller than raw.

    Strings count four bytes a value more in `raw` and candidates alike: that is for who fills the columns.
    """
    best = F.least(*[F.col(c) for c in candidates])
    name = None
    for c in candidates:
        name = F.when(F.col(c) == best, c) if name is None else name.when(F.col(c) == best, c)
    worse = best >= F.col(raw)
    return sizes.withColumn("choice", F.when(worse, "store").otherwise(name)).withColumn("size", F.least(best, F.col(raw)))


#: What a stream goes to by its type when nothing else is known.
GENERIC = {"binary": "zstd", "struct": "field_lz", "byte": "field_lz", "short": "field_lz", "integer": "field_lz", "long": "field_lz", "string": "separate_string_components"}


def generic(s: DataFrame) -> str:
    return GENERIC.get(s.schema["v"].dataType.typeName(), "zstd")


def constant_kind(s: DataFrame) -> str:
    return "constant_serial" if s.schema["v"].dataType.typeName() == "byte" else "constant_fixed"


def null_aware(s: DataFrame) -> DataFrame:
    """The stream with is_empty: strings of no bytes apart from the others."""
    return s.withColumn("is_empty", F.octet_length("v") == 0)


def directed(s: DataFrame, tag: str, n: int) -> Column:
    """The successor that a tag column names; the last one for tags beyond."""
    return F.least(F.greatest(F.col(tag), F.lit(0)), F.lit(n - 1))


def probabilistic(weights: Sequence[float], seed: int = 0) -> Column:
    """A successor for each chunk, drawn by weight from a hash of the chunk, so the same every time."""
    total, at, out = sum(weights), 0.0, None
    u = F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    for k, w in enumerate(weights[:-1]):
        at += w / total
        out = F.when(u < at, k) if out is None else out.when(u < at, k)
    return F.lit(0) if out is None else out.otherwise(len(weights) - 1)


def on_empty(s: DataFrame, empty: Callable, other: Callable):
    """`empty` of a stream without rows, else `other`: one small action."""
    return empty(s) if s.isEmpty() else other(s)


class BoostedTrees:
    """Gradient-boosted trees as one expression.

    A model is {"forests": [[tree, ...], ...], "labels": [...], "features": [...]}; a tree is a list of nodes, each
    {"feature": k, "value": threshold, "left": i, "right": j, "missing": m} or {"feature": -1, "value": leaf}.  A
    value under the threshold goes left; null, NaN and features that aren't there go to the missing child.  Several
    forests: the label of the largest sum, the first of equals.  One forest: the second label from 0 on.  No forest:
    the first label.
    """

    def __init__(self, model: dict | str):
        self.model = json.loads(model) if isinstance(model, str) else model

    def _tree(self, nodes: list[dict], k: int) -> Column:
        node = nodes[k]
        if node["feature"] == -1:
            return F.lit(float(node["value"]))
        missing = self._tree(nodes, node["missing"])
        if node["feature"] >= len(self.model["features"]):
            return missing
        x = F.col(self.model["features"][node["feature"]]).cast("double")
        left, right = self._tree(nodes, node["left"]), self._tree(nodes, node["right"])
        return F.when(x.isNull() | F.isnan(x), missing).when(x < float(node["value"]), left).otherwise(right)

    def scores(self) -> list[Column]:
        out = []
        for forest in self.model["forests"]:
            total = F.lit(0.0)
            for tree in forest:
                total = total + self._tree(tree, 0)
            out.append(total)
        return out

    def label(self) -> Column:
        labels, scores = self.model["labels"], self.scores()
        if not scores:
            return F.lit(labels[0])
        if len(scores) == 1:
            return F.when(scores[0] < 0, labels[0]).otherwise(labels[1])
        best = F.greatest(*scores)
        out = None
        for name, s in zip(labels, scores, strict=True):
            out = F.when(s == best, name) if out is None else out.when(s == best, name)
        return out
