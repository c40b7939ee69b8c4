"""Nested columns to flat streams: arrays and maps of any depth as lengths and leaves.

An array's lengths are one stream and its elements the next level; a map's lengths are one stream, its keys and its
values (by key) two more.  Levels are built by posexplode, and positions of a level are running sums of the lengths
before, within chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import Codec, Encoded, in_chunk


def _level(s: DataFrame, elements) -> DataFrame:
    """The elements of a stream of arrays, as a stream."""
    x = s.select("chunk_id", F.col("pos").alias("outer"), F.posexplode(elements).alias("inner", "v"))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("outer", "inner")) - 1
    return x.select("chunk_id", place.cast("long").alias("pos"), "v")


def _grouped(lengths: DataFrame, elements: DataFrame) -> DataFrame:
    """chunk_id, pos, items: elements by the array that they belong to; empty arrays too."""
    end = F.sum("v").over(in_chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bounds = lengths.select("chunk_id", "pos", (end - F.col("v")).alias("start"), F.col("v").alias("n"))
    # Each element finds its array by the last start at or before it: both sides in one ordered pass.
    starts = bounds.where("n > 0").select("chunk_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.col("pos").alias("array"), F.lit(None).cast(elements.schema["v"].dataType).alias("v"))
    both = starts.unionByName(elements.select("chunk_id", F.col("pos").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("array"), "v"))
    w = Window.partitionBy("chunk_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = both.withColumn("array", F.last("array", True).over(w)).where("side = 1")
    in_order = lambda x: F.array_sort(x, lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1))  # noqa: E731  values may have no order
    items = owned.groupBy("chunk_id", F.col("array").alias("pos")).agg(F.transform(in_order(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("items"))
    return bounds.select("chunk_id", "pos").join(items, ["chunk_id", "pos"], "left")


class Nested(Codec):
    """A stream of arrays or maps to streams by path: "n" lengths, "k" keys, "v" elements or values."""

    name = "nested"

    def encode(self, s: DataFrame) -> Encoded:
        streams: dict[str, DataFrame] = {}
        kind = s.schema["v"].dataType
        self._split(s, kind, "", streams)
        return Encoded(streams, params={"type": kind.jsonValue()})

    def _split(self, s: DataFrame, kind: T.DataType, path: str, out: dict[str, DataFrame]) -> None:
        if isinstance(kind, T.ArrayType):
            out[f"{path}n"] = s.withColumn("v", F.size("v").cast("long"))
            self._split(_level(s, F.col("v")), kind.elementType, f"{path}v", out)
        elif isinstance(kind, T.MapType):
            entries = F.transform(F.array_sort(F.map_keys("v")), lambda k: F.struct(k.alias("key"), F.element_at(F.col("v"), k).alias("value")))
            out[f"{path}n"] = s.withColumn("v", F.size("v").cast("long"))
            pairs = _level(s, entries)
            self._split(pairs.select("chunk_id", "pos", F.col("v.key").alias("v")), kind.keyType, f"{path}k", out)
            self._split(pairs.select("chunk_id", "pos", F.col("v.value").alias("v")), kind.valueType, f"{path}v", out)
        else:
            out[path] = s

    def decode(self, enc: Encoded) -> DataFrame:
        return self._merge(T.StructType.fromJson({"type": "struct", "fields": [{"name": "v", "type": enc.params["type"], "nullable": True, "metadata": {}}]})["v"].dataType, "", enc.streams)

    def _merge(self, kind: T.DataType, path: str, streams: dict[str, DataFrame]) -> DataFrame:
        if isinstance(kind, T.ArrayType):
            out = _grouped(streams[f"{path}n"], self._merge(kind.elementType, f"{path}v", streams))
            return out.select("chunk_id", "pos", F.coalesce("items", F.array().cast(kind)).alias("v"))
        if isinstance(kind, T.MapType):
            keys = _grouped(streams[f"{path}n"], self._merge(kind.keyType, f"{path}k", streams)).withColumnRenamed("items", "k")
            values = _grouped(streams[f"{path}n"], self._merge(kind.valueType, f"{path}v", streams))
            whole = F.map_from_arrays(F.coalesce("k", F.array().cast(T.ArrayType(kind.keyType))), F.coalesce("items", F.array().cast(T.ArrayType(kind.valueType))))
            return keys.join(values, ["chunk_id", "pos"]).select("chunk_id", "pos", whole.alias("v"))
        return streams[path]
