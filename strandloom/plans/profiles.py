"""Whole inputs by profile: a text file's columns or values, each by a graph of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Encoded
from ..sources.csv_text import FIELD, CsvText
from ..sources.json_text import JsonText
from . import graph
from .graph import PROFILES, Frame


def csv_frames(s: DataFrame, sep: str = ",", null_aware: bool = False) -> tuple[Encoded, dict[int, Frame]]:
    """(tokens without fields, frame of each column): a CSV binary a chunk, every column by the csv-column profile.

    The number of columns is read from the data: one small action.
    """
    codec = CsvText(sep, null_aware)
    enc = codec.encode(s)
    top = enc["tokens"].where(F.col("kind") == FIELD).agg(F.max("col")).first()[0]
    frames = {k: graph.encode(PROFILES["csv-column"], codec.column(enc, k)) for k in range(0 if top is None else top + 1)}
    layout = enc["tokens"].withColumn("v", F.when(F.col("kind") != FIELD, F.col("v")))
    return Encoded({"tokens": layout}, enc.header, {"sep": sep, "null_aware": null_aware}), frames


def csv_back(layout: Encoded, frames: dict[int, Frame]) -> DataFrame:
    tokens, parts = layout["tokens"], None
    for k, f in frames.items():
        part = f.decode().select("chunk_id", F.lit(k).alias("col"), F.col("pos").alias("at"), F.col("v").cast("binary").alias("field"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is not None:
        fields = tokens.where(F.col("kind") == FIELD).drop("v").join(parts, ["chunk_id", "col", "at"]).withColumnRenamed("field", "v")
        tokens = tokens.where(F.col("kind") != FIELD).unionByName(fields)
    return CsvText(layout.params["sep"], layout.params["null_aware"]).decode(Encoded({"tokens": tokens}, layout.header))


#: Profile of each of a JSON text's streams.
JSON = {"values": "json-values", "keys": "json-keys", "numbers": "json-numbers"}


def json_frames(s: DataFrame) -> tuple[Encoded, dict[str, Frame]]:
    """(structure and raw strings, frame of values, keys and numbers) of a JSON binary a chunk."""
    enc = JsonText().encode(s)
    frames = {n: graph.encode(PROFILES[p], enc[n].withColumn("v", F.decode("v", "UTF-8"))) for n, p in JSON.items()}
    return Encoded({n: enc[n] for n in ("structure", "raw")}), frames


def json_back(rest: Encoded, frames: dict[str, Frame]) -> DataFrame:
    streams = dict(rest.streams) | {n: f.decode().withColumn("v", F.col("v").cast("binary")) for n, f in frames.items()}
    return JsonText().decode(Encoded(streams))
