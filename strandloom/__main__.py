"""Command line: streams of Parquet columns to frames and back.

    python -m strandloom profiles
    python -m strandloom encode  --profile le-i64 --table in.parquet --value v --key k [--chunk 65536] --to frame
    python -m strandloom decode  --frame frame --to out.parquet
    python -m strandloom inspect --frame frame
    python -m strandloom bench   --table in.parquet --value v --key k [--profile a,b]
    python -m strandloom dump    --frame frame --to folder
    python -m strandloom train   --table in.parquet --value v,w --key k --to graph.json
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .core import stream
from .plans import graph, search


def _stream(spark: SparkSession, a: argparse.Namespace):
    return stream(spark.read.parquet(a.table), a.value, a.key, F.floor(F.col(a.key) / a.chunk))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("strandloom")
    p.add_argument("command", choices=["profiles", "encode", "decode", "inspect", "dump", "bench", "train"])
    for name in ("table", "value", "key", "frame", "to"):
        p.add_argument(f"--{name}")
    p.add_argument("--profile", default="automatic-integers")
    p.add_argument("--chunk", type=int, default=65536)
    p.add_argument("--generations", type=int, default=3)
    a = p.parse_args(argv)
    if a.command == "profiles":
        print("\n".join(sorted(graph.PROFILES)))
        return 0
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    if a.command == "encode":
        graph.encode(graph.PROFILES[a.profile], _stream(spark, a)).write(a.to)
    elif a.command == "decode":
        graph.Frame.read(spark, a.frame).decode().write.mode("overwrite").parquet(a.to)
    elif a.command == "inspect":
        frame = graph.Frame.read(spark, a.frame)
        print(json.dumps(frame.info() | {"sizes": [r.asDict() for r in frame.sizes().collect()]}, indent=1))
    elif a.command == "dump":
        for r in graph.Frame.read(spark, a.frame).dump(a.to).collect():
            print(json.dumps(r.asDict()))
    elif a.command == "bench":
        s = _stream(spark, a)
        rows = s.count()
        for name in a.profile.split(","):
            began = time.perf_counter()
            size = graph.size_of(graph.PROFILES[name], s).agg(F.sum("bytes")).first()[0]
            print(json.dumps({"profile": name, "rows": rows, "bytes": size, "ratio": round(rows * 8 / max(1, size or 0), 3), "seconds": round(time.perf_counter() - began, 3)}))
    else:
        table, chunk = spark.read.parquet(a.table), F.floor(F.col(a.key) / a.chunk)
        found = search.train({k: stream(table, v, a.key, chunk) for k, v in enumerate(a.value.split(","))}, generations=a.generations)
        text = json.dumps({"columns": a.value.split(","), "groups": found["groups"], "graphs": found["graphs"], "fronts": [{"bytes": f[0], "nodes": f[1], "graphs": x} for f, x in found["fronts"]]})
        spark.createDataFrame([(text,)], "v string").coalesce(1).write.mode("overwrite").text(a.to)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
