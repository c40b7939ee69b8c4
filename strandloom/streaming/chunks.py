"""Encoding of unbounded inputs.

Chunks are independent, so a micro-batch of whole chunks is encoded like any table (``encode_to``).  Where a chunk
goes on for ever, differences carry its last value in the state store (``running_deltas``); ``profile`` gives features
by event time, with a watermark for what comes late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def encode_to(source: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes encode(batch) of each micro-batch below `path`, one folder a batch, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        encode(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_deltas(source: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, v: each value's difference from the one before with its key, over micro-batches; the first as it is.

    Rows of a micro-batch are taken in order; a row that is late behind an earlier batch follows what was last.
    """

    def step(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else 0
        x = pd.concat(list(batches)).sort_values(order, kind="stable")
        values = x[value].to_numpy()
        out = pd.DataFrame({key: k[0], order: x[order].to_numpy(), "v": values - [last, *values[:-1]]})
        if len(values):
            state.update((int(values[-1]),))
        yield out

    kind = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {order} {kind[order]}, v long", "last long", "append", GroupStateTimeout.NoTimeout)


def profile(source: DataFrame, at: str, value: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Count, extremes, mean and variance of a value by windows of event time, tumbling or sliding."""
    keys = [F.window(at, window, slide) if slide else F.window(at, window)] + ([F.col(by)] if by else [])
    v = F.col(value)
    return source.withWatermark(at, late).groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))


def sessions(source: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: stretches of events with less than `gap` between them."""
    s = source.withWatermark(at, late).groupBy(F.session_window(at, gap), F.col(key)).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
