"""Shared helpers of the corpus operators: scratch tables, Arrow streaming, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import scratch_dir

#: Python's bytes.split() without arguments cuts at exactly x20 and x09-x0D, the separators of a word.
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


#: Bytes up to which a side whose size was summed is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Marked for broadcast if its values' bytes, summed over all rows, are few; as it is otherwise."""
    of = {"string": lambda c: F.coalesce(F.octet_length(c), F.lit(0)), "binary": lambda c: F.coalesce(F.octet_length(c), F.lit(0))}
    row = sum((of[kind](c) for c, kind in df.dtypes if kind in of), F.lit(16 * len(df.columns)).cast("long"))
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df


#: Lists of scratch folders that a caller collects to delete them, the innermost last.
_collecting: list[list[Scratch]] = []


class Scratch:
    """Intermediate tables of one operator call: written with Spark's committer, so that they outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
        for held in _collecting[-1:]:
            held.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _folder(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, name: str | None = None) -> None:
        """Delete a table that nothing reads any more; without a name, all of them."""
        fs, path = self._folder(f"{self.root}/{name}" if name else self.root)
        fs.delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these, which a result still reads (a name that ends with * stands for all that begin so)."""
        fs, root = self._folder(self.root)
        if fs.exists(root):
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if not any(fnmatchcase(name, n) for n in names):
                    fs.delete(status.getPath(), True)


@contextmanager
def scratch_deleted(*but: Scratch):
    """Scratch folders that are opened within are deleted at the end: for callers that have written the result."""
    _collecting.append([])
    try:
        yield
    finally:
        for s in _collecting.pop():
            if s not in but:
                s.drop()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: How the tables that operators keep in a Python worker are let go, by name.
_tables: dict[str, Callable[[], None]] = {}


def tables_of(name: str, clear: Callable[[], None]) -> None:
    """Make known how tables that outlive a task are let go."""
    _tables[name] = clear


def hold_only(name: str | None) -> None:
    """Workers are used again by whatever runs next: it lets go of the tables that others left."""
    for other, clear in _tables.items():
        if other != name:
            clear()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, tables: str | None = None) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are passed over.  `tables` are those that f uses."""

    def run(batches):
        hold_only(tables)
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        pa.default_memory_pool().release_unused()  # workers live on

    return df.mapInArrow(run, schema)


def text_rows(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the columns asked for, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
