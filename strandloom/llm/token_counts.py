"""Token counts of fields and sections by offset-mapped attribution.

A document (its fields, joined by a line feed) is encoded once and whole, never section by section, so the sum over
its sections is the document's own count.  Each token has a span of characters; sections are intervals of characters;
the two sorted lists are joined on overlap, and each token is allocated by an explicit rule:

* majority  to the section that has most of its characters, the earlier one of equals (the default);
* start     to the section in which it starts;
* share     to all sections it overlaps, in proportion to its characters (counts are fractions).

Characters between sections (the line feed that joins fields) belong to the section before.  A token of part of a
character counts as standing at that character.  Everything about a document is in its own row, so the join needs
no shuffle and a task holds one batch of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import map_batches

RULES = ("majority", "start", "share")


def section_starts(text: str, separator: str) -> list[int]:
    """Where sections start: at 0 and after each separator that doesn't end the text."""
    starts, at = [0], text.find(separator)
    while at >= 0 and at + len(separator) < len(text):
        starts.append(at + len(separator))
        at = text.find(separator, at + len(separator))
    return starts


def token_spans(text: str, raw: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token; a token within a character has that character."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if len(raw) == len(text):
        return starts, ends
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # of a byte: its character's number, from 1
    return char[starts] - 1, char[ends - 1]


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section: sections are the first characters of intervals that cover all, in order."""
    k = len(sections)
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    out = np.bincount(first[(first == last) | (rule == "start")], minlength=k).astype(float)
    if rule == "start":
        return out
    bounds = np.append(sections, ends[-1] if len(ends) else 0)
    for t in np.flatnonzero(first != last):  # the few tokens over a boundary
        s = np.arange(first[t], last[t] + 1)
        part = np.minimum(ends[t], bounds[s + 1]) - np.maximum(starts[t], bounds[s])
        part[-1] = ends[t] - max(starts[t], bounds[s[-1]])
        if rule == "majority":
            out[s[np.argmax(part)]] += 1
        else:
            out[s] += part / part.sum()
    return out


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), separator: str = "\n", rule: str = "majority", path: str | None = None) -> DataFrame:
    """One row for each section of each field of each document.

    Columns: doc_id, field, section (from 0 in its field), start, end (characters of the field, end exclusive),
    n_tokens (double), doc_tokens.  A null or empty field has one empty section without tokens.  Repeated rows and
    null doc_ids give their rows like any other; an empty table gives none; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary_path("byte_bpe_50k.json")
    names = ["doc_id", "field", "section", "start", "end", "n_tokens", "doc_tokens"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def run(batch: pa.RecordBatch):
        e, held, out = encoder(path), 0, [[] for _ in names]
        for doc_id, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = [v or "" for v in values]
            text = "\n".join(values)
            raw = text.encode()
            ids = np.frombuffer(e.encode(text), "<u4").astype(np.int64)
            starts, ends = token_spans(text, raw, ids, e.vocabulary.length)
            rows, base, begun = [], 0, []
            for name, value in zip(fields, values, strict=True):
                cuts = section_starts(value, separator)
                for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(value)], strict=True)):
                    rows.append((doc_id, name, k, a, b))
                    begun.append(base + a)
                base += len(value) + 1
            counts = allocate(starts, ends, np.array(begun), rule)
            for column, value in zip(out, zip(*rows, strict=True), strict=False):
                column.extend(value)
            out[5].extend(counts.tolist())
            out[6].extend([len(ids)] * len(rows))
            held += len(rows)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                held, out = 0, [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long"), *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    return map_batches(rows, run, "doc_id long, field string, section int, start long, end long, n_tokens double, doc_tokens long", "pieces")


QUERY = "op1_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each text, and of its source and language."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("source", "lang", "text"))
