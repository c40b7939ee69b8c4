"""Substring dedup by De Bruijn compaction.

Rule: a window is WINDOW consecutive words of one document; a word goes if a window over it has a word sequence that
also starts in a document with a smaller doc_id.

Graph: every window of WINDOW words is an edge of the De Bruijn graph of words, from its first WINDOW - 1 words to its
last.  Edges are dealt by their minimizer, the k-mer of EDGE words in them that is least by hash; neighbouring windows
mostly have the same one at the same place, so a maximal run of them, a path, is one row (about twenty windows).
Equal windows have equal minimizers, so documents can share a window only where they share a minimizer.

Compaction, in Spark joins and aggregates:
* a minimizer of one document leads nowhere, and its paths end there;
* a repeated path takes the coordinates (document, word) of its first occurrence as its source.  Where one path always
  goes on into the next and that one always comes from it (out-degree and in-degree 1) and both are neighbours in
  their source, they are one unitig, named by the coordinates at which it starts;
* occurrences of paths are joined to their unitigs, and neighbours of one unitig in a document become one span;
* a minimizer with several paths (branching) is opened: only paths' first documents are read again, and give their
  windows one by one, which meet by minimizer and window.
A path in a later document than its source goes whole; in its first document go those windows that an earlier path
also has.

Verification: every span has source coordinates.  The words there and the words of the span are read again and
compared by SHA-256 before anything is removed.  Paths and windows are named by 64 bits of XXH3; if a span differs
from its source, two names collided, and everything is done again with SHA-256 as names.

How it runs: sides of joins that may have hot keys are written first, so that adaptive execution can split them;
counts and minima are combined on the map side.  Few spans are broadcast to their documents; otherwise texts are
shuffled to them, but only those of documents that have any (told by a hash, up to KEY_BYTES of such hashes).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, broadcast_if_small, text_rows

WINDOW = 50
EDGE = 12
#: Bytes of a span in a list of spans, and of all lists up to which they are broadcast.
SPAN_BYTES, BROADCAST_BYTES = 64, 4 << 20
#: Bytes of the hashes of documents that have spans, up to which they tell whose texts are shuffled.
KEY_BYTES = 64 << 20
#: Bytes of text that are hashed at a time.
AT_A_TIME = 1 << 19

# Multipliers of the rolling hashes and random values for the bytes, from a fixed seed.
_RANDOM = np.random.Generator(np.random.PCG64(20_241))
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_BASE = [int(x) | 1 for x in _RANDOM.integers(1 << 62, 1 << 64, 2, np.uint64)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Hashes of slices of a sequence, from prefix sums of a polynomial modulo 2 ** 64."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values) + 1
        known = self.tables.get(base)
        if known is None or len(known[0]) < n:
            size = max(n, 2 * AT_A_TIME)
            known = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
            if size == 2 * AT_A_TIME:  # those of longer texts go with them
                self.tables[base] = known
        power, self.back = known
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(values * power[: n - 1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.back[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each run of `width` values."""
    at = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        have += step
    return at


class Words:
    """The words of several texts in one row: their places, and each text's part."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in split], np.int64)
        self.bytes = b" ".join(b" ".join(w) for w in split if w)
        lengths = np.array([len(x) for w in split for x in w], np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def paths(self, window: int, edge: int):
        """(text, first window, windows, edge's hash) of every path."""
        n = len(self.starts)
        each = np.maximum(self.counts - window + 1, 0)
        total = int(each.sum())
        if not total:
            return (np.zeros(0, np.int64),) * 4
        chars = _Rolling(_BYTE[np.frombuffer(self.bytes, np.uint8)], _BASE[0])
        words = chars.of(self.starts, self.ends)
        at = np.arange(n - edge + 1)
        edges = _Rolling(words, _BASE[1]).of(at, at + edge)
        text = np.repeat(np.arange(len(each)), each)
        start = np.arange(total) - np.repeat(np.cumsum(each) - each, each) + self.first[text]
        least = _least(edges, window - edge + 1)[start]
        cut = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
        return text[cut], start[cut], np.diff(np.append(cut, total)), edges[least[cut]]

    def raw(self, start: np.ndarray, n: np.ndarray):
        """The bytes of n words from each start, with one space between words."""
        a, b = self.starts[start].tolist(), self.ends[start + n - 1].tolist()
        return (self.bytes[x:y] for x, y in zip(a, b, strict=True))

    def names(self, start: np.ndarray, n: np.ndarray, bits: int) -> pa.Array:
        """Names of n words from each start: XXH3 cut to `bits` bits, or, for 256, SHA-256."""
        if bits == 256:
            return pa.array([hashlib.sha256(x).digest() for x in self.raw(start, n)], pa.binary())
        h = np.array([xxhash.xxh3_64_intdigest(x) for x in self.raw(start, n)], np.uint64)
        return pa.array((h >> np.uint64(64 - bits)).view(np.int64))


def _portions(batches):
    """Rows of about AT_A_TIME bytes of text: lists of the columns, the second one bytes."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // AT_A_TIME)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                part = batch.slice(a, b - a)
                yield [part.column(0).to_pylist(), as_bytes(part.column(1)), *[c.to_pylist() for c in part.columns[2:]]]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], list(columns))


def _with_spans(docs: DataFrame, spans: DataFrame, how: str, size: int, most: int) -> DataFrame:
    """docs with the column spans of their (doc_id, content); size: bytes of spans in all, which decides the join."""
    of = spans.select(F.col("doc_id").alias("s_id"), F.col("content").alias("s_content"), "spans")
    same = (F.col("doc_id") == F.col("s_id")) & (F.col("content") == F.col("s_content"))
    if size <= most:
        return docs.join(F.broadcast(of), same, how).drop("s_id", "s_content")
    keys = spans.select(F.xxhash64("doc_id", "content").alias("key"))
    if keys.count() * 16 > KEY_BYTES:
        return docs.join(of, same, how).drop("s_id", "s_content")
    # A hash that stands for two documents only shuffles one text more.
    keyed, keys = docs.withColumn("key", F.xxhash64("doc_id", "content")), F.broadcast(keys)
    some = keyed.join(keys, "key", "left_semi").drop("key").join(of, same, how).drop("s_id", "s_content")
    if how == "inner":
        return some
    rest = keyed.join(keys, "key", "left_anti").drop("key")
    return some.unionByName(rest.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))


def _found_windows(known: DataFrame, opened: DataFrame, s: Scratch, window: int, bits: int, most: int) -> DataFrame:
    """(doc_id, content, start, n, src_*): windows of opened paths (one row each) that start in an earlier one, too."""
    size = opened.count() * SPAN_BYTES
    to_open = s.write(opened.groupBy("doc_id", "content").agg(F.collect_list(F.struct("start", "n", "edge")).alias("spans")), "to-open")

    def open_up(batches):
        for doc_id, texts, content, spans in _portions(batches):
            w = Words(texts)
            rows = [(k, x["start"] + w.first[k], x["n"], x["edge"]) for k, xs in enumerate(spans) for x in xs]
            k, start, n, least = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            k, least, at = np.repeat(k, n), np.repeat(least, n), np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield _batch(edge=least, words=w.names(at, np.full(len(at), window), bits), doc_id=np.array(doc_id)[k], content=np.array(content)[k], start=at - w.first[k])

    windows = _with_spans(known, to_open, "inner", size, most).mapInArrow(open_up, f"edge long, words {_kind(bits)}, doc_id long, content long, start long")
    windows = s.write(windows, "windows")
    least = windows.groupBy("edge", "words").agg(F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("last")).where("src_doc != last").drop("last")
    least = s.write(least, "shared-windows")
    met = s.write(windows.join(least, ["edge", "words"]), "met-windows")
    s.drop("windows")
    source = met.where("doc_id = src_doc").groupBy("edge", "words").agg(F.min(F.struct("content", "start")).alias("x"))
    source = s.write(source.select("edge", "words", F.col("x.content").alias("src_content"), F.col("x.start").alias("src_start")), "sources-of-windows")
    return met.where("doc_id > src_doc").join(source, ["edge", "words"]).select("doc_id", "content", "start", F.lit(1).cast("long").alias("n"), "src_doc", "src_content", "src_start", F.lit(-1).cast("long").alias("unitig"))


def _kind(bits: int) -> str:
    return "binary" if bits == 256 else "long"


def _claimed(spark: SparkSession, known: DataFrame, s: Scratch, window: int, edge: int, bits: int, most: int) -> DataFrame:
    """(doc_id, content, start, end, src_doc, src_content, src_start): spans and where earlier documents have them."""
    kind = _kind(bits)

    def cut(batches):
        for doc_id, texts, content in _portions(batches):
            w = Words(texts)
            text, start, n, least = w.paths(window, edge)
            if len(text):
                names = w.names(start, n + window - 1, bits)
                # What comes before and after within the text, or null.
                at, along = np.arange(len(text)), text[1:] == text[:-1]
                before = names.take(pa.array(at - 1, mask=~np.append(False, along)))
                after = names.take(pa.array(at + 1, mask=~np.append(along, False)))
                yield _batch(edge=least.view(np.int64), doc_id=np.array(doc_id)[text], content=np.array(content)[text], start=start - w.first[text], n=n, path=names, before=before, after=after)

    paths = known.mapInArrow(cut, f"edge long, doc_id long, content long, start long, n long, path {kind}, before {kind}, after {kind}")
    paths = s.write(paths.withColumn("start", F.col("start").cast("int")).withColumn("n", F.col("n").cast("short")), "paths")
    shared = paths.groupBy("edge").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("path").alias("low"), F.max("path").alias("high")).where("first != last")
    shared = s.write(shared.select("edge", (F.col("low") != F.col("high")).alias("branching")), "shared-edges")
    found = s.write(paths.join(shared, "edge"), "shared-paths")
    s.drop("paths")

    one = lambda c: F.min(c).eqNullSafe(F.max(c))
    nodes = found.groupBy("edge", "path").agg(F.min(F.struct("doc_id", "content", "start")).alias("src"), F.max("doc_id").alias("last"), F.max("n").alias("n"), one("before").alias("one_before"), one("after").alias("one_after"))
    nodes = nodes.where("last > src.doc_id").select("edge", "path", F.col("src.doc_id").alias("src_doc"), F.col("src.content").alias("src_content"), F.col("src.start").cast("long").alias("src_start"), "n", "one_before", "one_after")
    along = Window.partitionBy("src_doc", "src_content").orderBy("src_start")
    glued = F.col("one_before") & F.lag("one_after").over(along) & (F.lag(F.col("src_start") + F.col("n")).over(along) == F.col("src_start"))
    nodes = nodes.withColumn("begins", F.when(~F.coalesce(glued, F.lit(False)), F.col("src_start")))
    unitigs = s.write(nodes.withColumn("unitig", F.max("begins").over(along)).select("edge", "path", "src_doc", "src_content", "src_start", "unitig"), "unitigs")

    occurrences = s.write(found.join(unitigs, ["edge", "path"], "left").select("edge", "doc_id", "content", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"), "branching", "src_doc", "src_content", "src_start", "unitig"), "occurrences")
    s.drop("shared-paths")
    opened = occurrences.where("branching AND (src_doc IS NULL OR doc_id = src_doc)").select("edge", "doc_id", "content", "start", "n")
    again = _found_windows(known, opened, s, window, bits, most)
    each = occurrences.where("doc_id > src_doc").select("doc_id", "content", "start", "n", "src_doc", "src_content", "src_start", "unitig").unionByName(again)

    # Neighbours of one unitig in a document are one span.
    here = Window.partitionBy("doc_id", "content").orderBy("start")
    same = [F.lag(c).over(here) == F.col(c) for c in ("src_doc", "src_content", "unitig")]
    same += [F.lag(F.col(c) + F.col("n")).over(here) == F.col(c) for c in ("start", "src_start")]
    goes_on = F.coalesce(same[0] & same[1] & same[2] & same[3] & same[4], F.lit(False))
    runs = each.withColumn("begins", F.when(~goes_on, F.col("start"))).withColumn("run", F.max("begins").over(here))
    spans = runs.groupBy("doc_id", "content", "run").agg((F.max(F.col("start") + F.col("n")) + (window - 1)).alias("end"), F.min("src_doc").alias("src_doc"), F.min("src_content").alias("src_content"), F.min("src_start").alias("src_start"))
    return s.write(spans.withColumnRenamed("run", "start"), "claimed")


def _sources(known: DataFrame, claimed: DataFrame, s: Scratch, most: int) -> DataFrame:
    """(doc_id, content, spans): each document's spans with the SHA-256 of the words at their sources."""
    source = claimed.select("src_doc", "src_content", "src_start", (F.col("end") - F.col("start")).alias("n")).distinct()
    source = s.write(source, "sources")
    lists = source.groupBy(F.col("src_doc").alias("doc_id"), F.col("src_content").alias("content")).agg(F.collect_list(F.struct(F.col("src_start").alias("start"), "n")).alias("spans"))

    def read(batches):
        for doc_id, texts, content, spans in _portions(batches):
            w = Words(texts)
            k, start, n = (np.array(c, np.int64) for c in zip(*((k, x["start"], x["n"]) for k, xs in enumerate(spans) for x in xs), strict=True))
            yield _batch(src_doc=np.array(doc_id)[k], src_content=np.array(content)[k], src_start=start, n=n, words=w.names(start + w.first[k], n, 256))

    lists = s.write(lists, "to-read")
    read_ = _with_spans(known, lists, "inner", source.count() * SPAN_BYTES, most).mapInArrow(read, "src_doc long, src_content long, src_start long, n long, words binary")
    read_ = s.write(read_, "words-of-sources")
    keyed = claimed.withColumn("n", F.col("end") - F.col("start")).join(broadcast_if_small(read_, most), ["src_doc", "src_content", "src_start", "n"], "left")
    return s.write(keyed.groupBy("doc_id", "content").agg(F.collect_list(F.struct("start", "n", "words")).alias("spans")), "spans")


def _kept(doc_id: list, texts: list[bytes], spans: list[list | None], with_text: bool) -> pa.RecordBatch:
    """Texts without their spans, and whether the words of all these are those at their sources."""
    w = Words([t if xs else b"" for t, xs in zip(texts, spans, strict=True)])
    out: list[list] = [[] for _ in range(6)]
    for k, (i, xs) in enumerate(zip(doc_id, spans, strict=True)):
        words, kept, at, ok = texts[k].split(), [], 0, True
        if xs:
            xs = sorted(xs, key=lambda x: x["start"])
            start, n = (np.array([x[c] for x in xs], np.int64) for c in ("start", "n"))
            ok = [x["words"] for x in xs] == w.names(start + w.first[k], n, 256).to_pylist()
            for a, b in zip(start.tolist(), (start + n).tolist(), strict=True):  # spans may overlap
                kept += words[at:a]
                at = max(at, b)
        kept += words[at:]
        left = b" ".join(kept)
        for column, value in zip(out, (i, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None, ok), strict=True):
            column.append(value)
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string(), "ok": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds.values(), strict=True)], list(kinds))


def substring_dedup(
    spark: SparkSession, docs: DataFrame, window: int = WINDOW, edge: int = EDGE, broadcast_bytes: int = BROADCAST_BYTES, bits: int = 64, with_text: bool = True
) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are runs of anything but x20 and x09-x0D, unchanged; kept_text joins the kept ones by one space (null
    where `with_text` is off).  A null or empty text has no words.  A null doc_id is not smaller than any and nothing
    is smaller than it, so its row is whole.  Rows of one doc_id are one document for other rows, and don't remove
    each other's words; each gives its row.  An empty table gives none; other columns are not read.  `bits` are those
    of the first names of paths: fewer only make it likelier that the work is done twice.
    """
    s = Scratch(spark, "substrings")
    rows = text_rows(docs)
    repeats = not rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = rows.withColumn("content", F.xxhash64("text") if repeats else F.lit(0).cast("long"))
    known = rows.where("doc_id IS NOT NULL").select("doc_id", "text", "content")
    if repeats:
        known = known.dropDuplicates(["doc_id", "content"])
    claimed = _claimed(spark, known, s, window, edge, bits, broadcast_bytes)
    spans = _sources(known, claimed, s, broadcast_bytes)

    def keep(batches):
        for doc_id, texts, spans in _portions(batches):
            yield _kept(doc_id, texts, spans, with_text)

    joined = _with_spans(rows, spans, "left", claimed.count() * SPAN_BYTES, broadcast_bytes).select("doc_id", "text", "spans")
    kept = s.write(joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, ok boolean"), "kept")
    if kept.where("NOT ok").isEmpty():
        s.keep_only("kept")
        return kept.drop("ok")
    if bits == 256:
        raise RuntimeError("spans differ from their sources")
    s.drop()
    return substring_dedup(spark, docs, window, edge, broadcast_bytes, 256, with_text)


QUERY = "op3_substring_dedup"

ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k, true AS gone FROM g JOIN f USING (h) WHERE first < doc_id),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM t),
n AS (SELECT r, count(*) AS n_words, count(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (gone IS NULL), '') AS kept FROM each LEFT JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN n USING (r)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept_text")
