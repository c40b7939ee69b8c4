"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints that differ in at most three bits are linked; a component of links is a group of near copies.

Search: a pair within three bits agrees exactly on b-3 of b bit fields, so every distinct fingerprint goes to one
bucket for each choice of b-3 fields, keyed by their bits (b = 4 for small inputs; more fields, and so longer keys,
as the number of fingerprints grows: `fields_for`).  In a bucket fingerprints stand in the order of their Gray rank,
in which neighbours share long bit patterns.  Runs of 16 form nodes, runs of 16 nodes upper nodes, and so on; a node
keeps the mask and the pattern of the bits that all its members share.  Pairs of nodes are walked from the top: the
differing bits of two patterns under both masks are differences that every pair of members has, so a pair of groups
with more than three is dropped whole, and a pair whose members can differ in three bits at most is linked whole.

Hot buckets: the bits that members of a bucket needn't share are cut into twice as many fields as may differ, and a
bucket with more than SEGMENT distinct fingerprints is dealt again by each choice of half of these fields, of which a
pair must agree on one.  What is still hot then (fingerprints that share nearly all bits) is dealt into s segments by
a hash, and each pair of segments is looked at on its own, so all pairs of the bucket still meet, in groups of at most
2 * SEGMENT rows.  A group returns links that keep its components (fewer than it has rows), not its pairs.

Components: alternating large-star and small-star steps over links between distinct fingerprints, each written to
the scratch folder.  Nothing is collected to the driver but row counts.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, fresh, map_batches, text_rows

SHINGLE = 3
DISTANCE = 3
#: Distinct fingerprints of a bucket beyond which it is dealt into segments.
SEGMENT = 512
#: Fingerprints that a bucket should have on average; decides the number of bit fields.
BUCKET_ROWS = 64
FAN_OUT = 16

_LANES = np.arange(8, dtype=np.int64) * 256
_BITS = np.array([[b >> j & 1 for j in range(8)] for b in range(256)], dtype=np.int64)
_WEIGHTS = 1 << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted; 0 for a text without words."""
    words = text.lower().split()  # of bytes: A-Z only, and cuts at x20 and x09-x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], 42) for a, b in zip((ends - lengths)[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 18):
        lanes = np.array(hashes[k : k + (1 << 18)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += (np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(_WEIGHTS[counts * 2 > len(hashes)].sum())


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size) for t in as_bytes(batch.column(1))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(text_rows(docs), run, "doc_id long, fp long")


def fields_for(n: int, distance: int = DISTANCE, target: int = BUCKET_ROWS) -> int:
    """The number of bit fields with which a bucket has about `target` of n fingerprints; 8 at most."""
    return next((b for b in range(distance + 1, 9) if n / 2 ** (64 * (b - distance) / b) <= target), 8)


def _tables(b: int, distance: int) -> list[int]:
    """The masks of the bits that a bucket's members share: one for each choice of b - distance of the b fields."""
    edges = [round(64 * k / b) for k in range(b + 1)]
    field = [sum(1 << i for i in range(edges[k], edges[k + 1])) for k in range(b)]
    return [sum(field[k] for k in chosen) for chosen in combinations(range(b), b - distance)]


def _finer(mask: int, distance: int) -> list[int]:
    """The masks of a hot bucket's second dealing: `mask` with each choice of `distance` of 2 * distance fields of the other bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    n = 2 * distance
    cuts = [round(len(free) * k / n) for k in range(n + 1)]
    field = [sum(1 << i for i in free[cuts[k] : cuts[k + 1]]) for k in range(n)]
    return [mask | sum(field[k] for k in chosen) for chosen in combinations(range(n), n - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


class GrayIndex:
    """The hierarchical index over many buckets at once: items in order of (bucket, Gray rank)."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), bucket))
        self.fp, self.bucket = fp[order], bucket[order]
        group, ones, zeros = self.bucket, self.fp, ~self.fp
        # A level: the first child of each node (and the end), and the bits that are one, or zero, in all of it.
        self.levels = [(np.arange(len(fp) + 1), ones, zeros)]
        while len(group) > 1:
            first = _starts(group)
            at = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            cut = np.flatnonzero(at % FAN_OUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            self.levels.append((np.append(cut, len(group)), ones, zeros))
            if len(first) == len(cut):
                break
            group = group[cut]

    def links(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (item, the least item of its component in the bucket) of all items that aren't the least."""
        label = np.arange(len(self.fp))
        roots = np.arange(len(self.levels[-1][1]))
        todo = [(len(self.levels) - 1, roots[k : k + 4096], roots[k : k + 4096]) for k in range(0, len(roots), 4096)]
        while todo:
            level, i, j = todo.pop()
            if level == 0:
                label = _joined(label, i, j)
                continue
            first = self.levels[level][0]
            down, (_, ones, zeros) = level - 1, self.levels[level - 1]
            a, b = self._children(first, i, j)
            differ = np.bitwise_count((ones[a] & zeros[b]) | (zeros[a] & ones[b]))  # by these every pair of members differs
            near = differ <= distance
            a, b = a[near], b[near]
            if down:
                same = (ones[a] & ones[b]) | (zeros[a] & zeros[b])  # shared by all members of both
                whole = np.bitwise_count(~same) <= distance
                if whole.any():
                    label = self._whole(label, down, np.concatenate((a[whole], b[whole])), np.tile(a[whole], 2))
                a, b = a[~whole], b[~whole]
            todo += [(down, a[k : k + 4096], b[k : k + 4096]) for k in range(0, len(a), 4096)] if down else [(0, a, b)]
        far = np.flatnonzero(label != np.arange(len(label)))
        return far, label[far]

    @staticmethod
    def _children(first, i, j):
        step = np.arange(FAN_OUT)
        a, b = first[i][:, None] + step, first[j][:, None] + step
        valid = (a < first[i + 1][:, None])[:, :, None] & (b < first[j + 1][:, None])[:, None, :]
        a, b = np.broadcast_to(a[:, :, None], valid.shape)[valid], np.broadcast_to(b[:, None, :], valid.shape)[valid]
        ordered = a <= b
        return a[ordered], b[ordered]

    def _whole(self, label, level, node, head):
        """Link all items below the nodes to the first item below their head."""
        start = lambda x: self._leaf(x, level)
        lo, hi, to = start(node), start(node + 1), start(head)
        n = hi - lo
        items = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return _joined(label, items, np.repeat(to, n))

    def _leaf(self, node, level):
        for k in range(level, 0, -1):
            node = self.levels[k][0][node]
        return node


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after linking a[k] to b[k]: each item points at the least item of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(jump := label[label], label):
            label = jump


def _parted(keyed: DataFrame, scratch: Scratch, name: str, segment: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of buckets of at most `segment` rows, and those of hot ones with their count (None if there are none)."""
    hot = scratch.write(keyed.groupBy("t", "bits").count().where(F.col("count") > segment), name)
    if hot.isEmpty():
        return keyed, None
    return keyed.join(hot, ["t", "bits"], "left_anti"), scratch.write(keyed.join(hot, ["t", "bits"]), f"{name}-rows")


def links(spark: SparkSession, fps: DataFrame, scratch: Scratch, distance: int = DISTANCE, segment: int = SEGMENT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp, no repeats) that give their components."""
    masks = _tables(fields_for(fps.count(), distance, bucket_rows), distance)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "bits"))
    cold, hot = _parted(keyed, scratch, "hot", segment)
    parts = [cold]
    if hot is not None and distance:
        finer = [(t, k, _signed(m)) for t, mask in enumerate(masks) for k, m in enumerate(_finer(mask, distance))]  # as many as choices of fields
        finer = F.broadcast(spark.createDataFrame(finer, "t int, k int, mask long"))
        dealt = hot.drop("count").join(finer, "t").select("fp", (F.lit(len(masks)) + F.col("t") * 1000 + F.col("k")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
        cold, hot = _parted(dealt, scratch, "hot-again", segment)
        parts.append(cold)
    rows = reduce(DataFrame.unionByName, parts).select("t", "bits", F.lit(-1).alias("part"), "fp")
    if hot is not None:
        s = F.ceil(F.col("count") / segment).cast("int")
        seg = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
        # A row goes to every pair of segments that its own is part of.
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda o: F.least(o, F.col("seg")) * F.col("s") + F.greatest(o, F.col("seg"))))
        rows = rows.unionByName(hot.withColumn("s", s).withColumn("seg", seg).select("t", "bits", pair.alias("part"), "fp"))
    rows = rows.select(F.xxhash64("t", "bits", "part").alias("deal"), "t", "bits", "part", "fp")

    def search(batches):
        held = None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            fp = batch.column(4).to_numpy()
            if held is not None:
                key, fp = np.concatenate((held[0], key), axis=1), np.concatenate((held[1], fp))
            # The last bucket may go on in the next batch.
            last = len(fp) - 1
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            cut = new[-1] + 1 if len(new) else 0
            if cut:
                yield from found(key[:, :cut], fp[:cut])
            held = (key[:, cut:], fp[cut:]) if last >= 0 else None
        if held is not None and len(held[1]):
            yield from found(*held)

    def found(key, fp):
        bucket = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))))
        size = np.bincount(bucket)
        some = size[bucket] > 1
        if not some.any():
            return
        index = GrayIndex(bucket[some], fp[some].view(np.uint64))
        far, near = index.links(distance)
        u, v = index.fp.view(np.int64)[far], index.fp.view(np.int64)[near]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    dealt = rows.repartition("deal").sortWithinPartitions("deal", "t", "bits", "part")
    return dealt.mapInArrow(search, "u long, v long").distinct()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(u, v): every node of the links that isn't the least of its component, with the least one.

    Large-star and small-star steps in turn, until a round changes nothing; their number grows with the logarithm
    of the nodes.  The least neighbours are written before they are joined, so that either side of the join has an
    exchange of its own and a hot star's key can be split.
    """

    def star(e: DataFrame, name: str, large: bool) -> DataFrame:
        out = e.where("u > v").unionByName(e.where("u > v").select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.where("u > v")
        least = scratch.write(out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"least-{name}")
        joined = out.join(least, "u")
        if large:
            new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return scratch.write(new.where("u > v").distinct(), f"star-{name}")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()

    edges = scratch.write(edges.where("u > v"), "star-0")
    before, last = state(edges), "star-0"
    for k in range(1, rounds + 1):
        if not before[0]:
            break
        edges = star(star(edges, f"{k}-large", True), f"{k}-small", False)
        for name in (last, f"star-{k}-large", f"least-{k}-large", f"least-{k}-small"):
            scratch.drop(name)
        last = f"star-{k}-small"
        now = state(edges)
        if tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges


def near_groups(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, segment: int = SEGMENT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that links reach, the document's own included; null if none has a number.
    A text without words, or null, has fingerprint 0 and is linked like any other.  Repeated rows each give a row.
    An empty table gives none.  Other columns are not read.
    """
    s = Scratch(spark, "simhash")
    rows = s.write(fingerprints(docs, size), "fingerprints")
    distinct = s.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(spark, links(spark, distinct.select("fp"), s, distance, segment, bucket_rows), s)
    of = s.write(distinct.join(root.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = s.write(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    member = s.write(of.join(least, "root").select("fp", "component_id"), "members")
    s.keep_only("fingerprints", "members")
    return rows.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs of which the component is named after: one document of each group of near copies.

    A row without a doc_id can't be named; it stays.  Of repeated rows of a doc_id, all stay.
    """
    s = Scratch(spark, "simhash")
    name = fresh(docs, "sl_gone")
    gone = s.write(near_groups(spark, docs).where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


QUERY = "op5_simhash_near_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
