import random

import numpy as np
import pytest
import xxhash
from helpers import HARD, clashing, docs, words

from strandloom.llm import simhash as op


def brute_fp(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(fps):
    """fps: (doc_id, fp) pairs -> sorted (doc_id, hex, component)."""
    n = len(fps)
    root = list(range(n))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                root[up(a)] = up(b)
    least = {}
    for a in range(n):
        if fps[a][0] is not None:
            least[up(a)] = min(least.get(up(a), fps[a][0]), fps[a][0])
    return sorted(((i, f"{fp:016x}", least.get(up(a))) for a, (i, fp) in enumerate(fps)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_texts_against_brute_force(spark):
    rows = HARD + [(100 + k, words(30, k % 9) + (" tail" if k % 2 else "")) for k in range(80)]
    got = found(op.near_groups(spark, docs(spark, rows)))
    assert got == brute([(i, brute_fp(t)) for i, t in rows])


@pytest.mark.parametrize("segment, bucket_rows", [(512, 64), (5, 64), (40, 1e-12)])
def test_links_against_brute_force(spark, segment, bucket_rows):
    """Dense clusters, chains and far fingerprints; small segments make hot buckets; tiny targets make more fields."""
    r = random.Random(segment)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(40):
            x = c
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    s = op.Scratch(spark, "test")
    edges = op.links(spark, spark.createDataFrame([(x,) for x in signed], "fp long"), s, 3, segment, bucket_rows)
    of = {x: x for x in signed} | {r.u: r.v for r in op.components(spark, edges, s).collect()}
    groups = {}
    for x, fp in zip(signed, fps, strict=True):
        groups.setdefault(of[x], set()).add(fp)
    want = {}
    for i, _, c in brute(list(zip(range(len(fps)), fps, strict=True))):
        want.setdefault(c, set()).add(fps[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_index_alone_against_brute_force():
    r = random.Random(3)
    c = [r.getrandbits(64) for _ in range(4)]
    fp = sorted({c[k % 4] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for k in range(700)})
    index = op.GrayIndex(np.zeros(len(fp), np.int64), np.array(fp, np.uint64))
    far, near = index.links(3)
    label = np.arange(len(fp))
    label[far] = near
    got = {}
    for x, k in zip(index.fp.tolist(), label.tolist(), strict=True):
        got.setdefault(k, set()).add(x)
    want = {}
    for i, _, k in brute(list(enumerate(fp))):
        want.setdefault(k, set()).add(fp[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_of_links(spark):
    s = op.Scratch(spark, "test")
    edges = spark.createDataFrame([(k + 1, k) for k in range(300)], "u long, v long")
    assert {(r.u, r.v) for r in op.components(spark, edges, s).collect()} == {(k, 0) for k in range(1, 301)}


def test_clashing_columns_and_empty_table(spark):
    assert found(op.near_groups(spark, clashing(spark, HARD))) == brute([(i, brute_fp(t)) for i, t in HARD])
    assert op.near_groups(spark, docs(spark, [])).count() == 0
    kept = op.keep_one_of_each(spark, clashing(spark, HARD))
    assert kept.columns == clashing(spark, HARD).columns
    want = [(i, c) for i, _, c in brute([(i, brute_fp(t)) for i, t in HARD]) if i is None or i == c]
    assert kept.count() == len(want)
