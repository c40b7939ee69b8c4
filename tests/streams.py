"""Streams for tests: chunks of edge cases and seeded random values."""

import random

INT_EDGE = {
    0: [5], 1: [7] * 20, 2: [-(1 << 63), (1 << 63) - 1, 0, -1, 1, -(1 << 63)], 3: list(range(50)), 4: [0] * 9,
    5: [6, -12, 18, 600], 6: [3, 1, 2, 9, 4, 4, 5],
}
STRING_EDGE = {
    0: [""], 1: ["a", "ab", "abc", "abd", "", "x"], 2: ["é", "èa", "é\x00", "\x00", "💥", "💥💥"], 3: ["1", "-1", "0", "-0", "01", "+1", " 1", "1\n", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "1.0"],
    4: ["same"] * 12, 5: ["12", "345", "-7"],
}


def ints(seed=1, width=64):
    r = random.Random(seed)
    lo, hi = -(1 << (width - 1)), (1 << (width - 1)) - 1
    out = {k: [min(max(x, lo), hi) for x in v] for k, v in INT_EDGE.items()}
    for k in range(10, 16):
        span = r.choice([2, 100, 1 << 20, hi])
        out[k] = [r.randint(max(lo, -span), min(hi, span)) for _ in range(r.randrange(1, 300))]
    return out


def naturals(top=1 << 32, seed=2, least=0):
    r = random.Random(seed)
    return {k: [r.randrange(least, r.choice([least + 2, 300, top])) for _ in range(r.randrange(1, 200))] for k in range(8)} | {90: [least], 91: [top - 1] * 3}


def make(spark, chunks, kind="long"):
    rows = [(c, p, v) for c, vs in chunks.items() for p, v in enumerate(vs)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, f"chunk_id long, pos long, v {kind}").repartition(3)


def read(df):
    """{chunk: values in order}, with places checked."""
    out = {}
    for r in sorted(df.select("chunk_id", "pos", "v").collect(), key=lambda r: (r.chunk_id, r.pos)):
        values = out.setdefault(r.chunk_id, [])
        assert r.pos == len(values), (r.chunk_id, r.pos)
        values.append(bytes(r.v) if isinstance(r.v, (bytes, bytearray)) else r.v)
    return out


def ok(df):
    return {r.chunk_id: r.ok for r in df.collect()}
