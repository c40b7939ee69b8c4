"""Back ends that turn a chunk into bytes: general compressors, entropy coders, field matching.

Storage is Parquet's work; these are for measuring what a pipeline is worth and for chunks kept as binaries.  Each
takes one row a chunk (``serial``) or packs a stream first, and runs chunk by chunk in Arrow.
"""

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import Codec, CodecError, Encoded, per_chunk


class Store(Codec):
    """A stream as it is."""

    name = "store"

    def encode(self, s: DataFrame) -> Encoded:
        return Encoded({"v": s})

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"]


class _Bytes(Codec):
    """Binaries to binaries, row by row in Arrow batches."""

    def pack(self, data: bytes) -> bytes:
        raise NotImplementedError

    def unpack(self, data: bytes) -> bytes:
        raise NotImplementedError

    def encode(self, s: DataFrame) -> Encoded:
        return Encoded({"v": s.withColumn("v", _over(self.pack)(F.col("v").cast("binary")))})

    def decode(self, enc: Encoded) -> DataFrame:
        return enc["v"].withColumn("v", _over(self.unpack)(F.col("v")))


def _over(f):
    """f over binaries in Arrow, value by value into one buffer: Python holds a batch's results once, and no objects."""

    def run(v: pa.Array) -> pa.Array:
        data, ends, valid = bytearray(), np.zeros(len(v) + 1, np.int64), np.ones(len(v), bool)
        for k, x in enumerate(v):
            if x.is_valid:
                data += f(x.as_py())
            else:
                valid[k] = False
            ends[k + 1] = len(data)
        bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
        return pa.Array.from_buffers(pa.large_binary(), len(v), [bits, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())  # fails beyond 2 GB

    return F.arrow_udf(run, T.BinaryType())


class Zstd(_Bytes):
    name = "zstd"

    def __init__(self, level: int = 6):
        self.level = level

    def pack(self, data: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=self.level).compress(data)

    def unpack(self, data: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(data)


class Lz4(_Bytes):
    """LZ4 blocks, with the size before them (eight bytes)."""

    name = "lz4"

    def pack(self, data: bytes) -> bytes:
        return len(data).to_bytes(8, "little") + pa.compress(data, codec="lz4_raw", asbytes=True)

    def unpack(self, data: bytes) -> bytes:
        return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="lz4_raw", asbytes=True)


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of a Huffman code; one bit for a single symbol."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    lengths = Counter()
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        lengths.update(a[2] + b[2])
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return dict(lengths)


def canonical_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) by symbol: codes rise with length, then with the symbol."""
    code, last, out = 0, 0, {}
    for length, s in sorted((n, s) for s, n in lengths.items()):
        code <<= length - last
        out[s] = code, length
        code, last = code + 1, length
    return out


class Huffman(Codec):
    """Symbols (numbers from 0 on) to a canonical Huffman code; code lengths go to the header."""

    name = "huffman"

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg(F.bool_and(F.col("v") >= 0).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        def pack(t: pa.Table) -> pa.Table:
            v = t["v"].to_numpy()
            symbols, counts = np.unique(v, return_counts=True)
            codes = canonical_codes(huffman_lengths(dict(zip(symbols.tolist(), counts.tolist(), strict=True))))
            text = "".join(format(c, f"0{n}b") for c, n in map(codes.__getitem__, v.tolist()))
            data = np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes()
            return pa.table({
                "chunk_id": t["chunk_id"][:1], "pos": pa.array([0]), "v": pa.array([data], pa.binary()), "n": pa.array([len(v)]),
                "symbols": pa.array([sorted(codes)], pa.list_(pa.int64())), "lengths": pa.array([[codes[x][1] for x in sorted(codes)]], pa.list_(pa.int32())),
            })

        x = per_chunk(s.withColumn("v", F.col("v").cast("long")), pack, "chunk_id long, pos long, v binary, n long, symbols array<long>, lengths array<int>")
        return Encoded({"v": x.select("chunk_id", "pos", "v")}, x.select("chunk_id", "n", "symbols", "lengths"))

    def decode(self, enc: Encoded) -> DataFrame:
        def unpack(t: pa.Table) -> pa.Table:
            r = t.to_pylist()[0]
            of = {(n, c): s for s, (c, n) in canonical_codes(dict(zip(r["symbols"], r["lengths"], strict=True))).items()}
            bits = np.unpackbits(np.frombuffer(r["v"], np.uint8)).tolist()
            out, code, n = [], 0, 0
            for b in bits:
                code, n = code << 1 | b, n + 1
                if (n, code) in of:
                    out.append(of[n, code])
                    code = n = 0
                    if len(out) == r["n"]:
                        break
            return pa.table({"chunk_id": pa.array([r["chunk_id"]] * len(out), pa.int64()), "pos": pa.array(np.arange(len(out))), "v": pa.array(out, pa.int64())})

        return per_chunk(enc["v"].join(enc.header, "chunk_id"), unpack, "chunk_id long, pos long, v long")


#: Slots of the state coder's table.
SLOTS = 1 << 12


def scaled_counts(counts: dict[int, int], slots: int = SLOTS) -> dict[int, int]:
    """Counts that add up to `slots`, at least one for each symbol."""
    if len(counts) > slots:
        raise CodecError(f"more than {slots} symbols")
    total = sum(counts.values())
    out = {s: max(1, n * slots // total) for s, n in counts.items()}
    order = sorted(out, key=lambda s: (-out[s], s))
    k = 0
    while (rest := slots - sum(out.values())) != 0:
        s = order[k % len(order)]
        if rest > 0:
            out[s] += rest if k == 0 else 1
        elif out[s] > 1:
            out[s] -= min(-rest, out[s] - 1) if k == 0 and out[s] + rest >= 1 else 1
        k += 1
    return out


class Fse(Codec):
    """Symbols to a state code (range asymmetric numeral system) with SLOTS slots; scaled counts go to the header."""

    name = "fse"

    def encode(self, s: DataFrame) -> Encoded:
        def pack(t: pa.Table) -> pa.Table:
            v = t["v"].to_pylist()
            freq = scaled_counts(Counter(v))
            start, at = {}, 0
            for x in sorted(freq):
                start[x], at = at, at + freq[x]
            state, out = 1 << 23, bytearray()
            for x in reversed(v):
                f = freq[x]
                while state >= (f << 19):
                    out.append(state & 255)
                    state >>= 8
                state = (state // f << 12) + state % f + start[x]
            data = state.to_bytes(4, "little") + bytes(reversed(out))
            return pa.table({
                "chunk_id": t["chunk_id"][:1], "pos": pa.array([0]), "v": pa.array([data], pa.binary()), "n": pa.array([len(v)]),
                "symbols": pa.array([sorted(freq)], pa.list_(pa.int64())), "counts": pa.array([[freq[x] for x in sorted(freq)]], pa.list_(pa.int32())),
            })

        x = per_chunk(s.withColumn("v", F.col("v").cast("long")), pack, "chunk_id long, pos long, v binary, n long, symbols array<long>, counts array<int>")
        return Encoded({"v": x.select("chunk_id", "pos", "v")}, x.select("chunk_id", "n", "symbols", "counts"))

    def decode(self, enc: Encoded) -> DataFrame:
        def unpack(t: pa.Table) -> pa.Table:
            r = t.to_pylist()[0]
            slot, start, at = [], {}, 0
            for x, f in zip(r["symbols"], r["counts"], strict=True):
                start[x], at = at, at + f
                slot += [x] * f
            freq = dict(zip(r["symbols"], r["counts"], strict=True))
            data, k, out = r["v"], 4, []
            state = int.from_bytes(data[:4], "little")
            for _ in range(r["n"]):
                x = slot[state & (SLOTS - 1)]
                out.append(x)
                state = freq[x] * (state >> 12) + (state & (SLOTS - 1)) - start[x]
                while state < 1 << 23 and k < len(data):
                    state = state << 8 | data[k]
                    k += 1
            return pa.table({"chunk_id": pa.array([r["chunk_id"]] * len(out), pa.int64()), "pos": pa.array(np.arange(len(out))), "v": pa.array(out, pa.int64())})

        return per_chunk(enc["v"].join(enc.header, "chunk_id"), unpack, "chunk_id long, pos long, v long")


class FieldLz(Codec):
    """Matches of whole fields: literals, tokens, offsets and the overflow of lengths, five streams.

    A token packs a count of literals and a match length over the least, four bits each; 15 means that the rest of
    the count is the next value of its overflow stream.  Matches are found greedily by the last place of each triple.
    """

    name = "field_lz"
    LEAST = 3
    OUTPUTS = ("literals", "tokens", "offsets", "more_literals", "more_match")

    def encode(self, s: DataFrame) -> Encoded:
        least = self.LEAST

        def pack(t: pa.Table) -> pa.Table:
            v = t["v"].to_pylist()
            seen: dict[tuple, int] = {}
            out: dict[str, list[int]] = {k: [] for k in self.OUTPUTS}
            at = start = 0

            def emit(literals: int, match: int, offset: int) -> None:
                out["literals"] += v[start : start + literals]
                a, b = min(literals, 15), min(match - least, 15) if match else 0
                out["tokens"].append(a << 4 | b)
                if a == 15:
                    out["more_literals"].append(literals - 15)
                if match and b == 15:
                    out["more_match"].append(match - least - 15)
                if match:
                    out["offsets"].append(offset)

            while at + least <= len(v):
                key = tuple(v[at : at + least])
                before = seen.get(key)
                seen[key] = at
                if before is None:
                    at += 1
                    continue
                n = least
                while at + n < len(v) and v[before + n] == v[at + n]:
                    n += 1
                emit(at - start, n, at - before)
                at += n
                start = at
            if start < len(v):
                emit(len(v) - start, 0, 0)
            rows = [(name, k, x) for name, xs in out.items() for k, x in enumerate(xs)]
            return pa.table({"chunk_id": pa.array([t["chunk_id"][0].as_py()] * len(rows), pa.int64()), "out": [r[0] for r in rows], "pos": pa.array([r[1] for r in rows], pa.int64()), "v": pa.array([r[2] for r in rows], pa.int64())})

        x = per_chunk(s.withColumn("v", F.col("v").cast("long")), pack, "chunk_id long, out string, pos long, v long")
        return Encoded({name: x.where(F.col("out") == name).select("chunk_id", "pos", "v") for name in self.OUTPUTS})

    def decode(self, enc: Encoded) -> DataFrame:
        least, every = self.LEAST, None
        for k, name in enumerate(self.OUTPUTS):
            part = enc[name].select("chunk_id", "pos", "v", F.lit(k).alias("out"))
            every = part if every is None else every.unionByName(part)

        def unpack(t: pa.Table) -> pa.Table:
            xs: list[list[int]] = [[] for _ in self.OUTPUTS]
            for k, v in zip(t["out"].to_pylist(), t["v"].to_pylist(), strict=True):
                xs[k].append(v)
            literals, tokens, offsets, more_literals, more_match = (iter(x) for x in xs)
            out: list[int] = []
            left = len(xs[2])
            for token in tokens:
                n = token >> 4
                n += next(more_literals) if n == 15 else 0
                out += [next(literals) for _ in range(n)]
                if left:
                    left -= 1
                    m = token & 15
                    m += least + (next(more_match) if m == 15 else 0)
                    back = next(offsets)
                    for _ in range(m):
                        out.append(out[-back])
            return pa.table({"chunk_id": pa.array([t["chunk_id"][0].as_py()] * len(out), pa.int64()), "pos": pa.array(np.arange(len(out))), "v": pa.array(out, pa.int64())})

        return per_chunk(every, unpack, "chunk_id long, pos long, v long")


class Entropy(Codec):
    """Bytes (numbers 0 to 255) by the back end that the cost rule names, chunk by chunk.

    mode: "any", or "huffman" or "fse" to settle the entropy coder.
    """

    name = "entropy"

    def __init__(self, mode: str = "any"):
        self.mode = mode

    @staticmethod
    def _ways() -> dict[str, Codec]:
        from .dictionary import Constant, FlatPack
        from .numeric import BitPack

        return {"store": Store(), "constant": Constant(), "bitpack": BitPack(), "flatpack": FlatPack(), "huffman": Huffman(), "fse": Fse()}

    def check(self, s: DataFrame) -> DataFrame:
        return s.groupBy("chunk_id").agg(F.bool_and(F.col("v").between(0, 255)).alias("ok"))

    def encode(self, s: DataFrame) -> Encoded:
        from ..functions.statistics import byte_statistics
        from .selectors import byte_backend

        x = byte_statistics(s)
        choice = x.select("chunk_id", byte_backend(F.col("n"), F.col("distinct"), F.col("top"), F.col("entropy"), self.mode).alias("way"))
        streams, inner = {}, {}
        for name, codec in self._ways().items():
            enc = codec.encode(s.join(choice.where(F.col("way") == name).select("chunk_id"), "chunk_id", "left_semi"))
            streams |= {f"{name}.{k}": v for k, v in enc.streams.items()}
            if enc.header is not None:
                streams[f"{name}#"] = enc.header
            inner[name] = {"names": list(enc.streams), "params": enc.params}
        return Encoded(streams, choice, {"ways": inner})

    def decode(self, enc: Encoded) -> DataFrame:
        out = None
        for name, codec in self._ways().items():
            w = enc.params["ways"][name]
            part = codec.decode(Encoded({k: enc[f"{name}.{k}"] for k in w["names"]}, enc.streams.get(f"{name}#"), w["params"])).select("chunk_id", "pos", "v")
            out = part if out is None else out.unionByName(part)
        return out


def stored_size(s: DataFrame, level: int = 3) -> DataFrame:
    """chunk_id, bytes: what a chunk of numbers takes as zstandard-compressed 64-bit values."""

    def run(t: pa.Table) -> pa.Table:
        data = t["v"].to_numpy().astype("<i8").tobytes()
        return pa.table({"chunk_id": t["chunk_id"][:1], "bytes": pa.array([len(zstandard.ZstdCompressor(level=level).compress(data))], pa.int64())})

    return per_chunk(s.withColumn("v", F.col("v").cast("long")), run, "chunk_id long, bytes long")
