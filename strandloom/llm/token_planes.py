"""Token ids in bit-plane files.

A file holds the ids of whole documents, in ascending doc_id order, cut into blocks of a fixed number of ids.  A
block's ids (unsigned, 32 bits) are transposed into planes: four byte planes, or 32 bit planes.  High planes are
nearly constant and low planes keep their statistics, so each plane is compressed by zstandard on its own.  A chunk
index at the end says where each block's planes are, and a document index where each document's ids start.

Layout of a file, all integers little-endian:

    magic "SLPLANE1", then the compressed planes, block by block, plane 0 (lowest) first
    chunk index   for each plane of each block: u32 length of its bytes
    documents     for each: u8 has an id, i64 doc_id, u64 start within the file, u64 number of ids
    footer        u64 ids, u32 documents, u32 ids of a block, u8 planes, u64 place of the chunk index

Files are cells of a Parquet table (file_no, n_ids, n_docs, bytes): Spark's committer then makes each file appear
once and whole whatever executors are lost, and the table can stand in any store that Spark writes to.

How it runs: one range shuffle of texts by (doc_id, hash of the text); each task encodes its range in order and cuts
files of FILE_IDS ids or more at the ends of documents.  Where a document starts among all is the sum of what is
before it: a sum of files' totals in two steps, by groups of files and within them, never one window over everything.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Kept, byte_alphabet, vocabulary_path
from .common import Scratch, as_bytes, hold_only, map_batches, tables_of, text_rows

MAGIC = b"SLPLANE1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 21
END_ID = 1
#: Bytes of the tables that a worker keeps of chunks, words and marks.
CHUNK_BYTES, WORD_BYTES, MARK_BYTES = 256 << 20, 96 << 20, 2 << 20
FOOTER = struct.Struct("<QIIBQ")
DOCUMENT = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("start", "<u8"), ("n", "<u8")])


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of a block of ids: planes = 4 for bytes, 32 for bits."""
    lanes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == 4:
        return [lane.tobytes() for lane in lanes]
    return [np.packbits(lanes[k // 8] >> (k % 8) & 1, bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        lanes = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        lanes = np.stack([sum(bits[8 * k + j] << j for j in range(8)) for k in range(4)]).astype(np.uint8)
    return np.ascontiguousarray(lanes.T).view("<u4").ravel()


class FileWriter:
    """Builds one file; compresses block by block, so that it holds one block of raw ids only."""

    def __init__(self, planes: int = 4, block: int = BLOCK_IDS, level: int = 3):
        self.planes, self.block = planes, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.parts, self.sizes, self.docs, self.held, self.n, self.n_held = [MAGIC], [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        n = len(ids) // 4
        self.docs.append((doc_id is not None, doc_id or 0, self.n, n))
        self.held.append(ids)
        self.n, self.n_held = self.n + n, self.n_held + n
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for k in range(0, len(ids) if last else len(ids) - self.block + 1, self.block):
            for plane in to_planes(ids[k : k + self.block], self.planes):
                packed = self.zstd.compress(plane)
                self.parts.append(packed)
                self.sizes.append(len(packed))
        rest = b"" if last else ids[len(ids) // self.block * self.block :].tobytes()
        self.held, self.n_held = [rest], len(rest) // 4

    def close(self) -> bytes:
        self._flush(True)
        at = sum(map(len, self.parts))
        index = np.array(self.sizes, "<u4").tobytes() + np.array(self.docs, DOCUMENT).tobytes()
        return b"".join([*self.parts, index, FOOTER.pack(self.n, len(self.docs), self.block, self.planes, at)])


def read_file(file: bytes):
    """(doc_id, start within the file, ids) of each document, in order; blocks are unpacked one at a time."""
    if file[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token planes")
    n, n_docs, block, planes, at = FOOTER.unpack(file[-FOOTER.size :])
    n_blocks = -(-n // block)
    sizes = np.frombuffer(file, "<u4", n_blocks * planes, at).reshape(n_blocks, planes)
    docs = np.frombuffer(file, DOCUMENT, n_docs, at + 4 * n_blocks * planes)
    zstd, place, k, held = zstandard.ZstdDecompressor(), len(MAGIC), 0, np.zeros(0, "<u4")
    for doc in docs:
        want, parts = int(doc["n"]), []
        while want > len(held):
            parts.append(held)
            want -= len(held)
            raw = []
            for size in sizes[k].tolist():
                raw.append(zstd.decompress(file[place : place + size]))
                place += size
            held = from_planes(raw, min(block, n - k * block))
            k += 1
        parts.append(held[:want])
        held = held[want:]
        yield (int(doc["doc_id"]) if doc["has_id"] else None), int(doc["start"]), np.concatenate(parts)


#: A word in letters that this tokenizer's normalisation leaves alone but for case, and marks behind it.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-;=?@\[-`{}~]*)")


class WordEncoder:
    """Ids of a text by the tokenizers library, chunk by chunk between white space.

    This tokenizer drops white space, and nothing it does reaches over ASCII white space, so the ids of a text are
    those of its chunks.  Chunks repeat, and each is encoded once while it is kept.  A chunk that is a word of plain
    letters with marks behind it is cut there by the tokenizer too; its word, in small letters, goes straight to the
    library's model, which needs neither normalisation nor pattern.  All other chunks go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.chunks, self.words, self.rest = Kept(self._chunk, CHUNK_BYTES), Kept(self._word, WORD_BYTES), Kept(self._whole, MARK_BYTES)

    def _chunk(self, chunk: bytes) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if not plain:
            return self._whole(chunk)
        word, marks = plain.groups()
        small = word.lower() if word.isascii() else word.decode().lower().encode()
        if not marks and small == word:  # kept as a chunk
            return self._word(word)
        return self.words[small] + self.rest[marks] if marks else self.words[small]

    def _word(self, word: bytes) -> bytes:
        return _packed([t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))])

    def _whole(self, chunk: bytes) -> bytes:
        return _packed(self.library.encode(chunk.decode(), add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker and file."""
    return WordEncoder(path)


tables_of("words", word_encoder.cache_clear)


def write_planes(docs: DataFrame, path: str, tokenizer: str | None = None, planes: int = 4, block: int = BLOCK_IDS, file_ids: int = FILE_IDS, end_id: int = END_ID) -> None:
    """Encode documents and write their files as a table at `path`.

    Documents are in ascending order of doc_id, nulls first; equal ones in order of their texts' hash.
    """
    tokenizer = tokenizer or vocabulary_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, seq, writer = TaskContext.get().partitionId(), 0, None

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([(part << 20) + seq], pa.int64()), pa.array([writer.n], pa.int64()), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.close()], pa.binary())], ["file_no", "n_ids", "n_docs", "bytes"])

        hold_only("words")
        encode = word_encoder(tokenizer).encode
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                writer = writer or FileWriter(planes, block)
                writer.add(doc_id, encode(text) + end)
                if writer.n >= file_ids:
                    yield closed()
                    seq, writer = seq + 1, None
        if writer:
            yield closed()

    rows = text_rows(docs).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(run, "file_no long, n_ids long, n_docs long, bytes binary").write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """(file_no, before): the ids of all files before each, by sums over groups of files and within them."""
    sizes = files.select("file_no", "n_ids").withColumn("g", F.shiftright("file_no", 30))
    groups = sizes.groupBy("g").agg(F.sum("n_ids").alias("sum"))
    before = groups.select("g", (F.sum("sum").over(Window.orderBy("g")) - F.col("sum")).alias("group_before"))
    within = F.sum("n_ids").over(Window.partitionBy("g").orderBy("file_no")) - F.col("n_ids")
    return sizes.withColumn("within", within).join(before, "g").select("file_no", (F.col("within") + F.col("group_before")).alias("before"))


def read_planes(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document of the files at `path`; start counts all ids before it."""
    files = spark.read.parquet(path)

    def run(batch: pa.RecordBatch):
        for no, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out: list[list] = [[] for _ in range(5)]
            held = 0
            for doc_id, start, x in read_file(file.as_py()):
                for column, value in zip(out, (no, doc_id, start, len(x), zlib.crc32(x.tobytes())), strict=True):
                    column.append(value)
                if ids:
                    lists.append(x.astype(np.int64))
                    held += len(x)
                if held > 1 << 20:
                    yield made(out, lists)
                    out, lists[:], held = [[] for _ in range(5)], [], 0
            yield made(out, lists)
            lists.clear()

    lists: list[np.ndarray] = []

    def made(out, lists):
        columns = [pa.array(c, pa.int64()) for c in out]
        names = ["file_no", "doc_id", "at", "n_tokens", "ids_crc32"]
        if ids:
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    rows = map_batches(files.select("file_no", "bytes"), run, "file_no long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))
    return rows.join(_starts(files), "file_no").withColumn("start", F.col("at") + F.col("before")).select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """One row for each document from files written and read back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty and gives the end id alone; a null doc_id stands before all others; equal doc_ids
    are in order of their texts' hash, repeated rows each give a row.  An empty table gives no files and no rows.
    Other columns are not read.  `path` is where the files go, by default the session's scratch folder.
    """
    path = path or Scratch(spark, "token-planes").root + "/files"
    write_planes(docs, path, **options)
    return read_planes(spark, path, ids=False)


QUERY = "op6_token_planes"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
