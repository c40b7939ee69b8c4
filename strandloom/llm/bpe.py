"""Byte-level BPE by backtracking, encoding and decoding.

Encoder: an Aho-Corasick automaton over the vocabulary finds every token in a piece of text, and so the longest one
at each place.  Tokens are laid from left to right, the longest first.  A token may follow another only if the two
are compatible, that is, if merging their bytes by rank gives exactly these two; that is read off the pair table (the
merges) by walking down the right edge of the one and the left edge of the other.  An incompatible token gives way
to its longest shorter prefix; a place from which nothing fits is marked and left for good.  So each place is tried a
bounded number of times, and the result is the one that merging in order of rank gives.

Decoder: all tokens' bytes stand in one string with an offset table; ids become bytes by gathering.

Text is cut as the tokenizer file asks: special tokens first, then pieces of the usual pattern.  A space with no
white space on either side always starts a piece, so texts are cut there and the chunks' ids kept in a table of
bounded size (it is emptied when full); a text whose spaces aren't all of that kind goes through the pattern whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, tables_of, text_rows

#: Bytes of a table of chunks, or pieces, that a worker keeps.
KEPT_BYTES = 96 << 20
#: What an entry of such a table takes but for its letters: its place, and what its key and value are headed by.
ENTRY_BYTES = 180
#: Pairs of tokens of which a worker keeps whether they fit.
KEPT_PAIRS = 200_000
#: Letters with ASCII marks behind them, none of which begins a contraction or a special token.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+)([!-&(-/:;=-@\\[-`{-~]*)")
#: The pieces of byte-level BPE (fixed values of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizers file: tokens by id, merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letter = file["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        raw = {i: t for t, i in model["vocab"].items() if t not in self.special}
        n = max([*raw, *self.special.values()]) + 1
        self.tokens = [bytes(letter[c] for c in raw[i]) if i in raw else b"" for i in range(n)]
        # The decoder reads a special token's letters as it reads any token's.
        for t, i in self.special.items():
            self.tokens[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
        self.pair: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(n)), list(range(n))
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.pair[x, y] = z
            self.left[z], self.right[z] = x, y
        if any(z <= max(xy) for xy, z in self.pair.items()):
            raise ValueError("ids must rise with the rank of the merge that makes them")
        self.automaton = ahocorasick.Automaton()
        for i in raw:
            self.automaton.add_word(self.tokens[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        at = {self.tokens[i]: i for i in raw}
        self.shorter = [-1] * n
        for i in raw:
            t = self.tokens[i]
            self.shorter[i] = next((at[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in at), -1)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = [len(t) for t in self.tokens]
        self.length = np.array(self.sizes, np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.fits: dict[int, bool] = {}  # of a * tokens + b

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged by rank, come out as a and b."""
        bound = len(self.tokens)
        key = a * bound + b
        if (known := self.fits.get(key)) is not None:
            return known
        ok = None
        while ok is None:
            joined = self.pair.get((a, b))
            if joined is not None and joined < bound:
                ok = False
            elif a > b:  # a was made later: look at the time before its last merge
                bound, a = a, self.right[a]
                if a == bound:
                    bound, b = b + 1, self.left[b]
                    ok = True if b + 1 == bound else None
            else:
                bound, b = b + 1, self.left[b]
                if b + 1 == bound:
                    bound, a = a, self.right[a]
                    ok = True if a == bound else None
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        n, size, fits, tokens = len(piece), self.sizes, self.fits.get, len(self.tokens)
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token
        token = longest[0]
        if size[token] == n:  # a token's bytes merge to it
            return [token]
        out, at, last = [token], size[token], token
        dead = None
        token = longest[at]
        while True:
            to = at + size[token]
            if (dead is None or not dead[to]) and (not out or (self.compatible(last, token) if (fit := fits(last * tokens + token)) is None else fit)):
                out.append(token)
                if to == n:
                    return out
                at, last, token = to, token, longest[to]
            elif (less := self.shorter[token]) >= 0:
                token = less
            else:
                dead = dead or bytearray(n + 1)
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered through the offset table."""
        ids = ids.astype(np.int64)
        n = self.length[ids]
        if not len(ids):
            return b""
        shift = np.repeat(self.offset[ids] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return self.blob[shift + np.arange(len(shift))].tobytes()


class Kept(dict):
    """Results by chunk, of `most` bytes in all.  What would fill much of it isn't kept.

    Full by half, it becomes the older half and is emptied; what is asked for again comes back from there.
    """

    def __init__(self, make, most: int = KEPT_BYTES):
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def __missing__(self, chunk):
        value = self.older.get(chunk, _ABSENT)
        if value is _ABSENT:
            value = self.make(chunk)
        size = ENTRY_BYTES + 4 * len(chunk)  # ids are four bytes, and seldom more than half as many as letters
        if size > self.most >> 8:
            return value
        self.held += size
        if self.held > self.most >> 1:
            self.older = dict(self)
            self.clear()
            self.held = size
        self[chunk] = value
        return value


_ABSENT = object()


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pieces = regex.compile(PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.edge = regex.compile(r"^\s|\s$|^$")
        self.first, self.later, self.whole = Kept(self._encode, KEPT_BYTES // 8), Kept(self._later), Kept(self._piece)

    def _piece(self, piece: str) -> bytes:
        ids = self.vocabulary.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, text: str) -> bytes:
        parts = self.special.split(text) if self.special else [text]
        known, out = self.vocabulary.special, []
        for k, part in enumerate(parts):
            out += [np.array([known[part]], "<u4").tobytes()] if k % 2 else map(self.whole.__getitem__, self.pieces.findall(part))
        return b"".join(out)

    def _later(self, chunk: str) -> bytes | None:
        """Of a chunk that follows a space; None if the space has white space beside it."""
        if plain := PLAIN.fullmatch(chunk):  # two pieces by the pattern
            word, marks = plain.groups()
            return self.whole[" " + word] + self.whole[marks] if marks else self._piece(" " + word)
        return None if self.edge.search(chunk) else self._encode(" " + chunk)

    def encode(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if not rest:
            return self._encode(text)
        found = [*map(self.later.__getitem__, rest)]
        if None in found or self.edge.search(head):
            return self._encode(text)
        return b"".join((self.first[head], *found))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)


tables_of("pieces", encoder.cache_clear)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are those of the tokenizer file at `path` (each worker reads it from its own installation) without added
    special tokens; a special token's own letters in a text are that token.  A null text counts as empty and gives no
    ids.  ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the text decoded from the ids.
    Repeated rows each give a row, an empty table none; other columns are not read.  Texts of any length are encoded
    whole.  There is no shuffle and no state but a bounded table of chunks in each worker.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        n, ids_sha, text_sha = [], [], []
        for text in batch.column(1).to_pylist():
            ids = np.frombuffer(e.encode(text or ""), "<u4")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
            text_sha.append(hashlib.sha256(e.vocabulary.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(text_rows(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "pieces")


def encode(docs: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """docs with their ids in a further column, an array of integers."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    ids = F.pandas_udf(lambda texts: texts.map(lambda t: np.frombuffer(encoder(path).encode(t or ""), "<u4").astype(np.int32)), "array<int>")
    return docs.withColumn(column, ids("text"))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", column: str = "text") -> DataFrame:
    """rows with the text of their ids in a further column; null ids give null."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    text = F.pandas_udf(lambda x: x.map(lambda v: None if v is None else encoder(path).vocabulary.decode(np.asarray(v, np.int64)).decode("utf-8", "replace")), "string")
    return rows.withColumn(column, text(ids))


QUERY = "op9_bpe_encode_decode"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
