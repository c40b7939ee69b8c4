"""Toxicity by noisy-channel deobfuscation.

Writers hide words behind look-alike signs ("1d10t"), inserted spaces or dots ("i d i o t", "i.d.i.o.t") and
repeated letters ("idiooot").  What was seen is a lattice: each sign may stand for itself, for letters it looks like,
for a word boundary or for nothing, each at a cost (the channel).  A character trigram model counted over the whole
corpus (the source) weighs letter sequences.  Viterbi decoding finds the cheapest reading of a lattice, and restored
words are scored.  Chunks of letters only are words as they stand; a word with doubled letters is scored with one
letter for each run too, in training as well, so that "iidioott" meets "idiot" and "worrthless" meets "worthless".
Chunks of two characters at most, whatever marks are around them, are fragments; those in a row are decoded together,
each space a boundary or nothing, and scored as one word too.  A chunk without a letter is decoded if it has ALL_LOOKS
look-alikes.

Scoring: features are whole words and their beginnings and endings of 3 to 6 letters; a feature's weight is the lower
bound of its log odds between toxic and clean documents.  A logistic model turns a document's two strongest words and
two strongest parts of words into a probability.  Weights come from one part of the training rows and the logistic
model from another, so that it sees how chance features behave on texts they weren't chosen on.

Bounds (parameters): FIT_ROWS labelled training rows of each class at most are fitted on, the first by a hash of
doc_id; the trigram model has SIGNS ** 3 cells.  These and the features that the fitted texts make weighty (each is in
several of at most FIT_ROWS toxic texts) alone reach the driver; a decoder holds only what its live states differ in.
Corpus counts and scores cover every document, whole.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Kept
from .common import Scratch, hold_only, map_batches, text_rows

FIT_ROWS = 10_000
#: Signs of the trigram model: 0 a boundary, 1-26 a-z, 27-58 the small letters of Latin-1, 59 other letters.
SIGNS = 64
#: What a sign may stand for, besides itself (fixed values, common look-alikes).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "%": "x",
}
#: Costs of the channel, in nats.
AS_LETTER, AS_BOUNDARY, AT_EDGE, DROPPED, DOUBLED = 1.0, 3.0, 3.5, 2.0, 1.0
#: Signs that are rarely mere marks where they begin or end a chunk with letters.
OFTEN_LETTERS = "0123456789@$"
EDGES = tuple(range(3, 7))
#: Bytes of a worker's tables of chunks and of rows of fragments, and features counted before they are handed on.
CHUNK_BYTES, ROW_BYTES, COUNTED = 64 << 20, 4 << 20, 100_000
#: Steps of a decoding after which what all readings have in common is settled.
SETTLE = 1024
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
_FRAGMENTS = re.compile(b"\x01\x01+")
#: Marks that a fragment may have around it.
_MARKS = "!|<(+" + "".join(c for c in string.punctuation if c not in LOOKS)
#: Look-alikes of two kinds at least that a chunk without a letter must have to be read as a word.
ALL_LOOKS = 3
#: The most characters of a chunk that may be part of a spelled-out word, and of a row of two such chunks the least.
FRAGMENT, TWO_FRAGMENTS = 2, 4


def sign(c: str) -> int:
    c = c.lower()[:1]  # one letter in all but one case, where marks follow it
    if "a" <= c <= "z":
        return ord(c) - 96
    if "ß" <= c <= "ÿ" and c != "÷":
        return ord(c) - 0xDF + 27
    return 59 if len(c) == 1 and c.isalpha() else 0


@lru_cache(1)
def _sign_table() -> np.ndarray:
    return np.array([0 if 0xD800 <= k < 0xE000 else sign(chr(k)) for k in range(0x10000)], np.int32)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(cell, n): trigrams of signs over all texts; runs of boundaries count as one."""

    def run(batches):
        hold_only(None)
        total, held, n_held = np.zeros(SIGNS**3, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "replace"), "<u4")
                signs = _sign_table()[np.minimum(codes, 0xFFFF)]
                signs = signs[np.concatenate(([True], (signs[1:] != 0) | (signs[:-1] != 0)))]
                if len(signs) > 2:
                    cells = (signs[:-2] * SIGNS + signs[1:-1]) * SIGNS + signs[2:]
                    held.append(cells)
                    n_held += len(cells)
                if n_held > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=SIGNS**3)
                    held, n_held = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SIGNS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


@lru_cache(1 << 14)
def _readings(c: str, n: int, inside: bool) -> tuple[tuple[str, float], ...]:
    """Readings and costs of a sign that stands n times (3: or more) in a row, within a chunk or at its edge."""
    if c.isalpha():
        return ((c, 0.0),) if n == 1 else ((c * 2, 0.0), (c, DROPPED)) if n == 2 else ((c, 0.0), (c * 2, DOUBLED))
    out = [(" ", AS_BOUNDARY if inside else AT_EDGE if c in OFTEN_LETTERS else 0.0)]
    if inside and not c.isdigit():
        out.append(("", DROPPED if n == 1 else AS_BOUNDARY))
    out += [(x, AS_LETTER) for x in LOOKS.get(c, "")]
    out += [(x * 2, AS_LETTER + DOUBLED) for x in LOOKS.get(c, "") if n > 1]
    return tuple(out)


@lru_cache(1 << 14)
def _signs(reading: str) -> tuple[int, ...]:
    return tuple(map(sign, reading))


def _chain(link: list | None) -> list[list]:
    """The links from the first to this one."""
    out = []
    while link:
        out.append(link)
        link = link[1]
    return out[::-1]


def _settled(states: dict, settled: list[str]) -> dict:
    """The states without the links that they all share, whose readings are added to `settled`."""
    chains = {at: _chain(link) for at, (_, link) in states.items()}
    one = next(iter(chains.values()))
    n = 0
    while n < len(one) and all(c[n] is one[n] for c in chains.values()):
        n += 1
    if not n:
        return states
    settled += (link[0] for link in one[:n])
    if n == len(one):
        return {at: (total, None) for at, (total, _) in states.items()}
    for c in chains.values():
        c[n][1] = None
    return states


class Channel:
    """Decodes chunks of text with the trigram model."""

    def __init__(self, cells: np.ndarray, n: np.ndarray):
        counts = np.zeros(SIGNS**3)
        counts[cells] = n
        counts = counts.reshape(SIGNS, SIGNS, SIGNS)
        two = counts.sum(axis=0)
        back = (two + 0.1) / (two.sum(axis=1, keepdims=True) + 0.1 * SIGNS)
        known = counts.sum(axis=2, keepdims=True)
        self.cost = (-np.log((counts + 5.0 * back[None]) / (known + 5.0))).ravel().tolist()

    @staticmethod
    def lattice(seen: str) -> list[tuple[tuple[str, float], ...]]:
        """For each run of a sign its readings and their costs; a space is a boundary."""
        text, out, k = seen.lower(), [], 0
        n = len(text)
        while k < n:
            end = k + 1
            while end < n and text[end] == text[k]:
                end += 1
            out.append(_readings(text[k], min(end - k, 3), 0 < k and end < n))
            k = end
        return out

    def decode(self, lattice: list[tuple[tuple[str, float], ...]]) -> str:
        """The cheapest reading, by Viterbi over the last two signs.

        A state's reading is a chain of links to what came before; chains that no state needs go by themselves, and
        what all states have in common is settled every SETTLE steps.
        """
        cost, s2 = self.cost, SIGNS * SIGNS
        states: dict[tuple[int, int], tuple[float, list | None]] = {(0, 0): (0.0, None)}
        settled: list[str] = []
        for step, readings in enumerate(chain(lattice, [((" ", 0.0),)]), 1):
            ways = [(reading, channel, _signs(reading)) for reading, channel in readings]
            new: dict[tuple[int, int], tuple[float, list | None, str]] = {}
            for (a0, b0), (so_far, link) in states.items():
                for reading, channel, signs in ways:
                    a, b, total = a0, b0, so_far + channel
                    for x in signs:
                        if x or b:  # a boundary after a boundary is the same one
                            total += cost[a * s2 + b * SIGNS + x]
                            a, b = b, x
                    known = new.get((a, b))
                    if known is None or total < known[0]:
                        new[a, b] = total, link, reading
            states = {at: (total, [reading, link]) for at, (total, link, reading) in new.items()}
            if not step % SETTLE:
                states = _settled(states, settled)
        best = min(states, key=lambda k: (states[k][0], k))
        settled += (link[0] for link in _chain(states[best][1]))
        return "".join(settled[:-1])  # but for the boundary at the end

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk between white space; decoded if it has signs within, or letters repeated three times."""
        core = within_marks(chunk.lower())
        if core.isalpha():
            if not _TRIPLE.search(core):
                return [core]
        elif not any(map(str.isalpha, core)):
            looks = [c for c in core if c in LOOKS]
            if len(looks) < ALL_LOOKS or len(set(looks)) < 2:
                return []
        return self.decode(self.lattice(core)).split()

    def readings(self, chunk: str) -> list[str]:
        """The words of a chunk, and each with its repeated letters taken as one."""
        return with_single_letters(self.words(chunk))

    def row_readings(self, fragments: tuple[str, ...]) -> list[str]:
        """The words of short chunks in a row as they are cheapest, and as one word: all of them, and those between marks."""
        cut = "".join(within_marks(f) + " " * (f[-1:] not in LOOKS and not f[-1:].isalnum()) for f in fragments).split()
        joined = {"".join(cut), *cut} if len(cut) > 1 else cut
        return with_single_letters([*self.spaced(list(fragments)), *(w for c in sorted(joined) for w in self.words(c))])

    def spaced(self, fragments: list[str]) -> list[str]:
        """The words of short chunks in a row: each space between them is a boundary or nothing."""
        lattice = []
        for k, fragment in enumerate(fragments):
            if k:
                lattice.append([("", DROPPED / 2), (" ", DROPPED / 2)])
            for c in fragment:
                lattice.append([(c.lower(), 0.0)] if c.isalpha() else [(x, AS_LETTER) for x in LOOKS.get(c, "")] + [(" ", AS_LETTER)])
        return self.decode(lattice).split()


def with_single_letters(words: list[str]) -> list[str]:
    """A doubled letter may be the word's own or a repetition: words as they stand, and with one letter for each run."""
    return words + [_RUN.sub(r"\1", w) for w in words if _RUN.search(w)]


def within_marks(chunk: str) -> str:
    """A chunk without the marks at its ends that aren't look-alikes."""
    a, b = 0, len(chunk)
    if b and chunk[0].isalnum() and chunk[-1].isalnum():
        return chunk
    while a < b and not chunk[a].isalnum() and chunk[a] not in LOOKS:
        a += 1
    while b > a and not chunk[b - 1].isalnum() and chunk[b - 1] not in LOOKS:
        b -= 1
    return chunk[a:b]


def is_fragment(chunk: str) -> bool:
    """Whether a chunk may be part of a spelled-out word: short, without the marks around it."""
    if len(chunk) <= FRAGMENT:
        return True
    core = chunk.strip(_MARKS)  # most chunks need no more
    return not (core.isalnum() and len(core) > FRAGMENT) and 0 < len(within_marks(chunk).strip("!|<(+")) <= FRAGMENT


def spelled_out(chunks: list[str]) -> list[list[str]]:
    """Runs of three or more fragments, or of two with TWO_FRAGMENTS characters, with a letter among them."""
    runs = _FRAGMENTS.finditer(bytes([len(c) <= FRAGMENT or (not c.isalnum() and is_fragment(c)) for c in chunks]))
    out = [chunks[m.start() : m.end()] for m in runs]
    return [run for run in out if (len(run) > 2 or sum(map(len, run)) >= TWO_FRAGMENTS) and any(map(str.isalpha, "".join(run)))]


def features(word: str) -> list[str]:
    n = len(word)
    return [f"^{word}$", *[f"^{word[:k]}" for k in EDGES if k < n], *[f"{word[-k:]}$" for k in EDGES if k < n]]


class Scorer:
    def __init__(self, channel: Channel, weights: dict[str, float], logistic: np.ndarray | None = None):
        self.channel, self.weights, self.logistic = channel, weights, logistic
        # By kind of feature: whole words, beginnings, endings.
        self.whole = {f[1:-1]: w for f, w in weights.items() if f[0] == "^" and f[-1] == "$"}
        self.first = {f[1:]: w for f, w in weights.items() if f[-1] != "$"}
        self.last = {f[:-1]: w for f, w in weights.items() if f[0] != "^"}
        self.of = Kept(self._chunk, CHUNK_BYTES)
        self.row = Kept(lambda run: self.weight(channel.row_readings(run)), ROW_BYTES)

    def weight(self, words: list[str]) -> tuple[float, float] | None:
        """The largest weight of a whole word, and of a beginning or an ending; None for nothing of weight."""
        get, first, last, whole, part = self.whole.get, self.first.get, self.last.get, 0.0, 0.0
        for w in words:
            if (x := get(w, 0.0)) > whole:
                whole = x
            for k in EDGES:
                if k >= len(w):
                    break
                if (x := first(w[:k], 0.0)) > part:
                    part = x
                if (x := last(w[-k:], 0.0)) > part:
                    part = x
        return (whole, part) if whole or part else None

    def _chunk(self, chunk: str) -> tuple[float, float] | None:
        return None if len(chunk) == 1 else self.weight(self.channel.readings(chunk))

    def signals(self, text: str) -> tuple[float, ...]:
        """The two strongest whole words, and the two strongest beginnings or endings, of different places in the text."""
        chunks = text.split()
        found = [w for w in map(self.of.__getitem__, chunks) if w]
        found += [w for run in spelled_out(chunks) if (w := self.row[tuple(run)])]
        whole, part = (sorted(x)[-2:] for x in zip((0.0, 0.0), (0.0, 0.0), *found, strict=True))
        return whole[1], whole[0], part[1], part[0]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([(1.0, *self.signals(t)) for t in texts]).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and slopes; a signal of toxicity never counts against it, so one whose slope is negative is left out."""
    x = np.column_stack((np.ones(len(x)), x))
    used = np.ones(x.shape[1], bool)
    while True:
        z, b = x[:, used], np.zeros(used.sum())
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * b)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        out = np.zeros(x.shape[1])
        out[used] = b
        if (out[1:] >= 0).all():
            return out
        used[1 + np.argmin(out[1:])] = False


def held_out(doc_id):
    """Whether crc32 of the doc_id's text leaves 0 when divided by 5; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """The model: trigrams of all documents, weights and logistic model of labelled rows that aren't held out."""
    s = Scratch(spark, "toxicity")
    docs = text_rows(docs)
    cells = trigram_counts(docs).toArrow()  # SIGNS ** 3 rows at most
    channel = Channel(cells["cell"].to_numpy(), cells["n"].to_numpy())

    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    one = one.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = [one.where(F.col("toxic") == k).withColumn("o", order).orderBy("o", "doc_id").limit(fit_rows).drop("o") for k in (0, 1)]
    chosen = s.write(chosen[0].unionByName(chosen[1]), "chosen")  # 2 * fit_rows rows at most
    texts = docs.join(F.broadcast(chosen), "doc_id").withColumn("second", F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")) % 3 == 0)
    texts = s.write(texts.select("doc_id", "text", "toxic", "second"), "texts").repartition("doc_id")

    def listed(words: list[str]) -> str:
        return " ".join({f: None for w in words for f in features(w)})

    def count(batches):
        hold_only(None)
        seen = Counter(), Counter()
        kept = Kept(lambda chunk: listed(channel.readings(chunk)), CHUNK_BYTES)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunks, found = (text or "").split(), set()
                for chunk in set(chunks):
                    found.update(kept[chunk].split())
                for run in spelled_out(chunks):
                    found.update(listed(channel.row_readings(tuple(run))).split())
                seen[toxic].update(found)
                if len(seen[0]) + len(seen[1]) > COUNTED:
                    yield from counted(seen)
        yield from counted(seen)

    def counted(seen):
        clean, toxic = seen
        names = list({**clean, **toxic})
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[f] for f in part], pa.int64()), pa.array([clean[f] for f in part], pa.int64())], ["feature", "t", "c"])
        clean.clear()
        toxic.clear()

    first = texts.where("NOT second")
    n = {r["toxic"]: r["count"] for r in first.groupBy("toxic").count().collect()}
    nt, nc = n.get(1, 0), n.get(0, 0)
    counts = first.select("text", "toxic").mapInArrow(count, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    weight = F.log(t / (nt + 1.0)) - F.log(c / (nc + 1.0)) - 1.64 * F.sqrt(1 / t + 1 / c)
    best = counts.where("t > 1").withColumn("w", weight).where("w > 0.3").select("feature", "w").collect()
    scorer = Scorer(channel, {r.feature: r.w for r in best})

    def signals(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [scorer.signals(t or "") for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rows = map_batches(texts.where("second").select("doc_id", "toxic", "text"), signals, "doc_id long, toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic, r.x))
    y = np.array([r.toxic for r in rows], float)
    got = {1: max(1.0, y.sum()), 0: max(1.0, (1 - y).sum())}
    share = {k: sizes.get(k, 0) / max(1, sum(sizes.values())) for k in (0, 1)}
    s.drop()
    weights = np.array([share[r.toxic] * len(rows) / got[r.toxic] for r in rows])  # classes as they are among the labels
    scorer.logistic = _fit_logistic(np.array([r.x for r in rows]).reshape(-1, 4), y, weights)
    if not len(rows):  # nothing to learn from: everything is as likely as the labels say
        prior = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1.0)
        scorer.logistic[0] = math.log(prior / (1 - prior)) if sizes else -3.0
    return scorer


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Learns from labels whose doc_id isn't held out (crc32 of its text mod 5 is not 0); only texts are scored.  A null
    text counts as empty; a text without words gets the score of one without toxic words.  Labels that are neither 0
    nor 1, or without doc_id, aren't used; of labels repeated for a doc_id the largest counts.  Without labels all
    get one low score.  Repeated rows each give a row, null doc_ids too; an empty table gives none.
    """
    scorer = fit(spark, docs, labels, **options)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score([t or "" for t in batch.column(1).to_pylist()]))], ["doc_id", "score"])

    return map_batches(text_rows(docs), run, "doc_id long, score double").select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text scores under 0.5, with all their columns."""
    scorer = fit(spark, docs, labels, **options)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scorer.score([t or "" for t in batch.column(at).to_pylist()]) < 0.5))

    return map_batches(docs, run, docs.schema)


QUERY = "op4_toxicity"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
