"""License scans by conditional compression.

The words of a text near cues are compared with every license template.  A notice is a stretch of words that has at
least CONFIRMED of a template's words in their order, among at most as many words as STRETCH templates have; how long
the text around it is doesn't matter.  Each stretch is compressed by zstandard on its own and with each template as
raw dictionary, and the share by which a template shrinks it ranks the templates: text that the template contains
costs next to nothing.  Compression ranks and breaks ties; the wording alone decides.
The notice with the most words in common is taken first and its words are taken out, until no template is found any
more, so that a block with two notices or two copies of one gives both, and a short notice that is part of a longer
one gives one.

Candidate blocks: every word of every template is within `reach` words of one of the CUES in it (reach is worked out
from the templates), so the words within reach of a cue, with a quarter more for insertions, are a candidate, and
candidates that touch are one block of any length.

An SPDX-License-Identifier line names its licenses itself: each license of its expression is a notice, whether or not
there is a template of it, and the words of the line's head and the license are its template.

Comparison: the most words in common are counted by bit vectors, from each word that may be a notice's first, over at
most STRETCH template lengths, so the work grows with a block's length and not with its square.

Everything about a document is in its row: there is no shuffle, and a task holds one batch of texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush
from math import ceil

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, text_rows
from .license_templates import TEMPLATES

#: Stems that every notice has (in small letters).
CUES = ("licens", "licenc", "copyright", "permission", "warrant", "redistribut", "public domain", "spdx", "liab", "reserved")
#: Share of a template's words that a block must have.
CONFIRMED = 0.8
#: The longest stretch of a notice with inserted words, in lengths of its template.
STRETCH = 2
#: What an inserted word costs when stretches are compared, in matched words.
INSERTED = 0.25

_CUE = re.compile("|".join(c.replace(" ", r"[\W_]+") for c in CUES), re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_ID = r"[A-Za-z0-9](?:[\w.+:-]*[\w+])?"
_SPDX = re.compile(rf"(?i:SPDX-License-Identifier)[ \t]*:[ \t]*(\(*{_ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{_ID}\)*)*)")
_LICENSE = re.compile(rf"{_ID}(?:[ \t]+WITH[ \t]+{_ID})?")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Wording:
    """A template's words, and where they are in a block."""

    def __init__(self, template: list[str]):
        self.words, self.counts = template, Counter(template)
        self.least = ceil(round(CONFIRMED * len(template), 6))
        self.longest = STRETCH * len(template)
        self.masks: dict[str, int] = {}
        for k, w in enumerate(template):
            self.masks[w] = self.masks.get(w, 0) | 1 << k
        self.first = frozenset(template[: len(template) - self.least + 1])  # others leave too few after them

    def best(self, block: list[str | None], start: int) -> tuple[float, int, int] | None:
        """(worth, matched, end) of the best stretch from start that has enough words; taken words are None."""
        n, least, get = len(self.words), self.least, self.masks.get
        full = (1 << n) - 1
        open_, matched, found = full, 0, None
        for j in range(start, min(start + self.longest, len(block))):
            mask = get(block[j])
            if mask:
                hit = open_ & mask
                open_ = ((open_ + hit) | (open_ - hit)) & full
                if (now := n - open_.bit_count()) > matched:  # the most words in common so far
                    matched = now
                    if matched >= least:
                        worth = matched - INSERTED * (j + 1 - start - matched)
                        if found is None or worth > found[0]:
                            found = worth, matched, j + 1
        return found

    def starts(self, block: list[str]) -> list[int]:
        """Words that may be a notice's first: enough of the template's words are in the stretch from there."""
        counts = self.counts
        held = Counter(w for w in block if w in counts)
        if sum(min(n, counts[w]) for w, n in held.items()) < self.least:
            return []
        out, within, common, end = [], Counter(), 0, 0
        for start, w in enumerate(block):
            while end < min(start + self.longest, len(block)):
                if (x := block[end]) in counts:
                    common += within[x] < counts[x]
                    within[x] += 1
                end += 1
            if common >= self.least and w in self.first:
                out.append(start)
            if w in counts:
                within[w] -= 1
                common -= within[w] < counts[w]
        return out

    def align(self, seen: list[str | None]) -> list[tuple[int, int]]:
        """(place in the template, place in seen) of the most words in common."""
        t, n, m = self.words, len(self.words), len(seen)
        most = [[0] * (m + 1)]
        for i in range(n - 1, -1, -1):
            w, below, row = t[i], most[-1], [0] * (m + 1)
            for j in range(m - 1, -1, -1):
                row[j] = below[j + 1] + 1 if seen[j] == w else max(below[j], row[j + 1])
            most.append(row)
        most.reverse()
        out, i, j = [], 0, 0
        while i < n and j < m:
            if seen[j] == t[i]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif most[i + 1][j] >= most[i][j + 1]:
                i += 1
            else:
                j += 1
        return out


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = {name: words(text) for name, text in templates.items()}
        self.wordings = {name: Wording(t) for name, t in self.templates.items()}
        self.alone = zstandard.ZstdCompressor(level=3)
        raw = lambda t: zstandard.ZstdCompressionDict(" ".join(words(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.reach = 1 + 5 * max(self._reach(text) for text in templates.values()) // 4
        self.given = {name: zstandard.ZstdCompressor(level=3, dict_data=raw(text)) for name, text in templates.items()}

    @staticmethod
    def _reach(template: str) -> int:
        """The most words from a word of the template to the nearest cue."""
        cues = [k for k, m in enumerate(_WORD.finditer(template)) if _CUE.search(template, m.start(), m.end())]
        for m in _CUE.finditer(template):  # a cue of two words
            cues.append(sum(w.start() < m.start() for w in _WORD.finditer(template)))
        return max(min(abs(k - c) for c in cues) for k in range(len(_WORD.findall(template))))

    def blocks(self, text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """First and end word of each candidate block."""
        starts = [a for a, _ in places]
        spans: list[list[int]] = []
        for m in _CUE.finditer(text):
            k = bisect_right(starts, m.start()) - 1
            lo, hi = max(0, k - self.reach), min(len(places), k + self.reach + 1)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        return [(lo, hi) for lo, hi in spans]

    def ranked(self, block: list[str]) -> list[tuple[float, str]]:
        """(share by which it shrinks the block, template), the best first."""
        data = " ".join(block).encode()
        alone = len(self.alone.compress(data))
        sizes = {name: alone - len(c.compress(data)) for name, c in self.given.items()}
        return sorted(((less / alone, name) for name, less in sizes.items()), key=lambda x: (-x[0], x[1]))

    def find(self, block: list[str]) -> list[tuple]:
        """(template, rank, share, words, matched, missing, extra, differences, place) of each notice, the nearest first."""
        ranks: dict[tuple[int, int], dict[str, tuple[int, float]]] = {}

        def rank(start: int, end: int) -> dict[str, tuple[int, float]]:
            if (start, end) not in ranks:
                ranks[start, end] = {name: (k, share) for k, (share, name) in enumerate(self.ranked(block[start:end]), 1)}
            return ranks[start, end]

        left: list[str | None] = list(block)

        def candidate(name: str, start: int, taken: int) -> tuple | None:
            got = self.wordings[name].best(left, start)
            if got is None:
                return None
            worth, matched, end = got
            return -worth, -matched / len(self.templates[name]), start, end, name, taken

        queue = [c for name, w in self.wordings.items() for k in w.starts(block) if (c := candidate(name, k, 0))]
        heapify(queue)
        found, taken = [], []
        while queue:
            equals = [heappop(queue)]
            while queue and queue[0][:4] == equals[0][:4]:
                equals.append(heappop(queue))
            start, end = equals[0][2:4]
            fresh = []
            for c in equals:
                if any(lo < end and start < hi for lo, hi in taken[c[5] :]):  # words of it may have been taken since
                    if left[start] is not None and (c := candidate(c[4], start, len(taken))):
                        heappush(queue, c)
                else:
                    fresh.append(c)
            if not fresh:
                continue
            best = min(fresh, key=lambda c: rank(start, end)[c[4]][0])  # of those as near the one that shrinks it most
            for c in fresh:
                if c is not best:
                    heappush(queue, c)
            name = best[4]
            found.append((name, *rank(start, end)[name], *self._compared(name, left, block, start, end)))
            taken.append((start, end))
        return found

    def _compared(self, name: str, left: list[str | None], block: list[str], start: int, end: int) -> tuple:
        """(words, matched, missing, extra, differences, place) of a notice; its words are taken out of left."""
        template = self.templates[name]
        pairs = self.wordings[name].align(left[start:end])
        differences, missing, extra, i, j = [], 0, 0, 0, pairs[0][1]
        for i2, j2 in [*pairs, (len(template), pairs[-1][1] + 1)]:  # what is around the notice isn't of it
            if i2 > i or j2 > j:
                here = block[start + j : start + j2]
                missing, extra = missing + i2 - i, extra + len(here)
                differences.append(f"-{' '.join(template[i:i2])}+{' '.join(here)}")
            i, j = i2 + 1, j2 + 1
        for _, j in pairs:
            left[start + j] = None
        return len(template), len(pairs), missing, extra, "|".join(differences), (start + pairs[0][1], start + pairs[-1][1] + 1)

    def scan(self, text: str) -> list[tuple]:
        if not _CUE.search(text):
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        out = []
        for lo, hi in self.blocks(text, places):
            for x in self.find([text[a:b].lower() for a, b in places[lo:hi]]):
                first, end = x[-1]
                out.append((places[lo + first][0], places[lo + end - 1][1], *x[:-1]))
        return out + [x for line in _SPDX.finditer(text) for x in self._identified(line)]

    def _identified(self, line: re.Match) -> list[tuple]:
        """A row for each license of an SPDX line."""
        out = []
        for m in _LICENSE.finditer(line[0], line.start(1) - line.start()):
            if m[0] in ("AND", "OR"):
                continue
            own = words(f"SPDX-License-Identifier {m[0]}")
            data = " ".join(own).encode()
            alone = len(self.alone.compress(data))
            with_own = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            share = (alone - len(with_own.compress(data))) / alone
            rank = 1 + sum(other > share for other, _ in self.ranked(own))
            out.append((line.start(), line.start() + m.end(), f"{' '.join(m[0].split())} (SPDX)", rank, share, len(own), len(own), 0, 0, ""))
        return out


@lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


COLUMNS = "doc_id long, start long, end long, license string, rank int, shrinks double, n_words int, n_matched int, n_missing int, n_extra int, differences string"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each notice found in a document, each copy of it too.

    start and end are the notice's characters; rank is the template's place by compression and shrinks its share;
    n_missing and n_extra count the words that differ, and `differences` lists them in order as -template+text.
    Null and empty texts, and texts without notices, give no rows; repeated rows and null doc_ids give theirs like
    any other; an empty table gives none.  Other columns are not read.  Texts of any length are read whole.
    """
    key = tuple((templates or TEMPLATES).items())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), *[pa.int32()] * 4, pa.string()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _scanner(key)
        rows = [(doc_id, *x) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for x in s.scan(text)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return map_batches(text_rows(docs), run, COLUMNS)


QUERY = "op8_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
