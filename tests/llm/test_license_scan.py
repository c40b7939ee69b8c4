import itertools
import math
import random
from collections import Counter

from helpers import HARD, clashing, docs, words

from strandloom.llm import license_scan as op
from strandloom.llm.license_templates import TEMPLATES


def by_doc(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_every_template_is_found_in_other_text(spark):
    rows = []
    for k, (_, text) in enumerate(TEMPLATES.items()):
        rows.append((k, f"{words(30, k)}.\n{text}\n{words(300, k + 50)}."))
        rows.append((100 + k, f"{words(3000, k)}. {text.upper()} {words(20, k)}."))
        rows.append((200 + k, text.replace(" ", "\n * ")))
    got = by_doc(op.license_scan(docs(spark, rows)))
    for k, name in enumerate(TEMPLATES):
        for base in (0, 100, 200):
            found = got[base + k]
            assert any(r.license == name and r.n_matched == r.n_words and not r.n_missing for r in found), (name, base, [r.license for r in found])


def test_changed_wording_is_listed_and_the_nearest_wins(spark):
    rows = [(1, "x y.\nThis work is now licensed under the GNU General Public License, version 3.\nz"), (2, "This work was licensed under the GNU General Public License, version 2."), (3, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = by_doc(op.license_scan(docs(spark, rows)))
    assert [(r.license, r.differences, r.n_missing, r.n_extra) for r in got[1]] == [("GPL-3.0 (statement)", "-+now", 0, 1)]
    assert [(r.license, r.differences) for r in got[2]] == [("GPL-2.0 (statement)", "-is+was")]
    assert {r.license for r in got[3]} == {"CC-BY-NC-4.0 (statement)", "MIT (statement)"}


def test_other_text_gives_nothing(spark):
    rows = [(k, words(400, k)) for k in range(20)] + [(50, "The license of the song is unknown and permission was not given."), (51, "copyright " * 3000), (52, "warranty void. " * 50)]
    assert op.license_scan(docs(spark, rows)).count() == 0


def test_same_as_comparing_every_template(spark):
    """Ranking by compression loses no template that a full comparison of wording confirms."""
    r = random.Random(3)
    s = op.Scanner(TEMPLATES)
    for k in range(120):
        name = r.choice(list(TEMPLATES))
        w = op.words(TEMPLATES[name])
        for _ in range(int(len(w) * r.choice([0, 0, 0.05, 0.1, 0.15]))):
            w[r.randrange(len(w))] = "changed"
        block = words(r.randrange(10), k).split() + w + words(r.randrange(10), k + 1).split()
        ranked = {n for _, n in s.ranked(block)}
        sure = w.count("changed") <= 0.15 * len(w)
        assert not sure or name in ranked, (name, k)


def test_long_blocks_and_hard_rows(spark):
    text = "\n".join(["copyright " + words(20, k) for k in range(300)] + [TEMPLATES["MIT"]] + ["copyright " + words(20, k) for k in range(300)])
    got = by_doc(op.license_scan(clashing(spark, [*HARD, (77, text), (77, text), (None, "Released under the MIT License.")])))
    assert set(got) == {77, None} and {r.license for r in got[77]} == {"MIT"}
    assert op.license_scan(docs(spark, [])).count() == 0


def test_short_notices_in_long_blocks():
    """How long the text around a notice is makes no difference, with or without changed words."""
    r = random.Random(5)
    s = op.Scanner(TEMPLATES)
    short = [n for n, t in TEMPLATES.items() if len(op.words(t)) < 15]
    for n in (300, 600, 1200):
        for name in short:
            around = words(n, r.randrange(10**6)).split()
            for k in range(0, n, 40):
                around[k] = "copyright"
            at = r.randrange(n)
            own = op.words(TEMPLATES[name])
            got = s.find(around[:at] + own + around[at:])
            assert [(x[0], x[4], x[-1]) for x in got] == [(name, len(own), (at, at + len(own)))], (name, n)
    text = "Licensed under the terms of the Apache License, Version 2.0."
    (got,) = s.scan(f"{words(500, 1)} copyright. {text} {words(500, 2)}")
    assert (got[2], got[6], got[7], got[9]) == ("Apache-2.0 (statement)", 8, 0, "-+terms of the")
    assert s.scan(f"Released {words(40, 3)} under {words(40, 4)} the MIT {words(40, 5)} license") == []


def test_every_copy_gives_a_row():
    s = op.Scanner(TEMPLATES)
    mit, changed = TEMPLATES["MIT"], TEMPLATES["MIT"].replace("free of charge", "gratis").replace("KIND", "SORT")
    got = s.scan("\n".join([mit, changed, mit]))
    assert sorted((x[0], x[2], x[6], x[9]) for x in got) == [
        (0, "MIT", 163, ""),
        (len(mit) + 1, "MIT", 159, "-free of charge+gratis|-kind+sort"),
        (len(mit) + len(changed) + 2, "MIT", 163, ""),
    ]
    many = s.scan("\n".join(f"/* Copyright {k} */ {mit} {words(30, k)}" for k in range(40)))
    assert len(many) == 40 and {x[2] for x in many} == {"MIT"}
    text = "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0. " * 30 + "Released under the MIT License. " * 20
    got = Counter((x[2], x[9]) for x in s.scan(text))
    assert got == {("CC-BY-4.0 (statement)", ""): 30, ("CC-BY-NC-4.0 (statement)", ""): 30, ("MIT (statement)", ""): 20}


def test_reserved_rights_and_spdx_lines(spark):
    rows = [
        (1, f"{words(300, 1)}\nAll rights reserved."),
        (2, f"// SPDX-License-Identifier: Apache-2.0 */\n{words(40, 2)}"),
        (3, f"# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND EPL-2.0.\n{words(700, 3)}\n<!-- spdx-license-identifier: ISC-->"),
        (4, f"All was reserved. {words(30, 4)} rights. The SPDX-License-Identifier is a line."),
        (5, "Copyright 2020. All rights are reserved. Released under the MIT License."),
    ]
    got = {k: [(r.license, r.differences) for r in sorted(x, key=lambda r: (r.start, r.end))] for k, x in by_doc(op.license_scan(docs(spark, rows))).items()}
    assert got == {
        1: [("All rights reserved", "")],
        2: [("Apache-2.0 (SPDX)", "")],
        3: [(f"{x} (SPDX)", "") for x in ("MIT", "GPL-2.0-only WITH Classpath-exception-2.0", "EPL-2.0", "ISC")],
        5: [("All rights reserved", "-+are"), ("MIT (statement)", "")],
    }


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *itertools.accumulate(range(len(b)), lambda last, j: row[j] + 1 if b[j] == x else max(last, row[j + 1]), initial=0)][1:]
    return row[-1]


def brute_notices(s, block):
    """(template, start, end) of notices by trying every template on every stretch, the best first, until none is left."""
    left, out = list(block), []
    while True:
        found = []
        for name, t in s.templates.items():
            least = math.ceil(round(op.CONFIRMED * len(t), 6))
            for i in range(len(left)):
                if left[i] not in t[: len(t) - least + 1]:
                    continue
                best = None
                for j in range(i + 1, min(len(left), i + op.STRETCH * len(t)) + 1):
                    m = common(t, left[i:j])
                    worth = m - op.INSERTED * (j - i - m)
                    if m >= least and (best is None or worth > best[0]):
                        best = worth, m, j
                if best:
                    found.append((-best[0], -best[1] / len(t), i, best[2], name))
        if not found:
            return out
        top = min(f[:4] for f in found)
        ranks = [n for _, n in s.ranked(block[top[2] : top[3]])]
        name = min((f[4] for f in found if f[:4] == top), key=ranks.index)
        out.append((name, top[2], top[3]))
        for _, j in s.wordings[name].align(left[top[2] : top[3]]):
            left[top[2] + j] = None


def test_notices_against_brute_force():
    """Overlapping templates, repeats, changed and inserted words, in small texts: the same notices in the same places."""
    r = random.Random(12)
    short = {"a": "free license one two three", "b": "free license one two four five", "c": "license all one", "d": "use two three license use two", "e": "no license no no one"}
    s = op.Scanner(short)
    pool = sorted({w for t in short.values() for w in op.words(t)}) + ["x", "y"]
    n = 0
    for _ in range(150):
        block = []
        while len(block) < 30:
            w = op.words(r.choice(list(short.values()))) if r.random() < 0.6 else [r.choice(pool)]
            if r.random() < 0.4:
                w.insert(r.randrange(len(w) + 1), r.choice(pool))
            block += w
        got = [(x[0], x[-1]) for x in s.find(block)]
        want = brute_notices(s, block)
        assert [(name, start <= a < b <= end) for (name, (a, b)), (_, start, end) in zip(got, want, strict=True)] == [(name, True) for name, _, _ in want], block
        n += len(want)
    assert n > 300


def test_notices_of_a_family_are_told_apart():
    s = op.Scanner(TEMPLATES)
    for name in ("GPL-3.0", "AGPL-3.0", "LGPL-2.1", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "EPL-2.0", "BSL-1.0"):
        got = s.scan(f"{words(40, 1)} {TEMPLATES[name]} {words(40, 2)}")
        assert got[0][2] == name and got[0][9] == "", (name, [x[2] for x in got])
