"""License scans by conditional compression.

Candidate blocks are the stretches of text around licensing words, wide enough for every template. Each block
is compressed alone and with each template as a zstandard raw dictionary, and the templates are ranked by what
they save. Winners are confirmed by the exact differences in wording, with what the block's sentence goes on
to say; a confirmed stretch is cut out and the rest of the block is ranked again, so every licence is found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Short notices of well-known licences. The folder ``licenses`` holds whole licences and the
#: standard headers of the long ones; {} is what varies.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights-reserved": "All rights reserved.",
}
#: Identifiers of licences that a tag line may name.
TAGS = "AGPL-3.0-only Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-3.0-only MIT MPL-2.0 Unlicense".split()
#: Licensing words; the same pattern chooses texts in the JVM and places in Python.
CUE = r"(?i)licen[cs]|copyright|©|all\W+rights\W+reserved|redistribut|permission\W+(?:is|to)\W|public\W+domain|free\W+software|provided\W+.?as.is|spdx"
_CUE = re.compile(CUE, re.ASCII)
_WORD = re.compile(r"[\w.+-]*\w|\{\}", re.UNICODE)
_SPELL = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
#: A sentence goes on over a line's end if a comma stands there or a small letter follows.
_END = re.compile(r"[.!?;:](?=[\s\"')]|$)|(?<!,)\n(?!\s*[a-z])|\n\s*\n|$")
#: A tag's sentence is its line.
_LINE, _TAG = re.compile(r"\n|$"), "spdx-license-identifier"
_NOT = {"not", "never", "no", "neither", "nor", "without", "formerly"}
#: Share of a template's words that may differ in a confirmed match (none with a digit); words that a {} may
#: stand for; best templates that wording decides between, since offsets alone make a few bytes of
#: difference; compression level.
DIFFER, GAP, BEST, LEVEL = 0.1, 12, 3, 3


def templates() -> dict[str, str]:
    files = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    return NOTICES | {f"{t}-tag": f"SPDX-License-Identifier: {t}" for t in TAGS} | files


def words(text: str) -> list[str]:
    return [_SPELL.get(w.lower(), w.lower()) for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, given: dict[str, str]):
        self.names = sorted(given)
        self.words, self.gaps, self.bag = {}, {}, {}
        for n in self.names:
            w = words(given[n])
            at = [i for i, x in enumerate(w) if x == "{}"]
            self.gaps[n] = {i - k for k, i in enumerate(at)}
            self.words[n] = [x for x in w if x != "{}"]
            self.bag[n] = Counter(self.words[n])
        self.reach = 2 * max(map(len, self.words.values()))
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.given = {}
        for n in self.names:
            d = zstandard.ZstdCompressionDict(given[n].replace("{}", "").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.given[n] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False)

    def sizes(self, block: str) -> tuple[int, dict[str, int]]:
        """(compressed alone, compressed given each template)."""
        raw = block.encode()
        return len(self.alone.compress(raw)), {n: len(c.compress(raw)) for n, c in self.given.items()}

    def compare(self, name: str, have: list[str]) -> tuple[int, int, list[str], list[str]]:
        """(first, last, missing, added) of the stretch closest to the template, what a {} stands for not counted."""
        first, last, missing, added = stretch(self.words[name], have)
        extra = []
        for place in sorted({i for i, _ in added}):
            more = [w for i, w in added if i == place]
            extra += more[GAP:] if place in self.gaps[name] else more
        return first, last, missing, extra

    def confirm(self, name: str, text: str, spans: list[tuple[int, int]], marks: tuple[list[int], list[int], list[int]], have: list[str], lo: int, hi: int, differ: float):
        """(first, last, missing, added, after) if the words lo to hi hold the template, else None."""
        most = differ * len(self.words[name])
        if sum((self.bag[name] - Counter(have[lo:hi])).values()) > most:
            return None
        first, last, missing, added = self.compare(name, have[lo:hi])
        if first == last:
            return None
        first, last = lo + first, lo + last
        stop = _LINE if self.words[name][:1] == [_TAG] else _END
        after = [] if stop.match(text, spans[last - 1][1]) else words(text[spans[last - 1][1] : stop.search(text, spans[last - 1][1]).start()])
        begins, ends, nots = marks  # of words; of sentences; words that say not
        at = bisect_right(ends, spans[first][0])
        begin = bisect_left(begins, ends[at - 1] if at else 0)
        denied = bisect_left(nots, begin) < bisect_left(nots, first)
        if len(missing) + len(added) + len(after) > most or any(c.isdigit() for w in missing + added for c in w) or denied:
            return None
        return first, last, missing, added, after

    def block(self, text: str, cues: list[int], spans: list[tuple[int, int]], marks: tuple[list[int], list[int], list[int]], have: list[str], lo: int, hi: int, until: int, differ: float):
        """(first, last, row) of every confirmed stretch among the words lo to hi that begins before ``until``. The best
        is cut out, and what is left is ranked again."""
        out, todo = [], [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if lo >= min(hi, until) or bisect_left(cues, spans[lo][0]) >= bisect_right(cues, spans[hi - 1][1] - 1):
                continue
            alone, sizes = self.sizes(text[spans[lo][0] : spans[hi - 1][1]])
            ranked = sorted(self.names, key=lambda n: (sizes[n], n))
            found = None
            for k in range(0, len(ranked), BEST):
                good = [(len(g[2]) + len(g[3]) + len(g[4]), sizes[n], n, g) for n in ranked[k : k + BEST] if (g := self.confirm(n, text, spans, marks, have, lo, hi, differ))]
                if good:
                    found = min(good)
                    break
            if not found:
                continue
            _, _, name, (first, last, missing, added, after) = found
            todo.append((lo, first))
            if first < until:
                start, end = spans[first][0], spans[last - 1][1]
                alone, sizes = self.sizes(text[start:end])
                out.append((first, last, (start, end, name, alone, sizes[name], missing, added, after, True)))
                todo.append((last, hi))
        return out

    def rows(self, text: str, differ: float) -> list[tuple[int, int, str, int, int, list[str], list[str], list[str], bool]]:
        """(start, end, template, size alone, size given it, missing, added, after, confirmed): every confirmed
        stretch, and the lines of the other cues by their best template."""
        cues = [m.start() for m in _CUE.finditer(text)]
        if not cues:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        begins = [a for a, _ in spans]
        have = [_SPELL.get(text[a:b].lower(), text[a:b].lower()) for a, b in spans]
        marks = begins, [m.end() for m in _END.finditer(text) if m.start() < m.end()], [i for i, w in enumerate(have) if w in _NOT]
        near: list[tuple[int, int]] = []
        for a in cues:
            at = bisect_right(begins, a)
            lo, hi = max(0, at - self.reach), min(len(spans), at + self.reach)
            if near and lo <= near[-1][1]:
                near[-1] = near[-1][0], hi
            else:
                near.append((lo, hi))
        out, covered = [], []
        for lo, hi in near:
            # No stretch is longer than reach, so each lies whole in the block of 2 * reach words in whose first
            # half it begins; the last block of a run of cues is its own whole.
            done = lo
            while lo < hi:
                end = min(hi, lo + 2 * self.reach)
                found = self.block(text, cues, spans, marks, have, max(lo, done), end, end if end == hi else end - self.reach, differ)
                for first, last, row in found:
                    out.append(row)
                    covered.append(row[:2])
                    done = max(done, last)
                lo = hi if end == hi else end - self.reach
        covered.sort()
        starts, ends = [s for s, _ in covered], [e for _, e in covered]
        free = lambda a, b: bisect_right(ends, a) == bisect_left(starts, b)
        lines = sorted({(text.rfind("\n", 0, a) + 1, (text.find("\n", a) + 1 or len(text) + 1) - 1) for a in cues if free(a, a + 1)})
        for start, end in [x for x in lines if free(*x)]:
            alone, sizes = self.sizes(text[start:end])
            name = min(self.names, key=lambda n: (sizes[n], n))
            _, _, missing, added = self.compare(name, words(text[start:end]))
            out.append((start, end, name, alone, sizes[name], missing, added, [], False))
        return sorted(out)


def stretch(template: list[str], have: list[str]) -> tuple[int, int, list[str], list[tuple[int, str]]]:
    """(first, last, missing, added) of the stretch have[first:last] closest to the template: its words that the
    stretch lacks, and the stretch's other words with their places in the template."""
    code = {w: k for k, w in enumerate(template)}
    text, place = np.array([code.get(w, -1) for w in have], int), np.arange(len(have) + 1)

    def rows(a: int, b: int):
        row = np.zeros(b - a + 1, int)
        yield row
        for w in template:
            new = row + 1
            new[1:] = np.where(text[a:b] == code[w], np.minimum(new[1:], row[:-1]), new[1:])
            row = np.minimum.accumulate(new - place[: b - a + 1]) + place[: b - a + 1]
            yield row

    for row in rows(0, len(have)):  # where the stretch ends takes one row; it has at most twice the template's words
        pass
    last = int(row.argmin())
    first = max(0, last - 2 * len(template))
    cost = list(rows(first, last))
    have = have[first:last]
    i, j = len(template), last - first
    missing, added = [], []
    while i:
        if j and template[i - 1] == have[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            missing.append(template[i - 1])
            i -= 1
        else:
            added.append((i, have[j - 1]))
            j -= 1
    return first + j, last, missing[::-1], added[::-1]


def scan(docs: DataFrame, given: dict[str, str] | None = None, differ: float = DIFFER) -> DataFrame:
    """One row per licence confirmed in the documents (doc_id, text), and per line of other licensing words: doc_id,
    start and end in code points, block, template (the one that saves most where none is confirmed),
    size_alone, size_given, saving (share of the size alone), missing and added (words), after (words with
    which the sentence goes on), confirmed (those differences are at most ``differ`` of the template's words,
    none has a digit, and nothing before it in its sentence says not).

    Null, empty and cue-less texts give no row; texts are read whole, however long; repeated rows give theirs
    each; other columns are ignored.
    """
    wordings = given or templates()

    def run(batches):
        scanner = Scanner(wordings)
        for b in pieces(batches):
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "end", "block", "template", "size_alone", "size_given", "saving", "missing", "added", "after", "confirmed")}
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for start, end, name, alone, size, missing, added, after, ok in scanner.rows(text, differ):
                    for c, v in zip(out.values(), (doc, start, end, text[start:end], name, alone, size, 1 - size / alone, missing, added, after, ok), strict=True):
                        c.append(v)
            several = pa.list_(pa.string())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), several, several, several, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    schema = "doc_id long, start long, end long, block string, template string, size_alone long, size_given long, saving double, missing array<string>, added array<string>, after array<string>, confirmed boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(CUE)).mapInArrow(run, schema)
