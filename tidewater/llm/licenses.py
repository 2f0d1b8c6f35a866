"""License scans: winnowed template fingerprints, then banded alignment.

Templates are winnowed and their fingerprints stand in an inverted index of bounded
size (templates are a parameter, not corpus data).  Every whole text is looked up in it;
where enough fingerprints of a template hit near one diagonal, the template is aligned
with the text in a band around it.  Words that are missing, replaced or added all cost, so
a match covers a template and little else.

What tells licenses apart must agree: version numbers (2 is 2.0) and qualifiers
(NonCommercial, NoDerivatives, Lesser, ...) of a template are required, in notices the
license's name too, and a qualifier that a template does not have may not stand inside
its match.

Cases: null and empty texts match nothing; several matches of one text are reported
each, of overlapping matches only that of the best alignment (ties: the better covered,
then the first by name); repeated rows are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import clean_text
from tidewater.llm.license_texts import NAMES, QUALIFIERS, TEMPLATES

#: Words a shingle, and shingles a winnowing window: every shared run of
#: GRAM + WINDOW - 1 words shares a fingerprint.
GRAM, WINDOW = 3, 2
BAND = 6  # words by which an alignment may leave its diagonal
NOTICE = 20  # words up to which a template is a notice
_MEMORY_BOUND = 150_000
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_VERSION = re.compile(r"v?\d+(\.\d+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, first and past last character); versions without v and trailing zeros."""
    out = []
    for m in _WORD.finditer(text):
        w = m[0].lower()
        if w[-1].isdigit() and _VERSION.fullmatch(w):
            w = w.removeprefix("v")
            while w.endswith(".0"):
                w = w[:-2]
        out.append((w, m.start(), m.end()))
    return out


class Index:
    """Word numbers, and fingerprint -> (template, position)."""

    def __init__(self, templates: dict[str, str], least: float = 0.8, gram: int = GRAM, window: int = WINDOW):
        self.names, self.gram = sorted(templates), gram
        self.words = [[w for w, _, _ in words_of(templates[k])] for k in self.names]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for x in self.words for w in x}))}
        self.base = len(self.number) + 1
        self.edits = [int(len(x) * (1 - least) + 1e-9) for x in self.words]
        self.needed = [[k for k, w in enumerate(x) if w in QUALIFIERS or _VERSION.fullmatch(w) or len(x) <= NOTICE and w in NAMES] for x in self.words]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.hits = []
        for t, x in enumerate(self.words):
            grams = self.grams(np.array([self.number[w] for w in x], np.int64))
            mixed = self.mix(grams)
            picked = set()
            for k in range(max(1, len(grams) - window + 1)):
                part = mixed[k : k + window]
                if len(part):  # of equal smallest hashes the last, as winnowing does
                    picked.add(k + len(part) - 1 - int(np.argmin(part[::-1])))
            for k in sorted(picked):
                self.places[int(grams[k])].append((t, k))
            # a missing or replaced word destroys ``gram`` fingerprints at most, each of two
            # added ones that count as much ``gram`` - 1: that many are left of a match
            self.hits.append(max(1, len(picked) - max(gram, 2 * gram - 2) * self.edits[t]))
        self.keys = np.array(sorted(self.places), np.int64)

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return x ^ x >> np.uint64(29)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out = np.zeros(n, np.int64)
        known = np.ones(n, bool)
        for k in range(self.gram):
            out = out * self.base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, out, -1)


class Numbers(dict):
    """Chunk between blanks -> numbers of its words."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > _MEMORY_BOUND:
            self.clear()
        got = self[chunk] = tuple(self.index.number.get(w, 0) for w, _, _ in words_of(chunk))
        return got


def align(text: list[str], template: list[str], shift: int, band: int = BAND) -> tuple[int, list[tuple[int, int]]]:
    """The best alignment of the whole template within ``band`` words of the diagonal
    text = template + shift: (score, matched places as (text, template)).

    A match scores 1; a replaced, a missing and an added word cost 1 each; words of the
    text before and after the alignment are free."""
    width, n = 2 * band + 1, len(template)
    # best[d]: the score with the first j words of the template and the text up to the
    # one before j + shift + d - band; from 0, since the text may start anywhere
    best = [0] * width
    back = []
    for j in range(n):
        row, steps, at = [0] * width, [0] * width, j + shift - band
        for d in range(width):
            i = at + d
            same = 0 <= i < len(text) and text[i] == template[j]
            score, step = best[d] + (1 if same else -1), 1 if same else 0
            # row d of this round stands for the text after word i
            if d + 1 < width and best[d + 1] - 1 > score:
                score, step = best[d + 1] - 1, 2  # the template's word is missing
            if d and row[d - 1] - 1 > score:
                score, step = row[d - 1] - 1, 3  # the text's word is added
            row[d], steps[d] = score, step
        best = row
        back.append(steps)
    d = max(range(width), key=lambda k: (best[k], -abs(k - band)))
    score, j, found = best[d], n - 1, []
    while j >= 0:
        step = back[j][d]
        if step == 1:
            found.append((j + shift - band + d, j))
        if step < 2:
            j -= 1
        elif step == 2:
            j, d = j - 1, d + 1
        else:
            d -= 1
    return score, found[::-1]


def accepted(index: Index, t: int, words: list[str], score: int, found: list[tuple[int, int]], least: float) -> bool:
    """Whether an alignment is a match of template ``t``."""
    template = index.words[t]
    n, first, last = len(found), found[0][0], found[-1][0]
    if n < least * len(template) or len(template) - score > 2 * index.edits[t] or n < min(index.gram, len(template)):
        return False
    hit = {j for _, j in found}
    if any(j not in hit for j in index.needed[t]):
        return False
    taken = {i for i, _ in found}
    return not any(w in QUALIFIERS for i, w in enumerate(words[first : last + 1], first) if i not in taken)


def matches(text: str, index: Index, memory: Numbers, least: float) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, matched words, first and past last character)."""
    lists = list(map(memory.__getitem__, text.split()))
    ids = np.fromiter((i for x in lists for i in x), np.int64, sum(map(len, lists)))
    grams = index.grams(ids)
    if not len(index.keys) or not len(grams):
        return []
    at = np.searchsorted(index.keys, grams)
    hit = np.flatnonzero(index.keys[np.minimum(at, len(index.keys) - 1)] == grams)
    if not len(hit):
        return []
    shifts: dict[int, list[int]] = defaultdict(list)
    for i in hit.tolist():
        for t, k in index.places[int(grams[i])]:
            shifts[t].append(i - k)
    places, words, found = None, [], {}
    for t, own in shifts.items():
        own.sort()
        done = None
        for k, s in enumerate(own):
            # one alignment serves all hits of a template on near diagonals
            if done is not None and s - done <= BAND // 2 or bisect_left(own, s + 2 * BAND + 1) - bisect_left(own, s - 2 * BAND) < index.hits[t]:
                continue
            done = s
            if places is None:
                places = words_of(text)
                words = [w for w, _, _ in places]
            score, pairs = align(words, index.words[t], s)
            if pairs and accepted(index, t, words, score, pairs, least):
                found[t, pairs[0][0], pairs[-1][0]] = score, len(pairs)
    out, starts, ends = [], [], []  # spans that are taken: apart from each other, in order
    ranked = sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1] / len(index.words[x[0][0]]), x[0]))
    for (t, first, last), (_, n) in ranked:
        k = bisect_left(starts, first)
        if k < len(starts) and starts[k] <= last or k and ends[k - 1] >= first:
            continue
        starts.insert(k, first)
        ends.insert(k, last)
        out.append((index.names[t], n / len(index.words[t]), n, places[first][1], places[last][2]))
    return sorted(out, key=lambda x: x[3:])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per match: doc_id, license, coverage, matched_words, start_char, end_char."""
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, least)
        memory = Numbers(index)
        for b in batches:
            rows, out = [], []
            for k, t in enumerate(b.column("text")):
                for m in matches(t.as_py(), index, memory, least):
                    rows.append(k)
                    out.append(m)
            c = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(c[0], pa.string()), pa.array(c[1], pa.float64()), *(pa.array(x, pa.int64()) for x in c[2:])],
                ["doc_id", "license", "coverage", "matched_words", "start_char", "end_char"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, license string, coverage double, matched_words long, start_char long, end_char long")
