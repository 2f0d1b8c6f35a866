"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Three disjoint parts of a bounded labelled sample are used: one for the lexicons (words
and word beginnings that are much likelier in toxic texts), one for the trees, one for
the calibration; where the third holds fewer than five texts of a kind, all rows that the
trees saw calibrate too, and the model says so (``Model.held_apart``).  Features of a whole text: densities and counts of lexicon entries,
their distance to second-person words, capitals, punctuation and obfuscated words.

Cases: null and empty texts have all features zero; without labelled rows of both kinds
every score is 0; repeated rows are scored each; an empty table gives an empty result;
ids may be of any type that has a text form; only doc_id and text are read for scoring,
and columns of any name come back as they were, but for ``held_out``, ``score`` and
``predicted``, which ``score_toxicity`` sets anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import clean_text, give_back, held_out, labelled_sample, materialize, own_names

#: Labelled rows that are learned from, at most.
SAMPLE_BOUND = 12_000
#: Lexicon entries of each kind, at most.
LEXICON_BOUND = 3000
PREFIXES = (4, 5)
_MEMORY_BOUND = 150_000
#: Characters of a chunk that is remembered; longer ones are worked out each time.
_SHORT = 256
# Second-person words of the languages that the corpus holds.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer usted ustedes tú ti tus vosotros vuestro vuestra os".split())
_STRIP = ".,;:!?\"'()[]{}…«»¡¿|-–—"
_OBFUSCATED = re.compile(r"[^\W\d_][@$*0134579!]+[^\W\d_]|([^\W\d_])\1\1|^[^\W\d_]([.\-_*][^\W\d_]){2,}$")
FEATURES = ["word_density", "word_count", "word_kinds", "word_weight", "word_top", "prefix_density", "prefix_count", "prefix_kinds", "prefix_weight", "prefix_top", "near_second", "second_rate", "capital_rate", "shout_rate", "punctuation_rate", "bang_rate", "obfuscated_rate", "length"]


def _word(chunk: str) -> str:
    return chunk.lower().strip(_STRIP)


def _terms(text: str) -> set[str]:
    """Distinct words, and beginnings of longer words marked by a star."""
    words = {_word(c) for c in set(text.split())} - {""}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def lexicon(sample: DataFrame, bound: int = LEXICON_BOUND) -> dict[str, float]:
    """Term -> log odds, for at most ``bound`` terms and as many beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for t, y in zip(b.column("text"), b.column("label"), strict=True):
                bad = y.as_py()
                for term in _terms(t.as_py()):
                    got = counts.setdefault(term, [0, 0])
                    got[bad] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], ["term", "clean", "toxic"])

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1.0))
    found = (
        sample.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= 3).withColumn("odds", odds).where(F.col("odds") > 1.5))
    star = F.col("term").endswith("*")
    out = {}
    for part in (found.where(star), found.where(~star)):
        out |= {r["term"]: r["odds"] for r in part.orderBy((-F.col("odds") * F.sqrt("toxic")), "term").limit(bound).collect()}
    return out


class Chunks(dict):
    """Chunk of a text -> (word odds, prefix odds, second person, shouted, obfuscated)."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, chunk: str) -> tuple:
        if len(self) > _MEMORY_BOUND:
            self.clear()
        w = _word(chunk)
        prefix = max((self.terms.get(w[:k] + "*", 0.0) for k in PREFIXES if len(w) > k), default=0.0)
        core = chunk.strip(_STRIP)
        found = (self.terms.get(w, 0.0), prefix, w in SECOND_PERSON, len(core) > 2 and core.isupper(), bool(_OBFUSCATED.search(core)))
        found = None if found == (0.0, 0.0, False, False, False) else found
        if len(chunk) <= _SHORT:
            self[chunk] = found
        return found


_CAPITAL, _PUNCTUATION = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\w\s]")


def features(text: str, memory: Chunks) -> list[float]:
    chunks = text.split()
    n = len(chunks)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [(k, x) for k, x in enumerate(map(memory.__getitem__, chunks)) if x is not None]
    words = [(k, x[0]) for k, x in hits if x[0]]
    prefixes = [(k, x[1]) for k, x in hits if x[1]]
    second = {k for k, x in hits if x[2]}
    near = sum(any(j in second for j in range(k - 3, k + 4)) for k, _ in words + prefixes) if second else 0
    out = []
    for got in (words, prefixes):
        total = sum(v for _, v in got)
        out += [len(got) / n, len(got), len({chunks[k].lower() for k, _ in got}), total / n, max((v for _, v in got), default=0.0)]
    chars = len(text)
    return [*out, near / n, len(second) / n, len(_CAPITAL.findall(text)) / chars, sum(x[3] for _, x in hits) / n, len(_PUNCTUATION.findall(text)) / chars, text.count("!") / chars, sum(x[4] for _, x in hits) / n, np.log1p(n)]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0):
        self.depth = depth
        cuts = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
        cuts = [np.unique(np.append(c, [0.0])) for c in cuts]
        binned = np.stack([np.searchsorted(c, f, side="left") for c, f in zip(cuts, x.T, strict=True)], 1)
        width = max(map(len, cuts)) + 1
        p = y.mean()
        self.start = float(np.log(p / (1 - p)))
        self.trees, margin = [], np.full(len(y), self.start)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-margin))
            g, h = y - prob, prob * (1 - prob) + 1e-9
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for k in range(2**depth - 1):
                at = node == k
                if not at.any():
                    continue
                best, gt, ht = 1e-6, g[at].sum(), h[at].sum()
                for f in range(x.shape[1]):
                    gl = np.cumsum(np.bincount(binned[at, f], g[at], width))[: len(cuts[f])]
                    hl = np.cumsum(np.bincount(binned[at, f], h[at], width))[: len(cuts[f])]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                    if len(gain) and gain.max() > best:
                        best = gain.max()
                        feature[k], cut[k] = f, cuts[f][gain.argmax()]
                node[at] = 2 * k + 1 + (x[at, feature[k]] > cut[k])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
            self.trees.append((feature, cut, value))
            margin += value[leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """Pool-adjacent-violators fit of the labels on the margin, linear between blocks."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
        for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1, m])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.value = np.array([b[0] / b[1] for b in blocks])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


class Model:
    """``held_apart``: whether only texts that the trees had not seen calibrate."""

    def __init__(self, terms: dict[str, float], trees: Trees, calibrate: Isotonic, held_apart: bool):
        self.terms, self.trees, self.calibrate, self.held_apart = terms, trees, calibrate, held_apart

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibrate(self.trees.margin(x)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_BOUND) -> Model | None:
    # read several times; few files, since the sample is small
    sample = materialize(labelled_sample(docs, labels, "toxic", bound).repartition(max(1, bound // 1000), "doc_id"), "toxic-sample")
    terms = lexicon(sample.where("fold < 4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Chunks(terms)
        for b in batches:
            x = [features(t.as_py(), memory) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("fold"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "fold", "x"])

    got = sample.where("fold >= 4").mapInArrow(run, "doc_id string, label int, fold int, x array<double>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    y, fold, x = got.column("label").to_numpy().astype(float), got.column("fold").to_numpy(), np.array(got.column("x").to_pylist())
    tree, rest = fold < 8, fold >= 8
    if len(set(y[tree])) < 2:
        return None
    trees = Trees(x[tree], y[tree])
    margin = trees.margin(x)
    # too few rows of a kind to calibrate on: then all that the trees saw
    apart = min((y[rest] == 0).sum(), (y[rest] == 1).sum()) >= 5
    use = rest if apart else tree | rest
    return Model(terms, trees, Isotonic(margin[use], y[use]), bool(apart))


def scored(docs: DataFrame, labels: DataFrame, name: str, bound: int = SAMPLE_BOUND) -> DataFrame:
    """All columns of ``docs`` and the score, under a name that ``docs`` does not have."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))
    text = own_names([*docs.columns, name], "_text")[0]
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        memory = Chunks(model.terms) if model else None
        for b in batches:
            if not b.num_rows:
                continue
            score = np.zeros(b.num_rows)
            if model:
                score = model.score(np.array([features(t.as_py(), memory) for t in b.column(text)]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], name])
        give_back()

    return docs.select("*", clean_text().alias(text)).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = SAMPLE_BOUND) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted (new names win)."""
    out = scored(docs.drop("held_out", "score", "predicted"), labels, "score", bound)
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = SAMPLE_BOUND) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns unchanged."""
    name = own_names(docs.columns, "_score")[0]
    return scored(docs, labels, name, bound).where(F.col(name) < threshold).drop(name)
