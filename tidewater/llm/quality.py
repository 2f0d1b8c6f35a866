"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed words, hashed word shapes and a few structural terms (words
that repeat the one before, lines that repeat an earlier one, distinct words).  A
truncated SVD of a bounded labelled sample gives the latent space; the sample's vectors
are broadcast, and every document takes exact blocked cosine products with all of them.
Its nearest neighbours vote, weighted by similarity.

Cases: null and empty texts have the empty text's structural vector and are scored like
any other; without labelled rows every score is 1 (nothing speaks against a text); of
neighbours that tie at the last place all vote; repeated rows are scored each; an
empty table gives an empty result; ids may be of any type that has a text form; only
doc_id and text are read for scoring, and columns of any name come back as they were,
but for ``held_out``, ``score`` and ``predicted``, which ``score_quality`` sets anew.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import clean_text, give_back, held_out, labelled_sample, own_names

#: Labelled rows that are broadcast, at most: SAMPLE_BOUND x DIMENSIONS floats.
SAMPLE_BOUND = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
WORDS, SHAPES, STRUCTURE = 1024, 256, 8
_TERMS = WORDS + SHAPES + STRUCTURE
_WEIGHTS = {"words": 0.4, "shapes": 1.0, "structure": 1.0}
_MEMORY_BOUND = 150_000
_BLOCK = 256
#: Characters of a chunk that is remembered; longer ones are worked out each time.
_SHORT = 256
_RUNS = ((re.compile(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+"), "AA"), (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1\1"))


class Terms(dict):
    """Chunk of a text -> word bucket * SHAPES + shape bucket, computed when missing."""

    def __missing__(self, chunk: str) -> int:
        if len(self) > _MEMORY_BOUND:
            self.clear()
        shape = chunk
        for pattern, to in _RUNS:
            shape = pattern.sub(to, shape)
        word = chunk.lower().strip(".,;:!?\"'()").encode("utf-8", "surrogatepass")
        code = zlib.crc32(word) % WORDS * SHAPES + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES
        if len(chunk) <= _SHORT:
            self[chunk] = code
        return code


_MEMORY = Terms()


def term_row(text: str, memory: Terms = _MEMORY) -> np.ndarray:
    """Weights of all terms of one whole text."""
    chunks = text.split()
    n, out = len(chunks), np.zeros(_TERMS, np.float32)
    codes = np.fromiter(map(memory.__getitem__, chunks), np.int64, n)
    words = np.log1p(np.bincount(codes // SHAPES, minlength=WORDS))
    shapes = np.bincount(codes % SHAPES, minlength=SHAPES) / max(n, 1)
    out[:WORDS] = words
    out[WORDS : WORDS + SHAPES] = np.sqrt(shapes)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    again = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
    twice = 1 - len(set(lines)) / max(len(lines), 1)
    few = 1 - min(1.0, len(set(chunks)) / max(n, 1) * (1 + np.log1p(n) / 4))
    short = 1 / (1 + n / 30)
    out[WORDS + SHAPES :] = np.sqrt([again, 1 - again, twice, 1 - twice, few, 1 - few, short, 1 - short])
    return out


def _weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float32)
    x[:, :WORDS] *= idf
    for part, at, to in (("words", 0, WORDS), ("shapes", WORDS, WORDS + SHAPES), ("structure", WORDS + SHAPES, _TERMS)):
        norm = np.linalg.norm(x[:, at:to], axis=1, keepdims=True)
        x[:, at:to] *= _WEIGHTS[part] / np.maximum(norm, 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """idf of words, the projection, and the labelled vectors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        seen = (rows[:, :WORDS] > 0).sum(0)
        self.idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
        x = _weigh(rows, self.idf)
        self.mean = x.mean(0)
        x -= self.mean
        values, vectors = np.linalg.eigh(x.T @ x)
        self.project = np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")[:dimensions]])
        self.vectors, self.labels = _unit(x @ self.project), labels.astype(np.float32)

    def score(self, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        query = _unit((_weigh(rows, self.idf) - self.mean) @ self.project)
        near = query @ self.vectors.T
        k = min(neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        weight = np.square(np.square(np.clip(near, 0, None))) + np.float32(1e-6)
        weight[near < last[:, None]] = 0
        return np.clip((weight @ self.labels) / weight.sum(1), 0, 1)


def _rows(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sparse term rows of the bounded sample, gathered on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = [], []
            for t in b.column("text"):
                row = term_row(t.as_py())
                at.append(np.flatnonzero(row).astype(np.int32))
                values.append(row[at[-1]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "label", "at", "value"])

    got = sample.mapInArrow(run, "doc_id string, label int, at array<int>, value array<float>").toArrow().sort_by("doc_id")
    rows = np.zeros((got.num_rows, _TERMS), np.float32)
    for k, (at, value) in enumerate(zip(got.column("at"), got.column("value"), strict=True)):
        rows[k, at.values.to_numpy()] = value.values.to_numpy()
    return rows, got.column("label").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_BOUND) -> Model | None:
    rows, y = _rows(labelled_sample(docs, labels, "quality", bound))
    return Model(rows, y) if len(rows) else None


def scored(docs: DataFrame, labels: DataFrame, name: str, bound: int = SAMPLE_BOUND) -> DataFrame:
    """All columns of ``docs`` and the score, under a name that ``docs`` does not have."""
    model = fit(docs, labels, bound)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = own_names([*docs.columns, name], "_text")[0]
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(text)
            score = np.ones(b.num_rows)
            for k in range(0, b.num_rows if found else 0, _BLOCK):
                part = np.stack([term_row(t.as_py()) for t in texts[k : k + _BLOCK]])
                score[k : k + _BLOCK] = found.score(part)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], name])
        give_back()

    return docs.select("*", clean_text().alias(text)).mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE_BOUND) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted (new names win)."""
    out = scored(docs.drop("held_out", "score", "predicted"), labels, "score", bound)
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE_BOUND) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all their columns unchanged."""
    name = own_names(docs.columns, "_score")[0]
    return scored(docs, labels, name, bound).where(F.col(name) >= threshold).drop(name)
