"""Best-fit packing of token pieces by minimum bin slack.

Documents are tokenised once; only longer ones are cut.  A bin always takes the
longest piece left, and a bitset subset-sum over the remaining lengths finds the
fullest combination for the rest of it, which is then removed.  Only the counts per
length matter for that, and there are at most ``capacity`` lengths, so the driver plans
on a histogram of bounded size whatever the corpus; equal bins are removed together.
Pieces get their place from their rank among pieces of the same length, which a range
sort gives; its last key is the row's number in the written table, so that no length and
no repeated row makes one task larger.

Cases: null and empty texts are one piece with the end token; repeated rows are
packed each, in any order among them; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.bpe import RankBpe, load
from tidewater.llm.common import clean_text, give_back, materialize


#: Pieces to a partition of the range sort, at least.
PART_ROWS = 50_000


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents where they fit, else cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(path, RankBpe), np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            row, out = [], [[] for _ in range(4)]
            for k, ids in enumerate(bpe.encode(x.as_py() for x in b.column("text"))):
                ids += end
                n = len(ids) // 4
                at, to, i = 0, n % capacity or capacity, 0
                while at < n:
                    row.append(k)
                    for column, x in zip(out, (i, at, to - at, zlib.crc32(ids[4 * at : 4 * to])), strict=True):
                        column.append(x)
                    at, to, i = to, to + capacity, i + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, longest first, whose sum is the largest that fits into ``room``."""
    steps: list[tuple[int, int, int]] = []  # (length, copies, sums reachable before)
    reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(int(counts[length]), room // length)
        copies = 1
        while left and not reach & goal:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, []
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * copies
            total -= length * copies
    return sorted(out, reverse=True)


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies a bin, offset) in order of length and rank."""
    counts = np.array(counts, np.int64)
    used, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for length in range(capacity, 0, -1):
        while counts[length] > 0:
            counts[length] -= 1
            found = [length, *fullest(counts, capacity - length)]
            counts[length] += 1
            kinds, copies = np.unique(found, return_counts=True)
            bins = int((counts[kinds] // copies).min())
            offset = 0
            for kind, n in zip(kinds[::-1].tolist(), copies[::-1].tolist(), strict=True):
                runs.append((kind, int(used[kind]), sequence, n, offset))
                used[kind] += n * bins
                counts[kind] -= n * bins
                offset += kind * n
            sequence += bins
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut`` (pieces) with sequence_id and offset."""
    key = [F.col("length"), F.xxhash64("doc_id", "piece"), F.col("_n")]
    # written first: the range sort samples its input, which would tokenise twice
    cut = materialize(cut, "cut", "doc_id")
    parts = max(1, cut.count() // PART_ROWS)
    ranked = materialize(
        cut.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(parts, *key).sortWithinPartitions(*key)
        .drop("_n").withColumn("_at", F.monotonically_increasing_id()), "pieces")
    # one row per partition and length; sorted, so partitions + capacity rows at most
    groups = sorted(
        (tuple(r) for r in ranked.groupBy(F.shiftright("_at", 33).alias("part"), "length").agg(F.min("_at"), F.count(F.lit(1))).collect()))
    counts, bases = np.zeros(capacity + 1, np.int64), []
    for part, length, first, n in groups:
        bases.append((part * (capacity + 1) + length, first - counts[length]))
        counts[length] += n
    base, runs = np.array(sorted(bases), np.int64).reshape(-1, 2), plan(counts, capacity)
    run_key = runs[:, 0] << 44 | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, length = (np.asarray(b.column(x), dtype=np.int64) for x in ("_at", "length"))
            if not len(at):
                continue
            rank = at - base[np.searchsorted(base[:, 0], (at >> 33) * (capacity + 1) + length), 1]
            run = runs[np.searchsorted(run_key, length << 44 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 2] + nth // run[:, 3], run[:, 4] + nth % run[:, 3] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, capacity, end_id), capacity)
