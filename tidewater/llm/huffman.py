"""Token ids in canonical length-limited Huffman files.

Layout of a folder: one file a range of doc_ids, ``index`` (Parquet, one row a block:
part, name, offset, length, documents, tokens, and the tokens before it in its file) and
``manifest`` (Parquet, one row a file: part, tokens, base).  Layout of a file: magic, the
code lengths (zlib), then independent blocks.  A block holds whole documents: their
doc_ids (an Arrow stream) and token counts, the bit offset of every CHECKPOINT-th token,
and the bits.  Blocks are read by byte range and decoded on their own; within one all
checkpoints advance together through a table of the next LIMIT bits.

Cases: null texts are the end token alone; an empty table gives no files and no
rows; documents with equal or null doc_ids stand together, in the order of a hash of
their ids, and may be split among files; very long texts make a block of their own;
vocabularies or end ids beyond 16 bits are refused with a ValueError.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.bpe import RankBpe, load
from tidewater.llm.common import clean_text, fresh_path, open_fs, remove

MAGIC = b"TWHUFF02"
LIMIT = 16  # longest code, in bits
CHECKPOINT = 64  # tokens between bit offsets
BLOCK = 1 << 16  # tokens after which a block is closed
FILE = 1 << 24  # tokens to a file, about
RANGE = 1 << 23  # bytes of a file that one reading task takes, about
_INDEX = "part long, name string, offset long, length long, documents long, tokens long, before long"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where unused."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.float64)
    weights, levels = leaf, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        packed = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, packed])
        order = np.argsort(both, kind="stable")
        weights = both[order]
        levels.append(order < len(leaf))
    take = 2 * len(leaf) - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        out[used[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


class Code:
    """The canonical code of given lengths: by length, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = self.lengths[order]
        starts = np.concatenate([[0], np.cumsum(1 << (LIMIT - size))[:-1]]).astype(np.int64)
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = starts  # left-aligned in LIMIT bits
        self.symbol, self.step = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
        fill = np.repeat(order, 1 << (LIMIT - size))
        self.symbol[: len(fill)], self.step[: len(fill)] = fill, self.lengths[fill]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every CHECKPOINT-th token."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        bits = np.unpackbits(self.codes[ids].astype(">u2").view(np.uint8)).reshape(-1, LIMIT)
        return np.packbits(bits[np.arange(LIMIT) < n[:, None]]).tobytes(), (ends - n)[::CHECKPOINT].astype("<u4")

    def decode(self, bits: bytes, offsets: np.ndarray, total: int) -> np.ndarray:
        """All ``total`` ids: every checkpoint's run advances by one token a step."""
        data = np.frombuffer(bits + bytes(4), np.uint8).astype(np.uint32)
        window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at, out = offsets.astype(np.int64), np.zeros((CHECKPOINT, len(offsets)), np.uint32)
        last = total - CHECKPOINT * (len(offsets) - 1)
        for k in range(min(CHECKPOINT, total)):
            if k == last:  # the last run is shorter
                at = at[:-1]
            if not len(at):
                break
            key = window[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
            out[k, : len(at)] = self.symbol[key]
            at = at + self.step[key]
        return out.T.ravel()[:total]


def _block(code: Code, docs: list[bytes], doc_ids: pa.Array) -> bytes:
    """docs: little-endian 16-bit ids as bytes, one entry a document."""
    ids = np.frombuffer(b"".join(docs), "<u2")
    bits, offsets = code.encode(ids)
    sizes = np.array([len(x) // 2 for x in docs], "<u4").tobytes()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, pa.schema([("doc_id", doc_ids.type)])) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([doc_ids], ["doc_id"]))
    names = out.getvalue()
    head = np.array([len(docs), len(ids), len(offsets), len(names), len(bits)], "<u8").tobytes()
    return head + sizes + offsets.tobytes() + names + bits


def read_block(code: Code, data: bytes) -> tuple[pa.Array, list[int], np.ndarray]:
    """(doc_ids, token counts, ids) of one block."""
    n, total, marks, names, size = np.frombuffer(data, "<u8", 5).tolist()
    at = 40
    sizes = np.frombuffer(data, "<u4", n, at).tolist()
    offsets = np.frombuffer(data, "<u4", marks, at := at + 4 * n)
    at += 4 * marks
    doc_ids = pa.ipc.open_stream(data[at : at + names]).read_all().column("doc_id").combine_chunks()
    return doc_ids, sizes, code.decode(data[at + names : at + names + size], offsets, total)


def tokens_of(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 16-bit ids with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, RankBpe)
        if max(end_id, int(bpe.to_id.max()), *bpe.special.values(), 0) >= 1 << 16 or end_id < 0:
            raise ValueError(f"{path}: ids of more than 16 bits cannot be written")
        end = np.uint16(end_id).astype("<u2").tobytes()
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() + end for x in bpe.encode(x.as_py() for x in b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def global_counts(tokens: DataFrame) -> np.ndarray:
    """How often each of the 65,536 possible ids occurs in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Write ``docs`` below ``folder`` in ascending doc_id order; returns the index.

    Texts are tokenised once, into a table of ids that is removed at the end.  A task
    writes a file under a name of its own attempt and only the attempt that Spark
    accepted is in the index, so lost or repeated tasks do no harm.  The driver holds
    two numbers a file.
    """
    spark = docs.sparkSession
    tokens_at = fresh_path(spark, "ids")
    tokens_of(docs, path, end_id).write.option("compression", "zstd").parquet(tokens_at)
    tokens = spark.read.parquet(tokens_at)
    counts = global_counts(tokens)
    parts = partitions or max(1, -(-int(counts.sum()) // FILE))
    lengths = code_lengths(counts)
    packed = zlib.compress(lengths.tobytes(), 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(lengths), TaskContext.get().partitionId()
        fs, at = open_fs(folder)
        name = f"{part:06d}-{uuid.uuid4().hex}.huf"
        out, waiting, ids, size, offset, before, done = None, [], [], 0, 0, 0, []

        def flush() -> None:
            nonlocal out, waiting, ids, size, offset, before
            if out is None:
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}")
                head = MAGIC + np.array([len(packed)], "<u8").tobytes() + packed
                out.write(head)
                offset = len(head)
            block = _block(code, waiting, pa.concat_arrays(ids))
            out.write(block)
            done.append((part, name, offset, len(block), len(waiting), size, before))
            offset, before, waiting, ids, size = offset + len(block), before + size, [], [], 0

        try:
            for b in batches:
                first = 0
                for k, x in enumerate(b.column("ids").to_pylist()):
                    waiting.append(x)
                    size += len(x) // 2
                    if size >= BLOCK:
                        ids.append(b.column("doc_id").slice(first, k + 1 - first))
                        first = k + 1
                        flush()
                if first < b.num_rows:
                    ids.append(b.column("doc_id").slice(first))
            if waiting:
                flush()
        finally:
            if out is not None:
                out.close()
        for k in range(0, len(done), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done[k : k + 4096], strict=True)], [x.split()[0] for x in _INDEX.split(", ")])

    order = ["doc_id", F.xxhash64("ids")]  # equal doc_ids need not meet in one file
    tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")
    remove(spark, tokens_at)
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    files = sorted((r["part"], r["tokens"]) for r in index.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect())
    bases = np.cumsum([0, *(n for _, n in files)]).tolist()
    manifest = spark.createDataFrame([(part, n, base) for (part, n), base in zip(files, bases, strict=False)], "part long, tokens long, base long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return index


def file_code(fs, at: str) -> Code:
    """The code of one file."""
    with fs.open_input_stream(at) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{at}: not a token file")
        return Code(np.frombuffer(zlib.decompress(f.read(int(np.frombuffer(f.read(8), "<u8")[0]))), np.uint8))


def read_tokens(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        name, code, f = None, None, None
        try:
            for b in batches:
                for r in b.to_pylist():
                    if r["name"] != name:
                        if f is not None:
                            f.close()
                        name, path = r["name"], f"{at}/{r['name']}"
                        code, f = file_code(fs, path), fs.open_input_file(path)
                    doc_ids, sizes, ids = read_block(code, f.read_at(r["length"], r["offset"]))
                    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                    own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        doc_ids, pa.array(r["start"] + ends - np.array(sizes)), pa.array(sizes, pa.int64()),
                        pa.array(list(map(zlib.crc32, own)), pa.int64()), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
        finally:
            if f is not None:
                f.close()

    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    manifest = spark.read.schema("part long, tokens long, base long").parquet(f"{folder}/manifest")
    # a range of a file is one key, so a file is read by several tasks
    blocks = index.join(manifest.select("part", "base"), "part").select(
        "name", "offset", "length", (F.col("base") + F.col("before")).alias("start"), F.floor(F.col("offset") / RANGE).alias("_range"))
    tasks = max(1, int(index.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]) // RANGE)
    spread = blocks.repartition(tasks, "name", "_range").sortWithinPartitions("name", "offset")
    return spread.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, ids binary")


def huffman_roundtrip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    write_tokens(docs, path, folder, end_id)
    return read_tokens(spark, folder, docs.schema["doc_id"].dataType.simpleString()).drop("ids")
