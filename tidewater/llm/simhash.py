"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius.  Two
fingerprints within the radius share a variant, so grouping by variant finds every
pair; a group holds at most one ball of fingerprints (65 for radius 2), whatever the
data, because equal fingerprints are merged first.  Links within a group are verified
and reduced to a star, which keeps components whole.  Rows find their component through
written tables of one row a fingerprint, so that Spark can split the rows of a
fingerprint that many texts have.

Cases: null and empty texts have fingerprint zero and are linked like any other;
texts with fewer words than a shingle hash their whole word sequence; repeated rows
share a fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import clean_text, materialize, text_key
from tidewater.llm.components import connected_components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256
#: Shingles hashed at a time, so a very long text needs little memory.
_STEP = 1 << 16
#: Fingerprints to a task that emits their variants.
_EMIT = 20_000


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of the whole text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
    hashes = map(xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :])), repeat(seed))
    total = len(words) - shingle + 1
    return packed((np.fromiter(hashes, np.uint64, min(_STEP, total - at)) for at in range(0, total, _STEP)), total)


def packed(hashes: Iterable[np.ndarray], total: int) -> int:
    """The SimHash of ``total`` 64-bit hashes, given in parts: bits set in over half of them."""
    counts = np.zeros(2048, np.int64)
    for h in hashes:
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048)
    ones = np.einsum("ij,jk->ik", counts.reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_key"), clean_text().alias("text")).mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def ball(fp: Column, radius: int) -> Column:
    """All values within ``radius`` bits (0, 1 or 2) of ``fp``, each once."""
    one = [F.lit(1).cast("long") if k == 0 else F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)]
    masks = [F.lit(0).cast("long")]
    if radius >= 1:
        masks += one
    if radius >= 2:
        masks += [one[i].bitwiseOR(one[j]) for i in range(64) for j in range(i)]
    if radius > 2:
        raise ValueError("a ball of more than 2 bits is too large to emit")
    return F.transform(F.array(*masks), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Star edges (a, b) that connect exactly what pairs within ``radius`` bits connect.

    ``fps``: a written table of distinct fingerprints, fp."""
    half = (radius + 1) // 2
    spread = fps.repartition(max(1, fps.count() // _EMIT), "fp")  # a few small files would be a few tasks
    variants = spread.select("fp", F.explode(ball(F.col("fp"), half)).alias("variant"))
    groups = variants.groupBy("variant").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    if radius % 2 == 0:  # two members are each within half the radius of the variant
        pairs = groups.select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    else:
        pairs = groups.select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b"))
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id, group_size, text_key."""
    rows = materialize(fingerprints(docs, shingle, seed), "fingerprints", "doc_id")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "distinct")
    roots = materialize(connected_components(links(distinct.select("fp"), radius), "links"), "roots")
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "named")
    groups = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("rows").alias("group_size")), "groups")
    by_fp = materialize(named.select("fp", "root").join(groups, "root").select("fp", "component_id", "group_size"), "components")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size", "text_key")
