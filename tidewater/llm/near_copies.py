"""Near copies of texts: candidates by SimHash balls and MinHash bands, exact checks.

Two texts are near copies if the Jaccard similarity of their sets of five-word windows
is at least the threshold.  Ball hashing over SimHashes of the windows gives the first
candidates.  At a similarity of 0.8 two fingerprints differ in nine of 64 bits on
average, and balls that reach so far cannot be emitted, so the rest come from 40 bands of
5 minima over the same windows: a pair at exactly 0.8 shares no band with a chance of
(1 - 0.8^5)^40, about 1.2e-7, closer pairs with less.  Every link is verified on the two
whole sets, as 64-bit hashes.

Large groups cost no square of their size.  In each bucket all members are first held
against the one that most texts share a bucket with, so that a text and its edited
versions meet in the text.  Texts of buckets that are not one component by then are
compared across components by prefix filtering, which is exact: ordered rarest first, two
sets of a similarity t share one of the first n - ceil(t n) + 1 windows of each.  No
bucket is capped, sampled or gathered into one row, so components are whole.

Cases: windows are read as ``simhash`` reads shingles (ASCII letters lowered, split at
blanks); texts with fewer words than a window have their whole word sequence as the one
window; null, empty and blank texts are copies of each other; repeated rows share a
group, of which one row stays: that with the smallest doc_id (nulls last), then the
smallest hash of its text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import clean_text, give_back, materialize, text_key
from tidewater.llm.components import connected_components
from tidewater.llm.simhash import links as ball_links
from tidewater.llm.simhash import packed

WINDOW, THRESHOLD, RADIUS = 5, 0.8, 2
BANDS, ROWS = 40, 5
#: 64-bit words of parities that tell texts apart before they are compared.
MAPS = 16
#: Windows hashed at a time, so a very long text needs little memory.
_STEP = 512


def windows(text: str, window: int = WINDOW) -> Iterator[bytes]:
    """All windows of ``window`` words in order, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= window:
        return iter([joined] if words else [])
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(ends) - window])]
    return map(joined.__getitem__, map(slice, starts, ends[window - 1 :]))


class Bands:
    """Band keys of a text, 64-bit hashes of ``rows`` minima each, and its SimHash."""

    def __init__(self, window: int, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, (1 << 64) - 1, (bands * rows, 1), np.uint64)
        self.window, self.bands, self.width, self.seed = window, bands, 8 * rows, seed

    def hashes(self, text: str) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.fromiter(map(xxh64_intdigest, windows(text, self.window), repeat(self.seed)), np.uint64)

    def keys(self, h: np.ndarray) -> np.ndarray:
        from xxhash import xxh64_intdigest

        low = np.full(len(self.factors), (1 << 64) - 1, np.uint64)
        for at in range(0, len(h), _STEP):
            np.minimum(low, (h[at : at + _STEP] * self.factors + self.offsets).min(axis=1), out=low)
        raw, n = low.tobytes(), self.width
        return np.fromiter((xxh64_intdigest(raw[k * n : k * n + n], k) for k in range(self.bands)), np.uint64, self.bands)


def signatures(docs: DataFrame, window: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, text_key, fp, bands) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Bands(window, bands, rows, seed)
        for b in batches:
            keys, fps = np.zeros((b.num_rows, bands), np.uint64), np.zeros(b.num_rows, np.uint64)
            for k, t in enumerate(b.column("text")):
                h = maker.hashes(t.as_py())
                keys[k], fps[k] = maker.keys(h), packed([h], len(h))
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(fps.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))],
                ["doc_id", "text_key", "fp", "bands"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_key"), clean_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, text_key long, fp long, bands array<long>")


def parity(found: np.ndarray) -> np.ndarray:
    """Bits of whether an odd number of window hashes fall on each place."""
    bits = np.bincount((found.view(np.uint64) % np.uint64(64 * MAPS)).astype(np.int64), minlength=64 * MAPS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def window_sets(docs: DataFrame, nodes: DataFrame, window: int) -> DataFrame:
    """(node, found, parity) of the texts whose keys are in ``nodes``: the distinct 64-bit
    hashes of all windows, and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            for k in range(0, b.num_rows, 256):  # texts may be long
                found = [np.unique(np.fromiter(map(xxh64_intdigest, windows(t.as_py(), window)), np.uint64)).view(np.int64) for t in b.column("text")[k : k + 256]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("node")[k : k + 256], pa.array(found, pa.list_(pa.int64())), pa.array(list(map(parity, found)), pa.list_(pa.int64()))], ["node", "found", "parity"])
        give_back()

    texts = docs.select(text_key().alias("node"), clean_text().alias("text")).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return texts.mapInArrow(run, "node long, found array<long>, parity array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of text keys whose whole texts are near copies."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    shared, all_of = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where(shared >= F.lit(threshold) * (all_of - shared) - F.lit(1e-9)).select("a", "b")


def across_components(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, root) of different roots, all near copies among them.

    A window that one text alone has counts in its prefix but makes no pair, and bounds
    what the text can share with any other.  Where the parities of two texts differ, so
    do their windows: that bounds the pairs from which the join makes rows."""
    maps = [f"p{k}" for k in range(MAPS)]
    own = sets.join(nodes, "node", "left_semi")
    held = own.select("node", F.size("found").cast("long").alias("size"), F.explode("found").alias("window"))
    counts = held.groupBy("window").agg(F.count(F.lit(1)).alias("texts"))
    length = (F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    prefixes = held.join(counts, "window").groupBy("node", "size").agg(
        F.count_if(F.col("texts") > 1).alias("common"), F.sort_array(F.collect_list(F.struct("texts", "window"))).alias("all"))
    # a text cannot be more like another than the share of its windows that others have
    prefixes = prefixes.where(F.col("common") >= F.lit(threshold) * F.col("size") - F.lit(1e-9)).join(nodes, "node").join(own.select("node", "parity"), "node")
    prefixes = prefixes.select("node", "root", "size", "common", *(F.get("parity", F.lit(k)).alias(m) for k, m in enumerate(maps)), F.inline(F.slice("all", F.lit(1), length)))
    sides = materialize(prefixes.where("texts > 1").drop("texts"), "prefixes")
    other = sides.select("window", *(F.col(c).alias(f"{c}_b") for c in sides.columns if c != "window"))
    most = F.least("common", "common_b")  # windows that two texts can share
    fits = most >= F.lit(threshold) * (F.col("size") + F.col("size_b") - most) - F.lit(1e-9)
    apart = reduce(add, (F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_b"))) for m in maps))
    near = apart <= (F.col("size") + F.col("size_b")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-9)
    pairs = sides.join(other, (sides["window"] == other["window"]) & (F.col("root") < F.col("root_b")) & fits & near)
    return pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(key, node, degree) for all bands that several texts have; degree: how many texts
    the node's buckets hold, a text counted once a bucket."""
    exploded = rows.select("text_key", "bands").dropDuplicates(["text_key"]).select(F.col("text_key").alias("node"), F.explode("bands").alias("key"))
    sizes = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(exploded.join(sizes, "key"), "buckets")
    return materialize(members.join(members.groupBy("node").agg(F.sum("n").alias("degree")), "node").select("key", "node", "degree"), "members")


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with its most shared one, by (key, node, degree)."""
    hubs = materialize(members.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("_best")).select("key", F.col("_best.node").alias("hub")), "hubs")
    pairs = members.join(hubs, "key").where("node != hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def mixed(members: DataFrame, near: DataFrame) -> DataFrame:
    """(node, root) of the members of buckets that are in several components of ``near``."""
    roots = materialize(connected_components(near, "near-links"), "near-roots")
    parts = materialize(members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "parts")
    several = parts.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return parts.join(several.select("key"), "key", "left_semi").select("node", "root").distinct()


def fingerprint_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): texts of equal SimHash with the least of them, and these within the radius."""
    nodes = rows.select(F.col("text_key").alias("node"), "fp").distinct()
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "simhashes")
    same = nodes.join(first, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    stars = ball_links(first.select("fp"), radius)
    named = stars.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.union(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def links(rows: DataFrame, docs: DataFrame, window: int, threshold: float, radius: int) -> DataFrame:
    """Edges (a, b) between text keys that connect what the near copies among candidates connect."""
    members = shared_buckets(rows)
    tested = materialize(hub_pairs(members).union(fingerprint_pairs(rows, radius)).distinct(), "pairs")
    needed = members.select("node").union(tested.select(F.explode(F.array("a", "b")))).distinct()
    sets = materialize(window_sets(docs, needed, window), "windows")
    near = materialize(verified(tested, sets, threshold), "near")
    open_nodes = materialize(mixed(members, near), "open")
    across = materialize(across_components(open_nodes, sets, threshold).join(tested, ["a", "b"], "left_anti"), "across")
    return near.union(verified(across, sets, threshold))


def near_copies(docs: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, bands: int = BANDS, width: int = ROWS, radius: int = RADIUS, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, component_id, group_size, kept, text_key."""
    rows = materialize(signatures(docs, window, bands, width, seed), "signatures", "doc_id")
    roots = materialize(connected_components(links(rows, docs, window, threshold, radius), "links"), "roots")
    named = rows.select("doc_id", "text_key").join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "text_key")), "named")
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    groups = materialize(named.groupBy("root").agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("group_size")), "groups")
    kept = F.col("doc_id").eqNullSafe(F.col("_best.id")) & (F.col("text_key") == F.col("_best.key"))
    return named.join(groups, "root").select("doc_id", F.col("_best.id").alias("component_id"), "group_size", kept.alias("kept"), "text_key")
