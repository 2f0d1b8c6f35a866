"""Exact deduplication with a heavy-hitter split [DataFrame functions only].

Misra-Gries finds the frequent digests: Spark's ``approx_top_k`` functions keep a
frequent-items sketch of that family, whose per-partition sketches are merged in two
levels.  Exact counts and winners of all candidates are verified by one aggregation and
broadcast for map-side resolution; all other digests take the ordinary shuffle.

Cases: null text counts as empty; equal texts form one group whatever their other
columns; of rows that repeat the largest doc_id exactly one stays; null doc_ids rank
below every other; an empty table gives an empty result.  Only the id and text
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import clean_text, materialize, text_key

#: Counters of the Misra-Gries sketch, and so at most that many rows are broadcast.  A
#: key of more than rows / 500 is always among the candidates: the sketch has room for
#: twice the counters, and its error is at most 3.5 / (2 TRACKED) of the rows.
TRACKED = 2048
#: Sketches of the first level of merging.
MERGED = 256


def heavy_digests(digests: DataFrame, tracked: int = TRACKED, name: str = "text_sha256") -> list[str]:
    """All keys in ``name`` that the sketch over all rows holds with a share of more than
    1 / ``tracked``; at most ``tracked``, since shares add up to one."""
    parts = digests.groupBy((F.spark_partition_id() % MERGED).alias("_part")).agg(
        F.expr(f"approx_top_k_accumulate({name}, {2 * int(tracked)})").alias("sketch"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(F.col("n") < 0).agg(F.expr(f"approx_top_k_combine(sketch, {2 * int(tracked)})").alias("sketch"), F.sum("n").alias("n"))  # no row for an empty table
    found = whole.select(F.expr(f"approx_top_k_estimate(sketch, {2 * int(tracked)})").alias("top"), "n").head()
    return [] if found is None or found.top is None else [x["item"] for x in found.top if x["item"] is not None and x["count"] > max(1, found.n // tracked)]


def with_groups(rows: DataFrame, name: str, *best: Column, tracked: int = TRACKED) -> DataFrame:
    """``rows`` (a written table) with aggregates over all rows of the same key in ``name``.

    Verified aggregates of frequent keys are broadcast, others are joined by shuffle."""
    heavy = heavy_digests(rows, tracked, name)
    if not heavy:
        return rows.join(rows.groupBy(name).agg(*best), name)
    often = F.col(name).isin(heavy)
    winners, rest = F.broadcast(rows.where(often).groupBy(name).agg(*best)), rows.where(~often)
    return rows.join(winners, name).unionByName(rest.join(rest.groupBy(name).agg(*best), name))


def exact_dedup(docs: DataFrame, normalized: Column | None = None, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    ``normalized`` is the text that is compared (the text itself by default).
    """
    text = clean_text() if normalized is None else F.coalesce(normalized, F.lit(""))
    digests = materialize(
        docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), text_key().alias("text_key"),
                    F.monotonically_increasing_id().alias("_row")), "digests", "_row")
    out = with_groups(digests, "text_sha256", F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_best"), tracked=tracked)
    return out.select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size",
        (F.col("_best._row") == F.col("_row")).alias("kept"), "text_sha256", "text_key")
