"""Shared pieces of the corpus operators: written tables, row ids, label samples.

Intermediate tables are Parquet files below the folder in ``spark.checkpoint.dir``
so that they outlive any executor.  Only a session on one machine may name none; it
gets a temporary folder.
"""

from __future__ import annotations

import contextlib
import io
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}  # by application, where the session names no folder
WHITESPACE = " \t\n\x0b\x0c\r"  # \x20 and \x09-\x0D


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that they
    can import it wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root, packed = pathlib.Path(__file__).parents[2], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((root / "tidewater").rglob("*.py")):
            z.write(f, f.relative_to(root))
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/tidewater-{app}.zip"
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only if unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidewater-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and gives
    every later branch the same rows even if executors are lost.

    ``by``: a column of narrow rows by whose hash they are first gathered into files of
    the advisory partition size, instead of one small file a task of a wide scan."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.hint("rebalance", by) if by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_seen(df: DataFrame, label: str, **seen: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates of the rows that are observed while they are written."""
    told = Observation()
    return materialize(df.observe(told, *(c.alias(k) for k, c in seen.items())), label), told.get


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of our own that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def open_fs(uri: str):
    """(filesystem, path) of any URI that Arrow can open: file, hdfs, s3, gs."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def give_back() -> None:
    """Return free memory of a Python worker, which serves many tasks, to the machine."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def clean_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def own_names(columns: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem that none of ``columns`` has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled training rows (doc_id as text, text, label, fold 0-9).

    The ids are those with the smallest hash among the labelled ones that are not held
    out, so the sample does not depend on partitioning; at most ``bound`` ids are
    broadcast.  An id that repeats in ``docs`` gives one row, its least text, so that the
    bound holds for rows too; one that repeats in ``labels`` has its largest label.
    """
    ids = (
        labels.select(F.col("doc_id").cast("string").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.col("_id"), F.lit("sample")), "_id").limit(bound)
    )
    picked = docs.select(F.col("doc_id").cast("string").alias("_doc"), clean_text().alias("text")).join(
        F.broadcast(ids), F.col("_doc") == F.col("_id"), "inner").groupBy("_id", "label").agg(F.min("text").alias("text"))
    return picked.select(F.col("_id").alias("doc_id"), "text", "label",
                         F.pmod(F.xxhash64(F.col("_id"), F.lit("fold")), F.lit(10)).cast("int").alias("fold"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of text) is in ``kept`` (doc_id, text_key).

    Rows that repeat both id and text count as one document and come back once.
    One shuffle by the row's own key, which no group of copies can make hot.
    """
    columns = docs.columns
    key, same, other = own_names(columns, "_key", "_rid", "_rkey")
    left = docs.withColumn(key, text_key())
    right = kept.select(F.col("doc_id").alias(same), F.col("text_key").alias(other))
    found = left.join(right, F.col("doc_id").eqNullSafe(F.col(same)) & (F.col(key) == F.col(other)), "left_semi")
    return found.dropDuplicates(["doc_id", key]).select(*columns)


def text_key(name: str = "text") -> Column:
    return F.xxhash64(clean_text(name), F.lit("key"))
