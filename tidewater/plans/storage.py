"""Relation states as Parquet in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
#: Pieces of a relation after which it is rewritten as one.
MAX_PIECES = 24
#: Rows of a result that may be fetched to the driver.
LOCAL_ROWS = 10_000
#: Rows that may stay there where the driver made them itself.
LOCAL_LIMIT = 250_000
#: Candidates up to which a larger relation is probed where it lies, without a shuffle.
PROBE_ROWS, PROBE_BYTES = 200_000, 16 << 20
_NOTED: ContextVar[set[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted(files: set[str]) -> Iterator[None]:
    """Note in ``files`` all that ``write`` makes meanwhile in this thread."""
    token = _NOTED.set(files)
    try:
        yield
    finally:
        _NOTED.reset(token)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a session on one machine has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='tidewater-')}")
    return found.rstrip("/")


class DivergenceError(RuntimeError):
    """A recursive stratum did not reach its fixpoint in the allowed rounds."""


class Table:
    """Disjoint pieces of one relation, and how many rows they have.

    Pieces are Parquet files, but for a bounded number of rows that stay on the driver so
    that small epochs cost no job; the bound does not grow with the data.  ``old`` and
    ``dead`` are files of rows and of those that are no longer among them: a removal
    writes what it removes, and the relation is written anew only when a fourth is dead.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, paths: tuple[str, ...] = (), count: int = 0, local: frozenset = frozenset(), old: tuple[str, ...] = (), dead: tuple[str, ...] = (), gone: int = 0):
        self.spark, self.schema, self.paths, self.count, self.local = spark, schema, paths, count, local
        self.old, self.dead, self.gone = old, dead, gone
        self._df: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, schema: T.StructType, rows: Iterable[tuple]) -> Table:
        """Rows that the driver has; more than LOCAL_LIMIT of them are written."""
        rows = frozenset(rows)
        out = cls(spark, schema, (), len(rows), rows)
        return write(out.df, schema) if len(rows) > LOCAL_LIMIT else out

    @property
    def is_local(self) -> bool:
        return not self.paths and not self.old

    @property
    def files(self) -> tuple[str, ...]:
        """All files that the rows are made from."""
        return self.paths + self.old + self.dead

    def _read(self, paths: tuple[str, ...]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            parts = []
            if self.old:
                parts.append(self._read(self.old).join(self._read(self.dead), self.schema.names, "left_anti"))
            if self.paths:
                parts.append(self._read(self.paths))
            if self.local or not parts:
                parts.append(self.spark.createDataFrame(list(self.local), self.schema))
            self._df = reduce(DataFrame.unionByName, parts)
        return self._df

    def plus(self, other: Table) -> Table:
        """Both pieces; the caller knows that they are disjoint."""
        if not other.count:
            return self
        if not self.count:
            return other
        if other.old:  # rows that were removed there may be here
            other = write(other.df, self.schema)
        out = Table(self.spark, self.schema, self.paths + other.paths, self.count + other.count, self.local | other.local, self.old, self.dead, self.gone)
        return write(out.df, self.schema) if len(out.local) > LOCAL_LIMIT or len(out.files) > MAX_PIECES else out

    def minus(self, other: Table) -> Table:
        """The rows that ``other`` does not have."""
        if not other.count or not self.count:
            return self
        if self.is_local and other.is_local:
            return Table.of(self.spark, self.schema, self.local - other.local)
        return write(self.df.join(other.df, self.schema.names, "left_anti"), self.schema)

    def without(self, other: Table) -> Table:
        """``minus`` where all rows of ``other`` are known to be here."""
        if not other.count or self.is_local or other.count == self.count or self.local:
            return self.minus(other) if other.count != self.count else Table(self.spark, self.schema)
        if other.is_local:
            other = write(other.df, self.schema)
        gone, n = self.gone + other.count, self.count - other.count
        if other.old or self.old and self.paths or 4 * gone > n or len(self.files) + len(other.paths) > MAX_PIECES:
            return self.minus(other)
        # one layer of removals: rows added later stand beside it
        return Table(self.spark, self.schema, (), n, frozenset(), self.paths or self.old, self.dead + other.paths, gone)


def write(df: DataFrame, schema: T.StructType, small: bool = False, fetch: bool = False) -> Table:
    """Run ``df`` once and keep its rows; an empty result keeps nothing.

    ``small``: the caller knows that few rows go in and expects few to come out, which are
    then fetched; where that proves wrong, the rows are written after all.
    ``fetch``: what proves to be few rows is read back from what was written."""
    spark = df.sparkSession
    if small:
        rows = df.limit(LOCAL_ROWS + 1).collect()
        if len(rows) <= LOCAL_ROWS:
            return Table(spark, schema, (), len(rows), frozenset(tuple(r) for r in rows))
    path = f"{shared_folder(spark)}/tidewater-state-{uuid.uuid4().hex}"
    if (files := _NOTED.get()) is not None:
        files.add(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    n = seen.get["n"]
    if n and fetch and n <= LOCAL_ROWS:
        rows = spark.read.schema(schema).parquet(path).collect()
        delete(spark, path)
        return Table(spark, schema, (), n, frozenset(tuple(r) for r in rows))
    if not n:
        delete(spark, path)
    return Table(spark, schema, (path,), n) if n else Table(spark, schema)


def _probe(df: DataFrame, known: Table) -> tuple[DataFrame, DataFrame]:
    """``df``, and rows of ``known`` among which are all that it shares with ``df``.

    A join would shuffle all of ``known``, each round again.  Where it is much, ``df`` is
    written first; if that proves to be little, by rows and by bytes, it is broadcast, and
    what it meets in ``known``, at most as many rows, is broadcast in turn."""
    if known.count <= PROBE_ROWS:
        return df, known.df
    held = write(df, known.schema)
    if held.count > PROBE_ROWS or sum(_size(known.spark, p) for p in held.paths) > PROBE_BYTES:
        return held.df, known.df
    return held.df, F.broadcast(known.df.join(F.broadcast(held.df), known.schema.names, "left_semi"))


def among(df: DataFrame, known: Table) -> DataFrame:
    """The rows of a set that are known."""
    df, met = _probe(df, known)
    return df.join(met, known.schema.names, "left_semi")


def absent(df: DataFrame, known: Table) -> DataFrame:
    """The rows of a set that are not known."""
    df, met = _probe(df, known)
    return df.join(met, known.schema.names, "left_anti")


def file_system(spark: SparkSession, path: str):
    """A path of the JVM's and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _size(spark: SparkSession, path: str) -> int:
    target, fs = file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete files of our own that nothing reads any more."""
    if (files := _NOTED.get()) is not None:
        files.difference_update(paths)
    for path in paths:
        target, fs = file_system(spark, path)
        fs.delete(target, True)
