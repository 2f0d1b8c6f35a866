"""Structured Streaming in front of a database: one micro-batch, one epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.plans.database import Database
from tidewater.plans.durable import save
from tidewater.plans.storage import file_system


def stream_into(db: Database, message: str, rows: DataFrame, checkpoint: str | None = None, trigger: dict | None = None, after: Callable[[int], None] | None = None, state: str | None = None) -> StreamingQuery:
    """Feed a streaming DataFrame to a message.

    A boolean column ``added`` marks removals (false) of a @differential message; a null in
    it is an error.  Published changes go to the database's ``on_publish`` once an epoch;
    an epoch that fails changes nothing and is published again when it is repeated.

    ``state``: a folder in which the database is saved after every micro-batch.  After a
    restart of the driver, pass what ``durable.restore`` gives with the same checkpoint:
    a micro-batch that the saved state already has is skipped.  A database and a
    checkpoint that do not belong together are refused, since facts would be missing.
    Several streams may feed one database; they take turns.
    """
    stream = f"{message} {checkpoint}"
    if checkpoint:
        _belong(rows.sparkSession, checkpoint, db.positions.get(stream, -1))

    def epoch(batch: DataFrame, number: int) -> None:
        with db.lock:
            if not checkpoint or number > db.positions.get(stream, -1):
                _send(db, message, batch)
                db.positions[stream] = number
                if state:
                    save(db, state)
        if after:
            after(number)

    writer = rows.writeStream.foreachBatch(epoch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def _send(db: Database, message: str, batch: DataFrame) -> None:
    if "added" not in batch.columns:
        db.send(message, batch)
        return
    batch = batch.persist()  # read twice
    marked = F.when(F.col("added").isNull(), F.raise_error(F.lit(f"{message}: a row is neither added nor removed"))).otherwise(F.col("added"))
    db.send(message, batch.where(marked).drop("added"), batch.where(~marked).drop("added"))
    batch.unpersist()


def _belong(spark: SparkSession, checkpoint: str, done: int) -> None:
    """Refuse a checkpoint that has read more than the database, or never read what it has."""
    def numbers(log: str) -> list[int]:
        target, fs = file_system(spark, f"{checkpoint}/{log}")
        names = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
        return [int(n) for n in names if n.isdigit()]

    if max(numbers("commits"), default=-1) > done:
        raise RuntimeError(f"{checkpoint} is past micro-batch {done}, the last that this database has: restore its state or start with an empty checkpoint")
    if done >= 0 and done not in numbers("offsets"):
        raise RuntimeError(f"{checkpoint} does not know micro-batch {done}, which this database has")
