"""Incremental operators: log cursors, keep-latest, command deduplication, resumable work, and their streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


def page(log: DataFrame, sequence: str, cursor: int, size: int = 1000, ring: int | None = None) -> DataFrame:
    """The next rows after a cursor, with next_cursor, dropped (rows lost from the ring) and cursor_reset (cursor past the end)."""
    ends = log.agg(F.max(sequence).alias("last"), F.min(sequence).alias("low"))
    ends = ends.withColumn("first", F.greatest(F.col("low"), F.col("last") - (ring - 1)) if ring else F.col("low"))
    ends = ends.withColumn("cursor_reset", F.lit(cursor) > F.col("last")).withColumn("from", F.when(F.col("cursor_reset"), F.col("first") - 1).otherwise(F.greatest(F.lit(cursor), F.col("first") - 1)))
    ends = ends.withColumn("dropped", F.when(F.col("cursor_reset"), F.lit(0)).otherwise(F.greatest(F.col("first") - 1 - cursor, F.lit(0))).cast("long"))
    rows = log.join(F.broadcast(ends), F.col(sequence) > F.col("from")).orderBy(sequence).limit(size)  # ends is one row
    return rows.withColumn("next_cursor", F.max(sequence).over(Window.partitionBy())).drop("last", "low", "first", "from")


def keep_latest(df: DataFrame, key: str | list[str], order: list[Column], k: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)


def coalesced(df: DataFrame, key: list[str], at: str, sequence: str, seconds: int) -> DataFrame:
    """The last row of each key in each interval, and how many it stands for."""
    rest = [c for c in df.columns if c not in key]
    slot = F.floor(expr.seconds(at) / seconds).alias("slot")
    return df.groupBy(*key, slot).agg(F.max_by(F.struct(*rest), sequence).alias("r"), F.count("*").alias("merged")).select(*key, "slot", "merged", "r.*")


def first_commands(df: DataFrame, command: str, sequence: str) -> DataFrame:
    """The first row of each command id, and how many repeats it had."""
    rest = [c for c in df.columns if c != command]
    return df.groupBy(command).agg(F.min_by(F.struct(*rest), sequence).alias("r"), (F.count("*") - 1).alias("repeats")).select(command, "repeats", "r.*")


def remaining(jobs: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Jobs without a done marker: a run goes on where the last one stopped."""
    return jobs.join(done, key, "left_anti")


def projected_states(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """The state of each input from its events: error, incorporated, committed, else pending; settled: committed and incorporated."""
    kinds = {k: F.max((F.col("kind") == k).cast("int")) for k in ("incorporated", "committed", "error")}
    s = events.groupBy(key).agg(*[v.alias(k) for k, v in kinds.items()], F.max(sequence).alias("last"))
    state = F.when(F.col("error") == 1, "error").when(F.col("incorporated") == 1, "incorporated").otherwise("pending")
    return s.withColumn("state", state).withColumn("settled", (F.col("committed") == 1) & (F.col("incorporated") == 1)).select(key, "state", "settled", "last")


def collective_state(reports: DataFrame, group: str, member: str, epoch: str, state: str, members: int) -> DataFrame:
    """Ready groups have a report of every member, one epoch and one state; else the laggard is the least (epoch, member)."""
    g = reports.groupBy(group).agg(F.countDistinct(member).alias("reported"), F.countDistinct(epoch).alias("epochs"), F.countDistinct(state).alias("states"), F.min_by(member, F.struct(epoch, member)).alias("laggard"))
    ready = (F.col("reported") == members) & (F.col("epochs") == 1) & (F.col("states") == 1)
    return g.withColumn("ready", ready).withColumn("laggard", F.when(~ready, F.col("laggard")))


# ---------------------------------------------------------------- streams


def deduplicated_stream(stream: DataFrame, command: str, at: str, lateness: str) -> DataFrame:
    """Each command id once within the watermark; its state goes when the watermark passes."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([command])


def windowed_stream(stream: DataFrame, at: str, lateness: str, length: str, slide: str | None, *keys: str) -> DataFrame:
    return stream.withWatermark(at, lateness).groupBy(F.window(at, length, slide or length), *keys).agg(F.count("*").alias("n"))


def append_batches(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], dead_letters: str):
    """A query that appends prepared micro-batches. A batch that ``prepare`` refuses goes to ``dead_letters`` and the stream goes on.

    Only what ``prepare`` itself raises counts as bad input. What fails while rows are computed or written (a lost
    executor, a full disk) ends the query, and the batch is taken again from the checkpoint. A batch's files are in a folder
    of its id, so that a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        try:
            ready = prepare(batch)
        except Exception as error:  # noqa: BLE001  the session outlives a bad input
            batch.withColumn("error", F.lit(str(error)[:500])).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
            return
        ready.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def ended_batches(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Appends all that is there to read now, batch by batch, and stops; a later call goes on from the checkpoint. Batches so far."""
    query = append_batches(stream, path, checkpoint, lambda batch: batch, f"{path}-dead").trigger(availableNow=True).start()
    query.awaitTermination()
    return (query.lastProgress or {"batchId": -1})["batchId"] + 1
