"""A keyed event ring: of each key's events in an interval the latest stands for all, with state for each key's open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A store that keeps open intervals on disk, not in the memory of the executors.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def coalesced_stream(events: DataFrame, key: str, at: str, sequence: str, seconds: int, lateness: str) -> DataFrame:
    """coalesce_key, slot, merged, sequence and the other columns: what ``log.coalesced`` gives, interval by interval as the watermark passes its end.

    ``events`` is a stream. Of a key's events in an interval the one of largest ``sequence`` stands for all; merged says for
    how many. An interval is given out once; events that come after that are left out, and so are events with a null time or
    sequence. State is a row for each key and open interval, which an aggregate over windows of time updates and drops.
    """
    rest = [c for c in events.columns if c not in (key, sequence)]
    e = events.where(F.col(at).isNotNull() & F.col(sequence).isNotNull()).withColumn("__at", F.col(at)).withWatermark("__at", lateness)
    last = F.max_by(F.struct(F.col(f"`{sequence}`").alias("__sequence"), *[F.col(f"`{c}`") for c in rest]), F.col(sequence).cast("bigint"))
    out = e.groupBy(F.window("__at", f"{seconds} seconds").alias("__w"), F.col(key)).agg(F.count("*").alias("merged"), last.alias("__r"))
    slot = F.floor(F.unix_millis("__w.start") / (1000 * seconds))
    return out.select(key, slot.alias("slot"), "merged", F.col("__r.__sequence").alias(sequence), *[F.col(f"__r.`{c}`").alias(c) for c in rest])
