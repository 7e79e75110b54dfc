"""The keyed event ring: a stream in runs from one checkpoint against the batch form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import log, ring

SCHEMA = "k string, at timestamp, seq bigint, v double, note string"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ring.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def events(seed, first, n, minutes):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(rng.choice(["a", "b", "c", None]), start + timedelta(seconds=60 * minutes + rng.uniform(0, 1200)), first + i, rng.random(), rng.choice(["x", 'q"uote', None])) for i in range(n)]


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, mark):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = ring.coalesced_stream(stream, "k", "at", "seq", 60, "10 minutes").writeStream.option("checkpointLocation", mark).format("parquet").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()


def test_runs_from_one_checkpoint_equal_the_batch_form(store, tmp_path):
    spark, (folder, out, mark) = store, (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    first, second = events(1, 0, 60, 0), events(2, 100, 60, 15)
    put(spark, folder, first)
    run(spark, folder, out, mark)
    early = spark.read.parquet(out).count()
    put(spark, folder, second)
    run(spark, folder, out, mark)
    # An event far ahead lets the watermark pass all others.
    put(spark, folder, [("z", datetime(2024, 1, 2), 999, 0.0, None)])
    run(spark, folder, out, mark)
    # A second file's events are at most 5 minutes late; the watermark waits for 10.
    batch = log.coalesced(spark.createDataFrame([*first, *second], SCHEMA), ["k"], "at", "seq", 60)
    rows = lambda d: sorted(map(repr, d.select("k", F.col("slot").cast("long"), "merged", "seq", F.col("at").cast("string"), F.round("v", 9), "note").collect()))
    assert rows(spark.read.parquet(out)) == rows(batch)
    assert 0 < early < batch.count()


def test_events_too_late_are_left_out(store, tmp_path):
    spark, (folder, out, mark) = store, (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    put(spark, folder, [("a", datetime(2024, 1, 1, 0, 0, 5), 1, 1.0, None), ("a", datetime(2024, 1, 1, 2), 2, 2.0, None)])
    run(spark, folder, out, mark)
    put(spark, folder, [("a", datetime(2024, 1, 1, 0, 0, 6), 3, 3.0, None), ("a", None, 4, 4.0, None), ("b", datetime(2024, 1, 1, 5), 5, 5.0, None)])
    run(spark, folder, out, mark)
    assert sorted((r.k, r.seq, r.merged) for r in spark.read.parquet(out).collect()) == [("a", 1, 1), ("a", 2, 1)]


def test_intervals_take_no_python_call_each(store, tmp_path):
    spark, folder = store, f"{tmp_path}/in"
    put(spark, folder, events(3, 0, 5, 0))
    out = ring.coalesced_stream(spark.readStream.schema(SCHEMA).parquet(folder), "k", "at", "seq", 60, "10 minutes")
    assert "Python" not in out._jdf.queryExecution().analyzed().toString() and "InPandas" not in out._jdf.queryExecution().analyzed().toString()
