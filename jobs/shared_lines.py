"""Job: which of their lines documents share, kept up to date as documents arrive.

A document is a track of cells: its lines, with A-Z lower-cased, white space made one space and trimmed; lines of fewer than
``least_words`` words are none. A cell that two documents or more cross is shared. For each document the job keeps how
many lines it has, how many are shared, and its longest run of shared lines (the earliest of equals).

    python -m jobs.shared_lines --documents DIR --out DIR --checkpoint DIR [--config jobs/shared_lines.json]

``--documents`` is a folder (or file) of Parquet with doc_id, lang, source, text. Files that came since the last run are
taken, as the file stream's checkpoint tells; with nothing new nothing is written. Under ``--out``:

    store/batch=N    one row for each new document: its cells in order, as 128-bit hashes
    cells/batch=N    how many documents of the batch cross a cell, and the least id of them
    tracks/batch=N/bucket=K   rows for the documents that the batch brought or changed; ``current`` has the latest of each

A batch writes only its own folders, each as a whole, and reads only what earlier ones wrote: one that is run again
replaces itself with the same rows. A cell that was crossed once before names the one document that changes with it, so
old documents are not searched for it. The first row of an id stays: later ones, in this batch or another, are not taken
(of one batch's, the least text). Rows without an id are not taken. Null texts have no lines. Checkpoint and output go
together: a folder that is ahead of its checkpoint is an error.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import joins, ragged
from spanloom.streaming import log

LOG = logging.getLogger("shared_lines")
CONFIG = Path(__file__).with_suffix(".json")
STORE = "doc_id bigint, lang string, source string, cells array<struct<a: bigint, b: bigint>>"
CELLS = "a bigint, b bigint, docs bigint, first_doc bigint"
TRACKS = "doc_id bigint, lang string, source string, n_lines bigint, n_shared bigint, run_start bigint, run_length bigint"


def configured(path: str | Path = CONFIG) -> dict:
    """least_words: of a line that counts; files_per_batch: of the stream; buckets: of the tracks' folders."""
    return json.loads(Path(path).read_text())


def cells_of(text: Column, least_words: int) -> Column:
    """The text's lines as cells, in order."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = F.transform(F.split(lower, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[\x20\x09\x0B-\x0D]+", " ")))
    kept = F.filter(lines, lambda s: (s != "") & (F.size(F.split(s, " ")) >= least_words))
    return F.transform(kept, lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(11), s).alias("b")))


def _points(store: DataFrame) -> DataFrame:
    return store.select("doc_id", F.posexplode("cells").alias("pos", "cell")).select("doc_id", "pos", "cell.a", "cell.b")


def _tracks(store: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of TRACKS for the documents of ``store``; ``counts`` (a, b, docs) has all cells so far."""
    shared = counts.where("docs > 1").select("a", "b", F.lit(True).alias("shared"))
    points = _points(store).join(shared, ["a", "b"], "left").select("doc_id", "pos", F.coalesce("shared", F.lit(False)).alias("shared"))
    n = points.groupBy("doc_id").agg(F.count(F.when(F.col("shared"), 1)).alias("n_shared"))
    run = ragged.longest_run(points, "doc_id", "pos", F.col("shared"), least=1)
    run = run.select("doc_id", F.col("start").cast("long").alias("run_start"), F.col("length").alias("run_length"))
    out = store.join(n, "doc_id", "left").join(run, "doc_id", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "lang", "source", F.size("cells").cast("long").alias("n_lines"), F.coalesce("n_shared", none).alias("n_shared"), "run_start", F.coalesce("run_length", none).alias("run_length"))


class Batches:
    """What a micro-batch does; ``wrote`` has the rows of each batch of this run, by table."""

    def __init__(self, out: str, config: dict):
        self.out, self.config, self.wrote = out.rstrip("/"), config, []

    def _read(self, spark: SparkSession, name: str, schema: str, before: int) -> DataFrame:
        """The rows of earlier batches."""
        if not before:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.out}/{name}").parquet(f"{self.out}/{name}")
        return rows.where(F.col("batch") < before).drop("batch")

    def _write(self, rows: DataFrame, name: str, schema: str, number: int, *by: str) -> DataFrame:
        path = f"{self.out}/{name}/batch={number}"
        rows.write.mode("overwrite").partitionBy(*by).parquet(path)
        return rows.sparkSession.read.schema(schema).parquet(path)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = self._read(spark, "store", STORE, number)
        new = batch.select("doc_id", "lang", "source", "text").where("doc_id is not null")
        new = log.remaining(joins.first_per_key(new, "doc_id", ["text", "lang", "source"]), earlier.select("doc_id"), "doc_id")
        store = self._write(new.select("doc_id", "lang", "source", cells_of(F.col("text"), self.config["least_words"]).alias("cells")), "store", STORE, number)
        crossed = _points(store).select("doc_id", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
        cells = self._write(crossed, "cells", CELLS, number)
        total = lambda c: c.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc"))
        known = total(self._read(spark, "cells", CELLS, number))
        # A cell that one earlier document crossed, and now another: that one document changes.
        changed = known.where("docs = 1").join(cells.select("a", "b"), ["a", "b"], "left_semi").select(F.col("first_doc").alias("doc_id")).distinct()
        touched = store.unionByName(earlier.join(changed, "doc_id", "left_semi"))
        counts = total(self._read(spark, "cells", CELLS, number).unionByName(cells))
        rows = _tracks(touched, counts).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.config["buckets"])).cast("int"))
        tracks = self._write(rows, "tracks", f"{TRACKS}, bucket int", number, "bucket")
        done = {"batch": number, "documents": store.count(), "cells": cells.count(), "tracks": tracks.count()}
        LOG.info("batch %(batch)d: %(documents)d new documents, %(cells)d cells, %(tracks)d rows of tracks written", done)
        self.wrote.append(done)


def _ahead(spark: SparkSession, out: str, checkpoint: str) -> bool:
    """Whether there is output, but no checkpoint that knows of it."""
    there = lambda p: (path := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return there(f"{out}/store/batch=0/_SUCCESS") and not there(f"{checkpoint}/offsets/0")


def _streamed(spark: SparkSession, path: str) -> str:
    """The path for a file stream, which takes a folder or a pattern: a file goes as a pattern that only it matches."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return f"{path[:-1]}[{path[-1]}]" if file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).isFile() else path


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> list[dict]:
    """Takes the documents that are new since the last run; the rows that each batch wrote."""
    config = config or configured()
    if _ahead(spark, out, checkpoint):
        raise ValueError(f"{out} has results that {checkpoint} knows nothing of: give both of a run, or two new folders")
    LOG.info("reading %s after the mark in %s", documents, checkpoint)
    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_streamed(spark, documents))
    batches = Batches(out, config)
    query = stream.select("doc_id", "lang", "source", "text").writeStream.foreachBatch(batches).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%d batches written to %s", len(batches.wrote), out)
    return batches.wrote


def current(spark: SparkSession, out: str) -> DataFrame:
    """The latest row of each document."""
    rows = spark.read.schema(f"{TRACKS}, batch int, bucket int").option("basePath", f"{out}/tracks").parquet(f"{out}/tracks")
    rest = [c.split()[0] for c in TRACKS.split(", ")[1:]]
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("doc_id", "r.*")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("shared_lines").getOrCreate()
    try:
        run(spark, args.documents, args.out, args.checkpoint, configured(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
