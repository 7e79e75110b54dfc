"""Shared plumbing of the training-data operators: table access, scratch tables, fixed word rules, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the five ASCII controls 9 to 13. Fixed by the query contracts.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that a numpy kernel takes at once; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 18
#: Rows and bytes of a batch that a task hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by a path that only Spark needs to be able to reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where that is unset, a folder of this machine does if all of Spark runs on it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def small_reads(spark: SparkSession) -> None:
    """Lets Parquet readers take a column in parts of 1 MB, where nobody has said otherwise: as a whole it is held outside of the JVM's heap, by each task."""
    for name, value in (("parquet.read.allocation.size", str(1 << 20)), ("parquet.hadoop.vectored.io.enabled", "false")):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


class Scratch:
    """Intermediate tables written as Parquet to the shared folder, so that a lost executor costs no recomputation.

    A table lives until ``drop``; what the caller's result still reads is left for the folder's owner to clear.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_reads(spark)
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Drops all of its tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed_row(docs: DataFrame, *but: str) -> Column:
    """All columns but some as one, __row, that no operator's own names can clash with."""
    return F.struct(F.lit(True).alias("__packed"), *[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("__row")


def unpacked_row(df: DataFrame, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """The columns of __row, in their order, and what was ``made`` of some."""
    return df.select(*[made[c].alias(c) if c in made else F.col(f"__row.`{c}`").alias(c) for c in columns])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that a row belongs to. A null id is fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(n)), F.lit(0))


def in_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded size: rows of text are large, and a batch is held by the JVM and by Python at once.

    Sets the session's limits of a batch, where nobody else has.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, kernel: Callable[[pa.Table], Iterator[pa.Table]], schema: str, text: str = "text", chunk: int = CHUNK_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with batches cut so that each has about ``chunk`` bytes in the column ``text``; kernel: table -> tables.

    ``after`` is called when a task ends, to let go of what the worker holds.
    """

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for lo, hi in cuts(lengths(t.column(text)), chunk):
                for out in kernel(t.slice(lo, hi - lo)):
                    yield from out.to_batches()
        if after is not None:
            after()
        give_back()

    return in_batches(df, run, schema)


def give_back() -> None:
    """Returns freed memory to the system: a worker process stays on after its task, beside the tasks of other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lengths(col: pa.ChunkedArray) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy().astype(np.int64)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a larger row is a range of its own."""
    if len(sizes) == 0:
        return
    part = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True)


def text_bytes(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes as one uint8 array, and offsets (rows + 1); null is empty."""
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.array([], pa.string()) if col.num_chunks == 0 else col.chunk(0)
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind, width = np.int32, 4
    else:
        kind, width = np.int64, 8
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind, len(col) + 1, col.offset * width).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]
