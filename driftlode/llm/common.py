"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process (tests) a temporary folder is made
    and set; on a cluster an unset folder is an error, as nothing else is known to be shared.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="driftlode-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: what follows survives lost executors without repeating the work before,
    and sees one fixed set of rows.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_files(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Materialized tables of one operator, to be deleted together when its result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialize(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete ``tables``, or all that are left."""
        for df in tables or self.tables:
            drop_files(df)
        gone = {id(df) for df in tables or self.tables}
        self.tables = [df for df in self.tables if id(df) not in gone]


def free_name(*frames: DataFrame) -> str:
    """A column name that no column of ``frames`` has or begins with."""
    taken = [c.lower() for df in frames for c in df.columns]
    k = 0
    while any(c.startswith(f"_own{k}") for c in taken):
        k += 1
    return f"_own{k}"


ROWS_CONF, BYTES_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 1 << 24) -> None:
    """From now on Arrow batches of this session have ``rows`` rows and ``size`` bytes at most, or fewer if it says so already.

    Of long texts or packed arrays, Spark's own limits let a batch take hundreds of MB in JVM and worker.
    """
    for name, most in ((ROWS_CONF, rows), (BYTES_CONF, size)):
        now = spark.conf.get(name).removesuffix("b")  # bytes are told with a b behind
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, few at a time, so that what is made of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


MOST_BITS = 26


def bit_filter(df: DataFrame, column: str, count: int | None = None) -> np.ndarray:
    """A bitmap of the lowest bits of a column of longs, 16 bits for each of its ``count`` values, 8 MB at most.

    It tells before a shuffle which rows can't be among those of ``df``; those it lets through still
    have to be joined. With very many values it lets more through, not less.
    """
    count = df.count() if count is None else count
    bits = min(max(math.ceil(math.log2(16 * count + 1)), 16), MOST_BITS)
    words = df.selectExpr(f"(`{column}` & {2**bits - 1}) >> 6 as w", f"shiftleft(1L, cast(`{column}` & 63 as int)) as m").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(2 ** (bits - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
    return out


def bits_set(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the int64 ``values`` the bitmap lets through."""
    at = values.view(np.uint64) & np.uint64(len(filter_) * 64 - 1)
    return (filter_[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


HOT_SHARE = 1024


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each of ``keys`` once and in ``count_col`` how many rows have it.

    Keys that more than a 1,024th of all ``total`` rows have are fewer than 1,024; these are broadcast,
    so that their rows stay where they are. No other key has more rows than that.
    """
    most = max(total // HOT_SHARE, 64)
    hot, cold = table.where(F.col(count_col) > most), table.where(F.col(count_col) <= most)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


@contextmanager
def batches_of(spark: SparkSession, rows: int = 1024, size: int = 1 << 24) -> Iterator[None]:
    """Small Arrow batches for what is run inside; the session's own limits hold again afterwards."""
    before = {name: spark.conf.get(name) for name in (ROWS_CONF, BYTES_CONF)}
    small_batches(spark, rows, size)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
