"""Running sums by key over rows in a global order: no key has to fit into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlode.llm.common import Scratch, free_name


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row's values differ from those of the row before; the first row counts as such."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def within(values: np.ndarray, begins: np.ndarray, xor: bool) -> np.ndarray:
    """Running sums (or exclusive ors) that begin anew where ``begins`` is set."""
    total = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    at = np.flatnonzero(begins)
    before = np.where(at > 0, total[at - 1], 0)[np.cumsum(begins) - 1]
    return total ^ before if xor else total - before


def _running(key: list[int], values: list[tuple[int, bool]], names: list[str]):
    """Adds to each row the running values within its partition, the partition and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, carried = TaskContext.get().partitionId(), 0, None, [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in key]
            begins = changes(keys)
            same = last is not None and all(k[0] == x for k, x in zip(keys, last, strict=True))
            first = int(np.flatnonzero(begins)[1]) if begins.sum() > 1 else n
            made = []
            for v, (i, xor) in enumerate(values):
                got = within(batch.column(i).to_numpy(zero_copy_only=False), begins, xor)
                if same:
                    got[:first] = got[:first] ^ carried[v] if xor else got[:first] + carried[v]
                carried[v] = int(got[-1])
                made.append(pa.array(got, pa.int64()))
            last = [k[-1] for k in keys]
            made += [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(place, place + n), pa.int64())]
            place += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return run


def running(df: DataFrame, key: list[str], order: list[str | Column], sums: dict[str, str], xors: dict[str, str], scratch: Scratch) -> DataFrame:
    """``df`` with the running sums and exclusive ors of long columns (new name -> column), in ``order`` within a key of longs.

    Rows are range-partitioned by key and order, each partition adds up what it has, and what a key had in the
    partitions before is added from a table of one row a partition, which the driver gets. Key columns without nulls.
    """
    own = free_name(df)
    part, place = f"{own}_part", f"{own}_place"
    values = {**sums, **xors}
    kind = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in values), T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType())])
    at = [(df.columns.index(c), name in xors) for name, c in values.items()]
    by = [*key, *order]
    dealt = df.repartitionByRange(parts_of(df), *by).sortWithinPartitions(*by)
    found = scratch.keep(dealt.mapInArrow(_running([df.columns.index(k) for k in key], at, kind.names), kind), "running")
    ends = found.groupBy(part).agg(F.min_by(F.struct(*key), place).alias("first"), F.max_by(F.struct(*key), place).alias("last"), F.max_by(F.struct(*values), place).alias("total")).orderBy(part).collect()
    carries, before = [], None
    for row in ends:
        carry = before[1] if before and before[0] == row["first"] else [0] * len(values)
        carries.append((row[part], *row["first"], *carry))
        whole = row["first"] == row["last"]
        total = [(t ^ c if name in xors else t + c) if whole else t for t, c, name in zip(row["total"], carry, values, strict=True)]
        before = (row["last"], total)
    names = [part, *(f"{own}_key{i}" for i in range(len(key))), *(f"{own}_more{i}" for i in range(len(values)))]
    table = df.sparkSession.createDataFrame(carries, ", ".join(f"{n} {'int' if n == part else 'long'}" for n in names))
    both = found.join(F.broadcast(table), part)  # a row a partition
    same = F.lit(True)
    for i, k in enumerate(key):
        same &= F.col(k) == F.col(names[1 + i])
    for i, name in enumerate(values):
        more = F.when(same, F.col(f"{own}_more{i}")).otherwise(0)
        both = both.withColumn(name, F.col(name).bitwiseXOR(more) if name in xors else F.col(name) + more)
    return both.select(*df.columns, *values)
