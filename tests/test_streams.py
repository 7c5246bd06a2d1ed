"""Streams with state, an event log without repeats, stages that are stopped, tables that are replaced as a whole; hulls in parts."""

import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftlode.functions import geo, polygon
from driftlode.operators import hull
from driftlode.sources import catalog
from driftlode.streaming import incremental

EVENTS = "run_id string, stage string, at double"


@pytest.fixture
def rocks(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for values in (wanted, before):
        for name, value in values.items():
            spark.conf.set(name, value)
        if values is wanted:
            yield spark


def once(query):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination()


def test_answers_expire_and_outlive_a_restart(rocks, tmp_path):
    calls, into = tmp_path / "calls", str(tmp_path / "in")
    calls.mkdir()

    def load(key):
        n = len(os.listdir(calls))
        if n >= 2:
            raise OSError("the source is down")
        (calls / f"{key}-{n}").touch()
        return f"{key}{n}"

    def ask(*requests):
        rocks.createDataFrame([(k, r) for k, r in requests], "key string, request string").write.mode("append").parquet(into)
        got = []
        stream = incremental.answered(rocks.readStream.schema("key string, request string").parquet(into), load, 20.0)
        once(stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))))
        return sorted(got)

    began = time.time()
    assert ask(("a", "1"), ("a", "2")) == [("a", "1", "a0", "loaded"), ("a", "2", "a0", "loaded")]
    assert ask(("a", "3")) == [("a", "3", "a0", "state")]  # a new start from the checkpoint
    time.sleep(max(0, began + 40 - time.time()))
    assert ask(("a", "4")) == [("a", "4", "a1", "loaded")]
    time.sleep(25)
    assert ask(("a", "5")) == [("a", "5", "a1", "stale")]


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    into, log, mark = (str(tmp_path / n) for n in ("in", "log", "mark"))
    rows = [("r1", "started", 1.0), ("r1", "detection_done", 2.0)]
    spark.createDataFrame([*rows, rows[0]], EVENTS).coalesce(1).write.parquet(into)
    stream = spark.readStream.schema(EVENTS).parquet(into)
    once(incremental.stage_events(stream, log, mark))
    commit = sorted((tmp_path / "mark" / "commits").glob("[0-9]*"))[-1]
    commit.unlink()  # as after a crash before the commit
    (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    once(incremental.stage_events(stream, log, mark))
    spark.createDataFrame([rows[1], ("r1", "backtrack_done", 3.0)], EVENTS).write.mode("append").parquet(into)  # sent again
    once(incremental.stage_events(stream, log, mark))
    got = spark.read.parquet(log).orderBy("at").collect()
    assert [r.stage for r in got] == ["started", "detection_done", "backtrack_done"] and len({r.batch for r in got}) == 2


def test_a_stage_over_the_limit_is_stopped(spark):
    log, began = [], time.time()

    def endless():
        spark.range(8).repartition(8).select(F.udf(lambda x: time.sleep(600))("id").alias("s")).collect()

    assert incremental.run_stages([("a", lambda: spark.range(3).count()), ("b", endless), ("c", lambda: None)], log.append, 12.0, spark=spark) == "error"
    assert log == ["started", "a", "error: b: over 12.0 s"] and time.time() - began < 60
    left = time.time() + 30
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < left:
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    log.clear()
    assert incremental.run_stages([("a", lambda: 1 / 0)], log.append, 60.0, spark=spark) == "error" and log[1] == "error: a: division by zero"


def test_upsert_of_odd_rows(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (2, "b2", 7), (None, "n", 8)], "id int, x string, _a int")
    new = spark.createDataFrame([(2, "z", 1), (4, "w", 2), (None, "m", 3)], "id int, x string, _b int")
    got = sorted(map(tuple, catalog.upsert(old, new, "id").collect()), key=str)
    assert got == sorted([(1, "a", 5, None), (2, "z", 6, 1), (2, "z", 7, 1), (4, "w", None, 2), (None, "n", 8, None), (None, "m", None, 3)], key=str)
    with pytest.raises(Exception, match="comes twice in the new rows: 2"):
        catalog.upsert(old, new.union(new.where("id = 2")), "id").collect()


def test_a_replaced_table_survives_a_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="no way"):
        catalog.replace_table(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no way")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    os.rename(path, f"{path}.old")  # broken off between the two moves
    catalog.replace_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and sorted(os.listdir(tmp_path)) == ["t"]
    catalog.replace_table(spark.read.parquet(path).where("id > 4"), path)
    assert spark.read.parquet(path).count() == 2


def test_hulls_in_parts(spark):
    rng = np.random.default_rng(7)
    points = [(1, *p) for p in rng.normal(0, 1, (3000, 2)).tolist()] + [(2, float(k), 2.0 * k) for k in range(50)] + [(3, 1.0, 1.0), (4, None, 1.0), (5, float("nan"), 1.0)] + [(None, *p) for p in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))] * 4
    df = spark.createDataFrame(points, "g long, x double, y double").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {r.g: r for r in hull.hulls(df, "g").withColumn("a", polygon.area(polygon.of_ring(F.col("ring")))).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = geo.convex_hull(*np.array([p[1:] for p in points if p[0] == 1]).T)
    assert [(p.x, p.y) for p in got[1].ring] == [tuple(p) for p in want.tolist()] and got[1].n == 3000
    assert got[2].ring is None and got[2].n == 50 and got[3].ring is None and got[None].n == 12 and got[None].a == pytest.approx(0.5) and set(got) == {1, 2, 3, None}


def test_partial_hulls_of_very_many_small_groups():
    """No frame and no hull for each small group of a batch: 60,000 groups within seconds, in any order, a null key among them."""
    n = 120_000
    k = pd.array([None if i % 60_000 == 7 else i % 60_000 for i in range(n)], dtype="Int64")
    frame = pd.DataFrame({"k": k, "x": np.arange(n, dtype=float), "y": np.arange(n, dtype=float) ** 2 % 97})
    began = time.time()
    (out,) = hull.partial(iter([frame, frame.iloc[:0]]))
    assert time.time() - began < 10
    assert out["n"].sum() == n and (out.groupby("k", dropna=False)["n"].sum() == 2).all() and sorted(out["x"]) == list(range(n))
