"""Additive: vessel fixes scored as they arrive. The batch ranking stays the reference."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlode.operators.correlate import SIGMA_KM, packed, proximity


def score_stream(fixes: DataFrame, grid: DataFrame, late: str = "1 hour", window: str = "1 hour", sigma: float = SIGMA_KM) -> DataFrame:
    """By vessel and window, how many fixes came and the best proximity to the posterior.

    ``fixes``: a stream of ship_id, ts, lat, lon. Rows later than ``late`` behind the newest are dropped.
    """
    rows = fixes.withWatermark("ts", late).crossJoin(F.broadcast(packed(grid)))
    near = proximity(F.col("lat"), F.col("lon"), F.col("cells"), sigma)
    scored = rows.groupBy("ship_id", F.window("ts", window)).agg(F.count("*").alias("fixes"), F.max(near).alias("proximity"))
    return scored.select("ship_id", F.col("window.start").alias("start"), "fixes", "proximity")


def stage_events(run: DataFrame, path: str, checkpoint: str, late: str = "1 hour"):
    """Write a stream of stage events (run_id, stage, at in seconds) to a table, each once; one attempt for each, in order.

    An event that is sent again within ``late`` is dropped by the state of the query. A batch has a folder of its own, named by the query,
    which the checkpoint fixes, and the batch: one that is run again after a crash writes the same folder again. Readers find
    both as the columns query and batch.
    """
    once = run.withColumn("_at", F.timestamp_seconds("at")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["run_id", "stage"]).drop("_at")

    def put(df: DataFrame, batch: int) -> None:
        query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        df.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch}")

    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


STAGES = ("started", "detection_done", "backtrack_done", "ais_done", "forward_done", "pipeline_done")


def run_stages(stages, log, limit_s: float | None = None, clock=time.monotonic, spark: SparkSession | None = None) -> str:
    """Run (name, action) in order and log each; the first failure ends the run, as do ``limit_s`` seconds. Returns the last name.

    With a session a stage that runs over the limit is stopped: its Spark jobs are cancelled, and the run ends without waiting for it.
    Without one the limit is looked at when a stage ends.
    """
    log("started")
    began = clock()
    for name, action in stages:
        try:
            if spark is None or limit_s is None:
                action()
            else:
                _stopped_after(action, limit_s - (clock() - began), spark)
            if limit_s is not None and clock() - began > limit_s:
                raise TimeoutError
        except TimeoutError:
            log(f"error: {name}: over {limit_s} s")
            return "error"
        except Exception as e:
            log(f"error: {name}: {e}")
            return "error"
        log(name)
    log("pipeline_done")
    return "pipeline_done"


def _stopped_after(action, seconds: float, spark: SparkSession) -> None:
    """Run ``action`` in a thread of its own; after so many seconds its jobs are cancelled and TimeoutError is raised."""
    group, failed, context = f"stage-{uuid.uuid4().hex}", [], spark.sparkContext

    def run() -> None:
        context.setJobGroup(group, "a stage with a time limit", interruptOnCancel=True)
        try:
            action()
        except Exception as e:  # told to the caller
            failed.append(e)

    thread = InheritableThread(target=run)
    thread.daemon = True
    thread.start()
    thread.join(max(seconds, 0))
    if thread.is_alive():
        context.cancelJobGroup(group)
        raise TimeoutError
    if failed:
        raise failed[0]


class Cache(StatefulProcessor):
    """Answers to requests by key: what was loaded less than ``ttl_s`` seconds ago, else loaded anew; if that fails, what was loaded last.

    The fresh answer is a state that expires by itself, the last one a state that stays; both outlive a restart from the checkpoint.
    """

    def __init__(self, load, ttl_s: float) -> None:
        self.load, self.ttl_ms = load, int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fresh = handle.getValueState("fresh", "payload string", self.ttl_ms)
        self.last = handle.getValueState("last", "payload string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        asked = [row for row in rows]
        if self.fresh.exists():
            payload, source = self.fresh.get()[0], "state"
        else:
            try:
                payload, source = self.load(key[0]), "loaded"
                self.fresh.update((payload,))
                self.last.update((payload,))
            except Exception:
                if not self.last.exists():
                    raise
                payload, source = self.last.get()[0], "stale"
        for row in asked:
            yield Row(key=key[0], request=row["request"], payload=payload, source=source)

    def close(self) -> None:
        pass


def answered(requests: DataFrame, load, ttl_s: float = 1800.0) -> DataFrame:
    """A stream of requests (key, request) with payload and source (loaded, state or stale); ``load`` maps a key to a payload, in the tasks.

    A key is loaded at most once for all its requests within ``ttl_s``. Needs the RocksDB state store. As states expire by the clock,
    Spark goes on with batches without data; with the trigger availableNow turn spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    return requests.groupBy("key").transformWithState(statefulProcessor=Cache(load, ttl_s), outputStructType="key string, request string, payload string, source string", outputMode="update", timeMode="ProcessingTime")
