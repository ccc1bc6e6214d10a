"""Call events as Structured Streaming: health, arms, alerts, rollout control.

Inputs are streams of ``event_id, ts, op, ok, latency[, arm, experiment]`` with
``ts`` a TIMESTAMP. The watermark of ten minutes bounds late data and state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewright.operators import health as H
from tidewright.operators.experiments import ERROR_LIMIT, LATENCY_LIMIT
from tidewright.session import shared_folder

LATE = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once: repeats inside the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def health_windows(events: DataFrame, width: str = "1 minute", late: str = LATE) -> DataFrame:
    """Health per op and tumbling window; percentiles are exact in the window."""
    rows = events if events.isStreaming is False else events.withWatermark("ts", late)
    agg = rows.groupBy(F.window("ts", width).alias("w"), "op").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("errors"),
        F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_error"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY latency)").alias("p99"),
    )
    found = H.issues(F.col("total"), F.col("errors"), F.col("p99"), F.col("last_error"), F.col("w.end"))
    return agg.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "op", "total", "errors", "p99",
        H.status(found).alias("status"),
    )


def arm_windows(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = LATE) -> DataFrame:
    """Sliding evaluation window per experiment with the rollback test."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    v, c = F.col("arm") == "variant", F.col("arm") == "control"
    agg = rows.groupBy(F.window("ts", width, slide).alias("w"), "experiment").agg(
        F.count_if(v).alias("variant_requests"), F.count_if(v & ~F.col("ok")).alias("variant_errors"),
        F.avg(F.when(v, F.col("latency"))).alias("variant_latency"), F.avg(F.when(c, F.col("latency"))).alias("control_latency"),
    )
    rate = F.coalesce(F.try_divide("variant_errors", "variant_requests"), F.lit(0.0))
    ratio = F.try_divide("variant_latency", "control_latency")
    bad = (rate > ERROR_LIMIT) | F.coalesce(ratio > LATENCY_LIMIT, F.lit(False))
    return agg.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "experiment",
        "variant_requests", "variant_errors", bad.alias("roll_back"),
    )


class LastSamples(StatefulProcessor):
    """Keeps the last ``size`` latencies per op and emits their running summary."""

    def __init__(self, size: int = 1000):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("samples", "latencies array<bigint>, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, seen = self.state.get() if self.state.exists() else ([], 0)
        newest, fresh = None, 0
        for chunk in rows:  # one Arrow chunk at a time; only the tail is kept
            fresh += len(chunk)
            both = chunk if newest is None else pd.concat([newest, chunk])
            newest = both.sort_values(["ts", "event_id"]).tail(self.size)
        held = (list(held) + newest["latency"].tolist())[-self.size:]
        self.state.update((held, seen + fresh))
        yield pd.DataFrame({"op": [key[0]], "seen": [seen + fresh], "kept": [len(held)], "total": [int(sum(held))]})

    def close(self) -> None:
        pass


def last_samples(events: DataFrame, size: int = 1000) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy("op").transformWithStateInPandas(
        LastSamples(size), outputStructType="op string, seen bigint, kept bigint, total bigint", outputMode="Update", timeMode="None"
    )


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[np.datetime64, bool]]:
    """(ts, failed) of all calls by (ts, event_id), nulls last. Of a call no more than these three values is held, 17 bytes."""
    held = [(pd.to_datetime(c["ts"]).to_numpy(), c["event_id"].to_numpy(), np.array([not ok for ok in c["ok"]], bool)) for c in rows]
    ts, ids, failed = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    if ids.dtype == object:
        ids = pd.factorize(ids, sort=True)[0].astype(np.uint64)  # a null is -1 and becomes the largest
    order = np.lexsort((ids, ts))
    del ids
    for start in range(0, len(order), 1 << 16):
        part = order[start:start + (1 << 16)]
        yield from zip(ts[part], failed[part].tolist(), strict=True)


class RolloutController(StatefulProcessor):
    """Stage machine per op: graduate on good calls, roll back on bad ones, then
    wait out a cooldown on an event-time timer. Emits rollout-log rows."""

    def __init__(self, stages: tuple[float, ...] = (1.0, 5.0, 25.0, 50.0, 100.0), sample: int = 100, limit: float = ERROR_LIMIT, cooldown_ms: int = 1800000):
        self.stages, self.sample, self.limit, self.cooldown_ms = stages, sample, limit, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stage", "stage int, calls bigint, errors bigint, cooling boolean")

    def _row(self, op, at, action, pct):
        return {"op": op, "ts": pd.Timestamp(at), "action": action, "percentage": float(pct)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage, calls, errors, cooling = self.state.get() if self.state.exists() else (0, 0, 0, False)
        out = []
        for at, bad in () if cooling else in_order(rows):
            calls, errors = calls + 1, errors + bad
            if calls < self.sample:
                continue
            if errors / calls > self.limit:
                out.append(self._row(key[0], at, "rollback", 0.0))
                stage, calls, errors, cooling = 0, 0, 0, True
                self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + self.cooldown_ms)
                break
            if stage + 1 < len(self.stages):
                stage, calls, errors = stage + 1, 0, 0
                out.append(self._row(key[0], at, "increase", self.stages[stage]))
        self.state.update((stage, calls, errors, cooling))
        yield pd.DataFrame(out, columns=["op", "ts", "action", "percentage"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.update((0, 0, 0, False))
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([self._row(key[0], at, "start", self.stages[0])])

    def close(self) -> None:
        pass


def rollout_controller(events: DataFrame, late: str = LATE, **options) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.withWatermark("ts", late).select("op", "ts", "event_id", "ok").groupBy("op").transformWithStateInPandas(
        RolloutController(**options), outputStructType="op string, ts timestamp, action string, percentage double",
        outputMode="Append", timeMode="EventTime",
    )


def alert_stream(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Threshold alerts per finished batch; ``sink(alerts, batch_id)`` must be idempotent."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(H.alerts(df), n))


def incremental_corpus(current: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed or new files, unchanged rows of the manifest) by path and hash."""
    hashed = current.withColumn("sha", F.sha2("content", 256))
    changed = hashed.join(manifest.select("path", "sha"), ["path", "sha"], "left_anti")
    kept = manifest.join(hashed.select("path", "sha"), ["path", "sha"], "left_semi")
    return changed, kept


MANIFEST = "path string, sha string, status string"


def manifest_versions(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a manifest table (path, sha, status, version); a deleted path's row has no sha."""
    return spark.read.schema(f"{MANIFEST}, version int").parquet(folder)


def start_manifest(spark: SparkSession, folder: str) -> None:
    """An empty manifest, unless there is one."""
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{folder}/version=-1")


def manifest_as_of(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(path, sha, version) of the files that the corpus held after ``version``, or holds now."""
    rows = manifest_versions(spark, folder)
    rows = rows if version is None else rows.filter(F.col("version") <= version)
    last = rows.groupBy("path").agg(F.max_by("sha", "version").alias("sha"), F.max("version").alias("version"))
    return last.filter("sha IS NOT NULL")


def merge_into_manifest(files: DataFrame, version: int, folder: str) -> None:
    """Writes one version of the manifest: the paths of ``files`` (path, content, seq) that are added, changed or deleted.

    A null content is a tombstone. Of several rows of a path the one of the largest ``seq`` counts. The version is compared with what
    the versions before it hold and replaces what an earlier attempt at it has written, so a batch may be run again at any time.
    """
    spark = files.sparkSession
    now = files.withColumn("sha", F.sha2("content", 256)).groupBy("path").agg(F.max_by("sha", "seq").alias("sha"))
    old = manifest_as_of(spark, folder, version - 1).select("path", F.col("sha").alias("old"))
    status = F.when(F.col("old").isNull() & F.col("sha").isNotNull(), "added").when(F.col("sha").isNull() & F.col("old").isNotNull(), "deleted").when(F.col("sha") != F.col("old"), "changed")
    found = now.join(old, "path", "left").withColumn("status", status).filter("status IS NOT NULL")
    found.select("path", "sha", "status").write.mode("overwrite").parquet(f"{folder}/version={version}")


def corpus_stream(files: DataFrame, folder: str, checkpoint: str):
    """A stream of files and tombstones (path, content, seq) merged into the manifest in ``folder``, one version per batch."""
    start_manifest(files.sparkSession, folder)
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: merge_into_manifest(df, n, folder))


LEDGER = "op string, ts timestamp"


def handle_rollbacks(decisions: DataFrame, batch: int, handler: Callable[[DataFrame, int], None], ledger: str) -> None:
    """Calls ``handler`` for the operations of a batch of rollout-log rows (op, ts, action) that roll back and have not been handled in this batch.

    The handler gets (op, ts) with the first time of each. What it has handled is entered in the ledger, by batch; when it fails, or the
    job stops before the entry, the batch is run again and only operations without an entry are handed over.
    """
    spark = decisions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{ledger}/batch=-1")
    asked = decisions.filter("action = 'rollback'").groupBy("op").agg(F.min("ts").alias("ts"))
    done = spark.read.schema(f"{LEDGER}, batch int").parquet(ledger).filter(F.col("batch") == batch)
    todo = asked.join(done.select("op"), "op", "left_anti").persist()
    if not todo.isEmpty():
        handler(todo, batch)
        todo.select("op", "ts").write.mode("append").parquet(f"{ledger}/batch={batch}")
    todo.unpersist()


def rollback_stream(decisions: DataFrame, handler: Callable[[DataFrame, int], None], ledger: str, checkpoint: str):
    """A stream of rollout-log rows whose rollbacks are handed to ``handler`` once per batch and operation."""
    return decisions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: handle_rollbacks(df, n, handler, ledger))


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all data its source has now and reads back its table."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:  # update-mode batches are appended with their batch id
        writer = stream.writeStream.outputMode(mode).foreachBatch(
            lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
        )
    writer.option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
