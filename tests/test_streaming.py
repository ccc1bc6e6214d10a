import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id int, ts timestamp, op string, ok boolean, latency bigint"


@pytest.fixture()
def stream(spark, tmp_path):
    """Three files replayed one per trigger; one event is late, one repeated."""
    src = tmp_path / "src"
    for part in range(3):
        rows = [(part * 100 + i, T0 + dt.timedelta(minutes=part * 60 + i), "op", i % 10 > 0, i) for i in range(60)]
        if part == 1:
            rows += [(0, T0, "op", True, 0)]
        if part == 2:
            rows += [(999, T0, "op", True, 1)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src)), spark.read.parquet(str(src))


def test_windows_equal_the_batch_after_the_watermark(spark, stream):
    live, batch = stream
    out = {(r["window_start"], r["total"], r["errors"]) for r in J.run_to_table(J.health_windows(live, "10 minutes"), "t").collect()}
    clean = batch.filter("event_id <> 999")
    want = {(r["window_start"], r["total"], r["errors"]) for r in J.health_windows(clean, "10 minutes").collect()}
    closed = {w for w in want if w[0] + dt.timedelta(minutes=20) <= T0 + dt.timedelta(minutes=179)}
    assert closed <= out <= want
    assert sum(w[1] for w in out) <= clean.count()


def test_repeated_events_are_dropped_once(spark, stream):
    live, batch = stream
    twice = live.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = J.run_to_table(J.deduplicated(twice, "1 day").select("event_id"), "d")
    assert out.count() == batch.select("event_id").distinct().count()


def test_last_samples_keep_a_bounded_tail(spark, stream):
    live, _ = stream
    out = J.run_to_table(J.last_samples(live, size=50), "s", mode="update")
    last = out.orderBy(F.desc("batch")).first()
    assert last["kept"] == 50 and last["seen"] == 182


def test_rollout_controller_grows_then_rolls_back(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, T0 + dt.timedelta(seconds=i), "op", i < 40, 1) for i in range(80)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    live = spark.readStream.schema(SCHEMA).parquet(src)
    out = J.run_to_table(J.rollout_controller(live, sample=10, limit=0.5), "r").orderBy("ts").collect()
    actions = [r["action"] for r in out]
    assert actions[0] == "increase" and "rollback" in actions


class Held:
    """State of one operation outside Spark."""

    value, timers = None, ()
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    getValueState = lambda self, name, schema: self

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers += (at,)


def test_rollout_controller_holds_little_of_a_call():
    n, part = 120000, 10000
    rng = np.random.default_rng(1)
    seconds, ok = rng.permutation(n) // 2, rng.random(n) > 0.1

    def chunks():
        for at in range(0, n, part):
            ids = np.arange(at, at + part)
            yield pd.DataFrame({"op": [f"op{i % 1}" for i in ids], "ts": pd.Timestamp(T0.replace(tzinfo=None)) + pd.to_timedelta(seconds[ids], unit="s"), "event_id": ids, "ok": ok[ids],
                                **{c: [f"{c} of call {i}" for i in ids] for c in ("user_id", "latency", "k")}})

    def run(controller, held, rows):
        controller.init(held)
        return pd.concat(controller.handleInputRows(("op0",), rows, None))

    held = Held()
    tracemalloc.start()
    out = run(J.RolloutController(sample=50, limit=0.9), held, chunks())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(out["action"]) == ["increase"] * 4 and held.value == (4, n - 200, int((~ok[np.lexsort((np.arange(n), seconds))][200:]).sum()), False)
    assert peak < 100 * n

    # ids that are null or text, times that are null, calls without a result: nulls last, no result is a failure
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01", None, "2024-01-01", "2024-01-01"]), "event_id": ["b", "z", None, "a"], "ok": [True, True, None, False]})
    assert [bad for _, bad in J.in_order(iter([rows]))] == [True, False, True, False]
    # a call that rolls back ends the batch; while it cools down nothing is read
    held, controller = Held(), J.RolloutController(sample=2, limit=0.4)
    assert list(run(controller, held, iter([rows]))["action"]) == ["rollback"] and held.value == (0, 0, 0, True) and len(held.timers) == 1
    assert run(controller, held, iter([rows])).empty and len(held.timers) == 1


def test_incremental_corpus(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("gone", "3")], "path string, content string")
    manifest = old.select("path", F.sha2("content", 256).alias("sha"))
    now = spark.createDataFrame([("a", "1"), ("b", "2!"), ("c", "4")], "path string, content string")
    changed, kept = J.incremental_corpus(now, manifest)
    assert sorted(r["path"] for r in changed.collect()) == ["b", "c"]
    assert [r["path"] for r in kept.collect()] == ["a"]


def test_manifest_versions_survive_a_second_run(spark, tmp_path):
    folder = str(tmp_path / "manifest")
    rounds = [[("a", "1", 0), ("b", "2", 0), ("c", "3", 0), ("n", None, 0)], [("a", "1", 1), ("b", "2!", 1), ("c", None, 1), ("d", "4", 1), ("d", "5", 2)], [("c", "3", 3), ("d", None, 3)]]
    J.start_manifest(spark, folder)
    frames = [spark.createDataFrame(r, "path string, content string, seq int") for r in rounds]
    for n, df in enumerate(frames):
        J.merge_into_manifest(df, n, folder)
    want = [("a", "added", 0), ("b", "added", 0), ("c", "added", 0), ("b", "changed", 1), ("c", "deleted", 1), ("d", "added", 1), ("c", "added", 2), ("d", "deleted", 2)]
    read = lambda: sorted((r["path"], r["status"], r["version"]) for r in J.manifest_versions(spark, folder).collect())
    assert read() == sorted(want)
    for n in (1, 2):  # a batch that was stopped is run again
        J.merge_into_manifest(frames[n], n, folder)
    assert read() == sorted(want)
    assert sorted(r["path"] for r in J.manifest_as_of(spark, folder).collect()) == ["a", "b", "c"]
    assert sorted(r["path"] for r in J.manifest_as_of(spark, folder, 0).collect()) == ["a", "b", "c"]
    assert sorted(r["path"] for r in J.manifest_as_of(spark, folder, 1).collect()) == ["a", "b", "d"]


def test_a_failed_handler_is_called_again_for_its_batch_only(spark, tmp_path):
    src, calls, broken = str(tmp_path / "src"), [], [True]
    schema = "op string, ts timestamp, action string"

    def handler(df, n):
        if n == 1 and broken[0]:
            broken[0] = False
            raise RuntimeError("handler failed")
        calls.append((n, sorted(r["op"] for r in df.collect())))

    def run():
        live = spark.readStream.schema(schema).parquet(src)
        J.rollback_stream(live, handler, str(tmp_path / "ledger"), str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()

    for n, ops in enumerate((["x", "y", "x"], ["x", "z"], ["w"])):
        spark.createDataFrame([(o, T0 + dt.timedelta(hours=n), "rollback") for o in ops] + [("q", T0, "increase")], schema).coalesce(1).write.mode("append").parquet(src)
        if n == 1:
            with pytest.raises(Exception, match="handler failed"):
                run()
        run()
    assert calls == [(0, ["x", "y"]), (1, ["x", "z"]), (2, ["w"])]
    again = spark.createDataFrame([("x", T0, "rollback"), ("v", T0, "rollback")], schema)
    J.handle_rollbacks(again, 1, handler, str(tmp_path / "ledger"))  # the entry of a batch keeps its operations from a second call
    assert calls[-1] == (1, ["v"])
