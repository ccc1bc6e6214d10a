"""Health and performance over call events ``event_id, ts, op, ok, latency``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordered import carry_forward, last_n_per_key, rank_rows, sample_percentiles, trend

# Health limits, sample sizes and the default thresholds
# (name, warn ms, error ms, warn MB, error MB).
ERROR_RATE, LATENCY_P99, MIN_SAMPLES, RECENT_ERROR_MS, SAMPLES = 0.01, 2000, 100, 60000, 1000
THRESHOLDS = (
    ("extraction", 1000, 5000, 100, 500),
    ("transformation", 500, 2000, 50, 200),
    ("validation", 100, 500, 20, 100),
    ("application", 200, 1000, 30, 150),
)
MB = 1024 * 1024


def simple_rates(events: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return events.groupBy("op").agg(
        n.alias("total"), (F.count_if("ok") / n).alias("success_rate"), (F.count_if(~F.col("ok")) / n).alias("error_rate"),
        F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"),
    )


def issues(total: Column, errors: Column, p99: Column, last_error: Column, now: Column) -> Column:
    rate = errors / total
    late = (F.unix_millis(now.cast("timestamp")) - F.unix_millis(last_error.cast("timestamp"))) < RECENT_ERROR_MS
    return F.when(total < MIN_SAMPLES, F.array(F.lit("low"))).otherwise(
        F.array_compact(F.array(
            F.when(rate > ERROR_RATE, "critical"), F.when(p99 > LATENCY_P99, "high"), F.when(late, "medium"),
        ))
    )


def status(found: Column) -> Column:
    return (
        F.when(F.array_contains(found, "critical"), "unhealthy").when(F.array_contains(found, "high"), "degraded").otherwise("healthy")
    )


def health(events: DataFrame, now: Column | None = None, ops: Sequence[str] | None = None) -> DataFrame:
    """Status per operation: counts over all calls, percentiles over the last 1000."""
    if ops is not None:
        events = events.filter(F.col("op").isin(*ops))
    totals = events.groupBy("op").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("errors"),
        F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_error"),
    )
    recent = last_n_per_key(events.select("op", "ts", "event_id", "latency"), ["op"], ["ts", "event_id"], SAMPLES)
    ps = sample_percentiles(recent, ["op"], "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "ceil")
    rows = totals.join(ps, "op")
    if now is None:
        rows = rows.join(events.agg(F.max("ts").alias("_now")), how="inner")
        now = F.col("_now")
    found = issues(F.col("total"), F.col("errors"), F.col("p99"), F.col("last_error"), now)
    rows = rows.withColumn("issues", found)
    blank = lambda c: F.when(F.col("total") < MIN_SAMPLES, 0).otherwise(F.col(c)).alias(c)
    return rows.select(
        "op", "total", "errors", blank("p50"), blank("p95"), blank("p99"),
        F.array_join("issues", ",").alias("issues"), status(F.col("issues")).alias("status"),
    )


def trends(events: DataFrame, samples: int = SAMPLES, recent: int = 100, min_samples: int = 10) -> DataFrame:
    """Mean, median, p95, p99 of the last samples and recent-against-older trend."""
    last = last_n_per_key(events.select("op", "ts", "event_id", "latency"), ["op"], ["ts", "event_id"], samples)
    new = F.col("recency") <= recent
    means = last.groupBy("op").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("latency").alias("average"),
        F.avg(F.when(new, F.col("latency"))).alias("_recent"), F.avg(F.when(~new, F.col("latency"))).alias("_older"),
    ).filter(F.col("samples") >= min_samples)
    ps = sample_percentiles(last, ["op"], "latency", {"median": 0.5, "p95": 0.95, "p99": 0.99}, "floor")
    return means.join(ps, "op").select(
        "op", "samples", "average", "median", "p95", "p99", trend(F.col("_recent"), F.col("_older")).alias("trend")
    )


def compare_with_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``op, average`` on both sides; only ops in both, label by the 10% bands."""
    b = baseline.select("op", F.col("average").alias("base_average"))
    change = (
        F.when(F.col("average") > F.col("base_average") * 1.1, "regression")
        .when(F.col("average") < F.col("base_average") * 0.9, "improvement").otherwise("unchanged")
    )
    return current.join(b, "op").select("op", "average", "base_average", change.alias("change"))


def attach_thresholds(events: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Limits of the exact name, else of the first name that prefixes the op; null where no name does.

    Every prefix of an op is a join key, so the lookup is an equi-join.
    """
    spark = events.sparkSession
    if thresholds is None:
        rows = [(i, *t) for i, t in enumerate(THRESHOLDS)]
        thresholds = spark.createDataFrame(rows, "seq int, name string, warn_ms long, error_ms long, warn_mb long, error_mb long")
    ops = events.select("op").distinct()
    keys = ops.select("op", F.explode(F.transform(F.sequence(F.lit(1), F.length("op")), lambda i: F.substring(F.col("op"), F.lit(1), i))).alias("name"))
    limits = [c for c in thresholds.columns if c not in ("seq", "name")]
    best = keys.join(thresholds, "name").groupBy("op").agg(
        F.min_by(F.struct(*limits), F.struct(F.col("name") != F.col("op"), F.col("seq"))).alias("_t")
    )
    return events.join(best.select("op", "_t.*"), "op", "left")


def alerts(events: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Duration and memory alerts, error before warn, for positive values only."""
    rows = attach_thresholds(events, thresholds)

    def alert(kind, value, warn, error):
        level = F.when(value > error, "error").when(value > warn, "warn")
        return F.when((value > 0) & level.isNotNull(), F.struct(F.lit(kind).alias("type"), level.alias("level"), value.cast("bigint").alias("value")))

    found = F.array_compact(F.array(
        alert("duration", F.col("duration"), F.col("warn_ms"), F.col("error_ms")),
        alert("memory", F.col("memory"), F.col("warn_mb") * MB, F.col("error_mb") * MB),
    ))
    return rows.select("event_id", "op", F.inline(found))


def dashboard(events: DataFrame, status_col: str = "state", recent: int = 50) -> tuple[DataFrame, DataFrame]:
    s = F.col(status_col)
    counts = events.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "running").alias("running"),
        F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"),
    )
    return counts, events.orderBy(F.desc("ts"), F.desc("event_id")).limit(recent)


def slow_events(events: DataFrame, limit_ms: int = 1000, k: int = 10) -> DataFrame:
    return events.filter(F.col("duration") > limit_ms).orderBy(F.desc("duration"), "event_id").limit(k)


def timing_metrics(events: DataFrame, n: int = SAMPLES) -> DataFrame:
    last = last_n_per_key(events, ["op"], ["ts", "event_id"], n)
    return last.groupBy("op").agg(
        F.avg("latency").alias("avg_ms"), F.min("latency").alias("min_ms"), F.max("latency").alias("max_ms"), F.count(F.lit(1)).alias("n")
    )


def error_report(errors: DataFrame) -> DataFrame:
    """Counts by category and severity with all subtotals."""
    return errors.cube("category", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("recovered").alias("recovered")
    )


def error_advice(errors: DataFrame) -> DataFrame:
    """One row: abort test and the rule-based advice flags."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    agg = errors.agg(
        of("severity", "critical").alias("critical"), of("severity", "high").alias("high"),
        of("category", "VALIDATION").alias("_v"), of("category", "EXTRACTION").alias("_e"),
        of("category", "TRANSFORMATION").alias("_t"), of("category", "CACHE").alias("_c"),
    )
    return agg.select(
        "critical", "high", ((F.col("critical") > 0) | (F.col("high") > 5)).alias("should_abort"),
        (F.col("_v") > 5).alias("review_schema"), (F.col("_e") > 3).alias("try_other_strategy"),
        (F.col("_t") > 3).alias("review_rules"), (F.col("_c") > 0).alias("clear_cache"),
    )


def debounce(events: DataFrame, keys: Sequence[str], ts: str, gap: str = "50 milliseconds", tie: str = "event_id") -> DataFrame:
    """Last well-formed event of each burst of ``keys``; of events at one time the one with the largest ``tie``.

    A burst ends where nothing follows within ``gap``. A stream keeps session windows. A table is cut into ranges of (keys, time):
    an event further than ``gap`` from the one before starts a burst, and bursts are numbered over the ranges, so neither a
    busy key nor an endless burst is one task's work.
    """
    good = events.filter(F.col("message").isNotNull() & (F.col("message") != ""))
    last = F.max_by("message", F.struct(ts, tie)).alias("message")
    if events.isStreaming:
        return good.groupBy(*keys, F.session_window(ts, gap).alias("burst")).agg(last, F.count(F.lit(1)).alias("events"))
    timed = good.withColumn("_at", F.struct(ts, tie))
    before = carry_forward(timed, keys, [ts, tie], "_at", "_before", inclusive=False)
    starts = F.col("_before").isNull() | (F.col(ts) > F.col("_before")[ts] + F.expr(f"INTERVAL {gap}"))
    numbered = rank_rows(before.withColumn("_start", starts.cast("int")).drop("_before", "_at"), keys, [ts, tie], "burst", weight="_start")
    return numbered.groupBy(*keys, "burst").agg(last, F.count(F.lit(1)).alias("events"))
