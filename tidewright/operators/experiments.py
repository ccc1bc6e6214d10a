"""Traffic splits, arm metrics, significance, stages and the rollout log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.hashing import bucket, hash31
from tidewright.operators.ordered import last_n_per_key, sample_percentiles

# Stage tables as (percentage, duration, min success, max error,
# min sample), rollback limits and the significance bands.
STAGES = {
    "default": (
        (1.0, "1h", 0.99, 0.01, 100), (5.0, "2h", 0.98, 0.02, 500), (25.0, "12h", 0.98, 0.02, 2500),
        (50.0, "24h", 0.98, 0.02, 5000), (100.0, "unlimited", 0.98, 0.02, 10000),
    ),
    "breaking": (
        (0.1, "30m", 0.999, 0.001, 100), (1.0, "2h", 0.99, 0.01, 1000), (5.0, "6h", 0.99, 0.01, 5000),
        (10.0, "24h", 0.99, 0.01, 10000), (25.0, "48h", 0.99, 0.01, 25000),
    ),
    "low_risk": (
        (10.0, "30m", 0.98, 0.02, 100), (25.0, "1h", 0.98, 0.02, 500), (50.0, "2h", 0.98, 0.02, 2500), (100.0, "4h", 0.98, 0.02, 5000),
    ),
}
ERROR_LIMIT, LATENCY_LIMIT, SAMPLES = 0.05, 2.0, 1000
BANDS = ((2.58, 0.99), (1.96, 0.95), (1.64, 0.90))


def assign_arm(unit: Column, split: Column, paused: Column | None = None) -> Column:
    arm = F.when(bucket(unit) < split, "variant").otherwise("control")
    return arm if paused is None else F.when(paused, "control").otherwise(arm)


def in_rollout(user: Column, op: Column, pct: Column, seed: int = 0) -> Column:
    """Salted percentage test; a missing user draws from a seeded generator."""
    known = (hash31(F.concat(user, op)) % 100) + 1 <= pct
    return F.when(user.isNull() | (user == ""), F.rand(seed) * 100 < pct).otherwise(known)


def segment_gate(enabled: Column, segments: Column, segment: Column, pct: Column, in_pct: Column) -> Column:
    by_segment = segment.isNotNull() & (segment != "") & (F.size(segments) > 0)
    return (
        F.when(~enabled, False).when(by_segment, F.array_contains(segments, segment))
        .when(pct < 100, in_pct).otherwise(True)
    )


def in_experiment(units: DataFrame, key: str, exclude: DataFrame, target: DataFrame | None = None) -> DataFrame:
    kept = units.join(exclude.select(key).distinct(), key, "left_anti")
    return kept if target is None else kept.join(target.select(key).distinct(), key, "left_semi")


def route(units: DataFrame, unit: str, experiments: DataFrame) -> DataFrame:
    """First matching experiment per unit decides; no match is control.

    ``experiments``: seq, experiment, unit (null = every unit), split, paused.
    """
    rows = units.withColumn("_u", F.col(unit))
    named = experiments.filter(F.col("unit").isNotNull()).select(F.col("unit").alias("_u"), F.struct("seq", "experiment", "split", "paused").alias("_n"))
    open_ = experiments.filter(F.col("unit").isNull()).agg(F.min_by(F.struct("seq", "experiment", "split", "paused"), "seq").alias("_o"))
    first = named.groupBy("_u").agg(F.min_by("_n", F.col("_n.seq")).alias("_n"))
    out = rows.join(first, "_u", "left").join(open_, how="inner")
    pick = F.when(F.col("_n").isNull() | (F.col("_o.seq") < F.col("_n.seq")), F.coalesce("_o", "_n")).otherwise(F.col("_n"))
    out = out.withColumn("_x", pick)
    arm = F.when(F.col("_x").isNull(), "control").otherwise(assign_arm(F.col("_u").cast("string"), F.col("_x.split"), F.col("_x.paused")))
    return out.select(*units.columns, F.col("_x.experiment").alias("experiment"), arm.alias("arm"))


def arm_metrics(calls: DataFrame, keys: Sequence[str] = ("experiment", "arm")) -> DataFrame:
    """Requests, successes, errors over all calls; latency over the last 1000."""
    keys = list(keys)
    counts = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("errors")
    )
    last = last_n_per_key(calls.select(*keys, "ts", "event_id", "latency"), keys, ["ts", "event_id"], SAMPLES)
    means = last.groupBy(*keys).agg(F.avg("latency").alias("avg_latency"))
    ps = sample_percentiles(last, keys, "latency", {"p95": 0.95, "p99": 0.99}, "floor")
    kinds = calls.filter(~F.col("ok") & F.col("error").isNotNull()).groupBy(*keys, "error").agg(F.count(F.lit(1)).alias("n"))
    types = kinds.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error", "n")))).alias("error_types"))
    return counts.join(means, keys).join(ps, keys).join(types, keys, "left")


def confidence(control: Column, variant: Column, n: Column) -> Column:
    pooled = (control + variant) / 2
    se = F.sqrt(pooled * (1 - pooled) * (F.lit(2.0) / n))
    z = F.abs(variant - control) / F.when(se > 0, se)
    out = F.when(n < 30, 0.0).when(se == 0, F.when(control == variant, 0.0).otherwise(0.99))
    for limit, value in BANDS:
        out = out.when(z > limit, value)
    return out.otherwise(z / BANDS[0][0])


def significance(metrics: DataFrame) -> DataFrame:
    """One row per experiment: rates of both arms, confidence, winner, text."""
    def arm(name, c):
        return F.coalesce(F.max(F.when(F.col("arm") == name, F.col(c))), F.lit(0))

    wide = metrics.groupBy("experiment").agg(
        *[arm(a, c).alias(f"{a}_{c}") for a in ("control", "variant") for c in ("requests", "successes")]
    )
    rate = lambda a: F.when(F.col(f"{a}_requests") > 0, F.col(f"{a}_successes") / F.col(f"{a}_requests")).otherwise(0.0)
    wide = wide.withColumns({"control_rate": rate("control"), "variant_rate": rate("variant")})
    c, v = F.col("control_rate"), F.col("variant_rate")
    wide = wide.withColumn("confidence", confidence(c, v, F.least("control_requests", "variant_requests")))
    winner = F.when(F.col("confidence") > 0.95, F.when(v > c, "variant").otherwise("control")).when(F.abs(v - c) < 0.001, "tie")
    wide = wide.withColumn("winner", winner)
    w = F.col("winner")
    text = (
        F.when((w == "variant") & (v > 0.98), "Safe to migrate - variant performing better")
        .when(w == "control", "Do not migrate - control performing better")
        .when(w == "tie", "Safe to migrate - no performance difference").otherwise("Continue testing")
    )
    return wide.withColumn("recommendation", text)


def stage_table(spark, name: str = "default") -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(STAGES[name])]
    return spark.createDataFrame(rows, "stage int, percentage double, duration string, min_success double, max_error double, min_sample long")


def can_graduate(metrics: DataFrame, stages: DataFrame, current: str = "stage") -> DataFrame:
    """Whether each variant arm meets the criteria of its **next** stage."""
    nxt = stages.select((F.col("stage") - 1).alias(current), F.col("percentage").alias("next_percentage"), "min_success", "max_error", "min_sample")
    rows = metrics.filter(F.col("arm") == "variant").join(nxt, current, "left")
    ok, bad = F.col("successes") / F.col("requests"), F.col("errors") / F.col("requests")
    passed = (ok >= F.col("min_success")) & (bad <= F.col("max_error")) & (F.col("requests") >= F.col("min_sample"))
    return rows.select("experiment", current, "next_percentage", F.coalesce(passed, F.lit(False)).alias("graduates"))


def should_roll_back(metrics: DataFrame) -> DataFrame:
    def of(arm, c):
        return F.max(F.when(F.col("arm") == arm, F.col(c)))

    wide = metrics.groupBy("experiment").agg(
        (of("variant", "errors") / of("variant", "requests")).alias("error_rate"),
        (of("variant", "avg_latency") / of("control", "avg_latency")).alias("latency_ratio"),
    )
    cause = F.when(F.col("error_rate") > ERROR_LIMIT, "errors").when(F.col("latency_ratio") > LATENCY_LIMIT, "latency")
    return wide.withColumn("cause", cause).withColumn("roll_back", F.col("cause").isNotNull())


def rollout_state(log: DataFrame, unit: str = "day") -> DataFrame:
    """State per op after an ordered action log ``op, ts, seq, action, amount``.

    ``start`` sets the percentage, ``increase`` adds capped at 100, ``rollback``
    sets 0, ``pause`` keeps it. After the last set the rest is a capped sum,
    which composes: total + min(base, 100 - largest prefix). Prefixes are taken
    per (op, period) and then over periods, so one busy op is not one task.
    """
    at = F.struct("ts", "seq")
    sets = F.col("action").isin("start", "rollback")
    base = F.when(F.col("action") == "start", F.col("amount")).otherwise(0)
    head = log.groupBy("op").agg(
        F.max(F.when(sets, at)).alias("_set_at"), F.max_by(F.when(sets, base), F.when(sets, at)).alias("_base"),
        F.max_by(
            F.when(F.col("action").isin("start", "segments"), True).when(F.col("action").isin("pause", "rollback"), False),
            F.when(F.col("action") != "increase", at),
        ).alias("enabled"),
    )
    later = log.filter(F.col("action") == "increase").join(head.select("op", "_set_at"), "op").filter(
        F.col("_set_at").isNull() | (at > F.col("_set_at"))
    ).withColumn("_period", F.date_trunc(unit, "ts"))
    run = Window.partitionBy("op", "_period").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = later.withColumn("_run", F.sum("amount").over(run)).groupBy("op", "_period").agg(
        F.sum("amount").alias("_sum"), F.max("_run").alias("_peak")
    )
    before = Window.partitionBy("op").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    total = per.withColumn("_off", F.coalesce(F.sum("_sum").over(before), F.lit(0))).groupBy("op").agg(
        F.sum("_sum").alias("_sum"), F.max(F.col("_off") + F.col("_peak")).alias("_peak")
    )
    start = F.coalesce("_base", F.lit(0))
    pct = F.when(F.col("_sum").isNull(), start).otherwise(F.col("_sum") + F.least(start, 100 - F.col("_peak")))
    return head.join(total, "op", "left").select("op", F.coalesce("enabled", F.lit(False)).alias("enabled"), pct.cast("bigint").alias("percentage"))


def rollback_plan(state: DataFrame, checkpoints: DataFrame, strategy: str) -> DataFrame:
    """Log rows that carry out a rollback; ``checkpoints``: op, ts, enabled, percentage."""
    if strategy == "gradual":
        live = state.filter("enabled")
        steps = F.array(
            F.struct(F.lit(1).alias("step"), F.lit("decrease").alias("action"), (F.col("percentage") - F.floor(F.col("percentage") / 2)).alias("to_percentage")),
            F.struct(F.lit(2).alias("step"), F.lit("rollback").alias("action"), F.lit(0).cast("bigint").alias("to_percentage")),
        )
        return live.select("op", F.inline(steps))
    latest = checkpoints.groupBy("op").agg(F.max_by(F.struct("enabled", "percentage"), "ts").alias("_c"))
    restore = F.when(F.col("_c.enabled"), F.struct(F.lit(2).alias("step"), F.lit("start").alias("action"), F.col("_c.percentage").alias("to_percentage")))
    off = F.struct(F.lit(1).alias("step"), F.lit("rollback").alias("action"), F.lit(0).cast("bigint").alias("to_percentage"))
    return state.select("op").join(latest, "op", "left").select("op", F.inline(F.array_compact(F.array(off, restore))))
