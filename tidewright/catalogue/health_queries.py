"""Health, performance, experiments and rollout over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import CALLS, calls
from tidewright.catalogue.registry import query, table
from tidewright.functions import hashing
from tidewright.operators import experiments as E
from tidewright.operators import health as H
from tidewright.operators import ordered as O

_LAST = """last AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ts DESC, event_id DESC) AS recency FROM calls QUALIFY recency <= 1000),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY latency) AS r, count(*) OVER (PARTITION BY op) AS n FROM last)"""


def _pick(p, rule):
    rank = f"greatest(ceil(n * {p}::DOUBLE), 1)" if rule == "ceil" else f"least(floor(n * {p}::DOUBLE) + 1, n)"
    return f"max(CASE WHEN r = {rank} THEN latency END)"


@query("simple_rates", f"WITH {CALLS} SELECT op, count(*) AS total, count_if(ok)::DOUBLE / count(*) AS success_rate, count_if(NOT ok)::DOUBLE / count(*) AS error_rate, sum(latency)::DOUBLE / count(*) AS avg_latency FROM calls GROUP BY 1")
def simple_rates(spark, sf):
    return H.simple_rates(calls(spark, sf))


_HEALTH = f"""WITH {CALLS}, {_LAST}, t AS (SELECT op, count(*) AS total, count_if(NOT ok) AS errors, max(CASE WHEN NOT ok THEN ts END) AS le FROM calls GROUP BY 1),
 p AS (SELECT op, {_pick(0.5, 'ceil')} AS p50, {_pick(0.95, 'ceil')} AS p95, {_pick(0.99, 'ceil')} AS p99 FROM ranked GROUP BY 1),
 m AS (SELECT max(ts) AS now FROM calls),
 i AS (SELECT t.op, total, errors, p50, p95, p99, list_filter([CASE WHEN errors::DOUBLE / total > 0.01 THEN 'critical' END, CASE WHEN p99 > 2000 THEN 'high' END,
   CASE WHEN epoch_ms(now) - epoch_ms(le) < 60000 THEN 'medium' END], lambda x: x IS NOT NULL) AS iss FROM t JOIN p USING (op), m)
 SELECT op, total, errors, CASE WHEN total < 100 THEN 0 ELSE p50 END AS p50, CASE WHEN total < 100 THEN 0 ELSE p95 END AS p95, CASE WHEN total < 100 THEN 0 ELSE p99 END AS p99,
 CASE WHEN total < 100 THEN 'low' ELSE array_to_string(iss, ',') END AS issues,
 CASE WHEN total < 100 THEN 'healthy' WHEN list_contains(iss, 'critical') THEN 'unhealthy' WHEN list_contains(iss, 'high') THEN 'degraded' ELSE 'healthy' END AS status FROM i"""


@query("operation_health", _HEALTH)
def operation_health(spark, sf):
    return H.health(calls(spark, sf))


_HEALTH_SET = _HEALTH.replace("FROM events)", "FROM events WHERE event_type IN ('view', 'error'))", 1)


@query("operation_health_of_set", _HEALTH_SET)
def operation_health_of_set(spark, sf):
    return H.health(calls(spark, sf), ops=["view", "error"])


@query("performance_trends", f"""WITH {CALLS}, {_LAST}, a AS (SELECT op, count(*) AS samples, sum(latency)::DOUBLE / count(*) AS average, avg(CASE WHEN recency <= 100 THEN latency END) AS rec, avg(CASE WHEN recency > 100 THEN latency END) AS old FROM last GROUP BY 1),
 p AS (SELECT op, {_pick(0.5, 'floor')} AS median, {_pick(0.95, 'floor')} AS p95, {_pick(0.99, 'floor')} AS p99 FROM ranked GROUP BY 1)
 SELECT op, samples, average, median, p95, p99, CASE WHEN rec < old * 0.9 THEN 'improving' WHEN rec > old * 1.1 THEN 'degrading' ELSE 'stable' END AS trend FROM a JOIN p USING (op) WHERE samples >= 10""")
def performance_trends(spark, sf):
    return H.trends(calls(spark, sf))


def _exact(rule):
    return f"""WITH {CALLS}, ranked AS (SELECT op, latency, row_number() OVER (PARTITION BY op ORDER BY latency) AS r, count(*) OVER (PARTITION BY op) AS n FROM calls)
 SELECT op, {_pick(0.5, rule)} AS p50, {_pick(0.9, rule)} AS p90, {_pick(0.999, rule)} AS p999 FROM ranked GROUP BY 1"""


@query("percentile_ceil_rule", _exact("ceil"))
def percentile_ceil_rule(spark, sf):
    return O.exact_percentiles(calls(spark, sf), ["op"], "latency", {"p50": 0.5, "p90": 0.9, "p999": 0.999}, "ceil")


@query("percentile_floor_rule", _exact("floor"))
def percentile_floor_rule(spark, sf):
    return O.exact_percentiles(calls(spark, sf), ["op"], "latency", {"p50": 0.5, "p90": 0.9, "p999": 0.999}, "floor")


@query("last_samples_per_key", f"WITH {CALLS} SELECT op, event_id, CAST(recency AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ts DESC, event_id DESC) AS recency FROM calls) WHERE recency <= 1500")
def last_samples_per_key(spark, sf):
    return O.last_n_per_key(calls(spark, sf).select("op", "event_id", "ts"), ["op"], ["ts", "event_id"], 1500).select("op", "event_id", "recency")


@query("compare_with_baseline", f"""WITH {CALLS}, c AS (SELECT op, sum(latency)::DOUBLE / count(*) AS average FROM calls WHERE k >= 50 GROUP BY 1),
 b AS (SELECT op, sum(latency)::DOUBLE / count(*) AS base_average FROM calls WHERE k < 50 AND op <> 'view' GROUP BY 1)
 SELECT op, average, base_average, CASE WHEN average > base_average * 1.1::DOUBLE THEN 'regression' WHEN average < base_average * 0.9::DOUBLE THEN 'improvement' ELSE 'unchanged' END AS change FROM c JOIN b USING (op)""")
def compare_with_baseline(spark, sf):
    c = calls(spark, sf)
    mean = lambda d: d.groupBy("op").agg(F.avg("latency").alias("average"))
    return H.compare_with_baseline(mean(c.filter("k >= 50")), mean(c.filter("k < 50 AND op <> 'view'")))


_TIMED = f"""{CALLS}, timed AS (SELECT event_id, ts, CASE k % 5 WHEN 0 THEN 'extraction' WHEN 1 THEN 'transformation_' || op WHEN 2 THEN 'validation:all' WHEN 3 THEN 'application' ELSE 'other' END AS op,
 latency * 4 - 100 AS duration, (k * 12 - 60) * 1048576 AS memory, latency, CASE WHEN k % 7 = 0 THEN 'running' WHEN ok THEN 'completed' ELSE 'failed' END AS state FROM calls)"""


def timed(spark, sf):
    k = F.col("k")
    op = (
        F.when(k % 5 == 0, "extraction").when(k % 5 == 1, F.concat(F.lit("transformation_"), "op")).when(k % 5 == 2, "validation:all")
        .when(k % 5 == 3, "application").otherwise("other")
    )
    state = F.when(k % 7 == 0, "running").when(F.col("ok"), "completed").otherwise("failed")
    return calls(spark, sf).select(
        "event_id", "ts", op.alias("op"), (F.col("latency") * 4 - 100).alias("duration"), ((k * 12 - 60) * 1048576).alias("memory"), "latency", state.alias("state")
    )


_LIMITED = f"""{_TIMED}, th(name, w, e, mw, me) AS (VALUES ('extraction', 1000, 5000, 100, 500), ('transformation', 500, 2000, 50, 200), ('validation', 100, 500, 20, 100), ('application', 200, 1000, 30, 150)),
 lim AS (SELECT t.*, w, e, mw, me FROM timed t LEFT JOIN th ON starts_with(op, name))"""


@query("attach_thresholds", f"WITH {_LIMITED} SELECT event_id, op, CAST(w AS BIGINT) AS warn_ms, CAST(e AS BIGINT) AS error_ms FROM lim")
def attach_thresholds(spark, sf):
    return H.attach_thresholds(timed(spark, sf)).select("event_id", "op", "warn_ms", "error_ms")


@query("threshold_alerts", f"""WITH {_LIMITED} SELECT event_id, op, 'duration' AS type, CASE WHEN duration > e THEN 'error' ELSE 'warn' END AS level, duration AS value FROM lim WHERE duration > 0 AND duration > w
 UNION ALL SELECT event_id, op, 'memory', CASE WHEN memory > me * 1048576 THEN 'error' ELSE 'warn' END, memory FROM lim WHERE memory > 0 AND memory > mw * 1048576""")
def threshold_alerts(spark, sf):
    return H.alerts(timed(spark, sf))


@query("dashboard_counts", f"WITH {_TIMED} SELECT count(*) AS total, count_if(state = 'running') AS running, count_if(state = 'completed') AS completed, count_if(state = 'failed') AS failed FROM timed")
def dashboard_counts(spark, sf):
    return H.dashboard(timed(spark, sf))[0]


@query("dashboard_recent", f"WITH {_TIMED} SELECT event_id, op, duration, state FROM timed ORDER BY ts DESC, event_id DESC LIMIT 50")
def dashboard_recent(spark, sf):
    return H.dashboard(timed(spark, sf))[1].select("event_id", "op", "duration", "state")


@query("slow_events", f"WITH {_TIMED} SELECT event_id, op, duration FROM timed WHERE duration > 1000 ORDER BY duration DESC, event_id LIMIT 10")
def slow_events(spark, sf):
    return H.slow_events(timed(spark, sf)).select("event_id", "op", "duration")


@query("timing_metrics", f"WITH {CALLS}, {_LAST} SELECT op, sum(latency)::DOUBLE / count(*) AS avg_ms, min(latency) AS min_ms, max(latency) AS max_ms, count(*) AS n FROM last GROUP BY 1")
def timing_metrics(spark, sf):
    return H.timing_metrics(calls(spark, sf))


_ERRS = f"""{CALLS}, errs AS (SELECT CASE k % 4 WHEN 0 THEN 'VALIDATION' WHEN 1 THEN 'EXTRACTION' WHEN 2 THEN 'TRANSFORMATION' ELSE 'CACHE' END AS category,
 CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, user_id % 2 = 0 AS recovered FROM calls WHERE op = 'error')"""


def errs(spark, sf):
    k, u = F.col("k") % 4, F.col("user_id") % 4
    return calls(spark, sf).filter(F.col("op") == "error").select(
        F.when(k == 0, "VALIDATION").when(k == 1, "EXTRACTION").when(k == 2, "TRANSFORMATION").otherwise("CACHE").alias("category"),
        F.when(u == 0, "low").when(u == 1, "medium").when(u == 2, "high").otherwise("critical").alias("severity"),
        (F.col("user_id") % 2 == 0).alias("recovered"),
    )


@query("error_report", f"WITH {_ERRS} SELECT category, severity, count(*) AS n, count_if(recovered) AS recovered FROM errs GROUP BY CUBE (category, severity)")
def error_report(spark, sf):
    return H.error_report(errs(spark, sf))


@query("error_advice", f"""WITH {_ERRS} SELECT count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'critical') > 0 OR count_if(severity = 'high') > 5 AS should_abort,
 count_if(category = 'VALIDATION') > 5 AS review_schema, count_if(category = 'EXTRACTION') > 3 AS try_other_strategy, count_if(category = 'TRANSFORMATION') > 3 AS review_rules, count_if(category = 'CACHE') > 0 AS clear_cache FROM errs""")
def error_advice(spark, sf):
    return H.error_advice(errs(spark, sf))


@query("critical_first", f"WITH {_ERRS} SELECT severity, category, count(*) AS n FROM errs GROUP BY 1, 2")
def critical_first(spark, sf):
    rows = errs(spark, sf).groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))
    return O.by_priority(rows, "severity", ["critical", "high", "medium", "low"], "category")


@query("debounce_bursts", """WITH e AS (SELECT event_id, event_type AS op, epoch_us(ts) AS us, ts, nullif(props, '') AS message FROM events),
 g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY op ORDER BY us, event_id) <= 600000000 THEN 0 ELSE 1 END AS b FROM e),
 s AS (SELECT *, sum(b) OVER (PARTITION BY op ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
 SELECT op, max_by(message, (us, event_id)) AS message, count(*) AS events FROM s GROUP BY op, sid""")
def debounce_bursts(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("message"))
    return H.debounce(e, ["op"], "ts", "10 minutes").select("op", "message", "events")


_ABS = "abs(CASE WHEN {u} >= 2147483648 THEN {u} - 4294967296 ELSE {u} END)"
_H31 = "list_reduce(list_transform(string_split({c}, ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296, 0::BIGINT)"
_ARMS = f"""{CALLS}, hashed AS (SELECT *, {_H31.format(c='CAST(event_id AS VARCHAR)')} AS u, {_H31.format(c='CAST(user_id AS VARCHAR) || op')} AS us FROM calls),
 armed AS (SELECT *, op AS experiment, CASE WHEN {_ABS.format(u='u')} % 100 < 30 THEN 'variant' ELSE 'control' END AS arm FROM hashed)"""


def armed(spark, sf):
    return calls(spark, sf).withColumn("experiment", F.col("op")).withColumn(
        "arm", E.assign_arm(F.col("event_id").cast("string"), F.lit(30))
    )


@query("string_hash", f"SELECT doc_id, {_ABS.format(u='u')} AS h FROM (SELECT doc_id, {_H31.format(c='text')} AS u FROM documents)")
def string_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.hash31(F.col("text")).alias("h"))


@query("assign_arm", f"WITH {_ARMS} SELECT event_id, arm FROM armed")
def assign_arm(spark, sf):
    return armed(spark, sf).select("event_id", "arm")


@query("salted_rollout", f"WITH {_ARMS} SELECT event_id, {_ABS.format(u='us')} % 100 + 1 <= 25 AS migrated FROM hashed")
def salted_rollout(spark, sf):
    return calls(spark, sf).select("event_id", E.in_rollout(F.col("user_id").cast("string"), F.col("op"), F.lit(25)).alias("migrated"))


@query("segment_gate", f"""WITH {_ARMS} SELECT event_id, CASE WHEN k % 7 = 0 THEN false WHEN k % 3 = 0 THEN k % 2 = 0 WHEN k % 5 > 0 THEN {_ABS.format(u='us')} % 100 + 1 <= 25 ELSE true END AS allowed FROM hashed""")
def segment_gate(spark, sf):
    k = F.col("k")
    segments = F.when(k % 3 == 0, F.array(F.lit("even"), F.lit("beta"))).otherwise(F.array().cast("array<string>"))
    segment = F.when(k % 2 == 0, "even").otherwise("odd")
    pct = F.when(k % 5 > 0, 25).otherwise(100)
    inside = E.in_rollout(F.col("user_id").cast("string"), F.col("op"), F.lit(25))
    return calls(spark, sf).select("event_id", E.segment_gate(k % 7 != 0, segments, segment, pct, inside).alias("allowed"))


@query("in_experiment", f"WITH {CALLS} SELECT event_id FROM calls WHERE user_id % 4 <> 1 AND user_id % 2 = 1")
def in_experiment(spark, sf):
    c = calls(spark, sf)
    users = c.select("user_id").distinct()
    return E.in_experiment(c.select("event_id", "user_id"), "user_id", users.filter("user_id % 4 = 1"), users.filter("user_id % 2 = 1")).select("event_id")


@query("route_experiments", f"""WITH {_ARMS}, r AS (SELECT *, CASE WHEN user_id % 10 = 3 THEN 'named' ELSE 'open' END AS experiment2, {_H31.format(c='CAST(user_id AS VARCHAR)')} AS uu FROM hashed)
 SELECT event_id, experiment2 AS experiment, CASE WHEN experiment2 = 'named' THEN CASE WHEN {_ABS.format(u='uu')} % 100 < 60 THEN 'variant' ELSE 'control' END ELSE 'control' END AS arm FROM r""")
def route_experiments(spark, sf):
    c = calls(spark, sf).select("event_id", "user_id")
    named = c.select("user_id").distinct().filter("user_id % 10 = 3").select(
        F.lit(1).alias("seq"), F.lit("named").alias("experiment"), F.col("user_id").alias("unit"), F.lit(60).alias("split"), F.lit(False).alias("paused")
    )
    rest = spark.createDataFrame([(2, "open", None, 50, True)], "seq int, experiment string, unit long, split int, paused boolean")
    return E.route(c, "user_id", named.unionByName(rest)).select("event_id", "experiment", "arm")


_METRICS = f"""{_ARMS}, alast AS (SELECT *, row_number() OVER (PARTITION BY experiment, arm ORDER BY ts DESC, event_id DESC) AS recency FROM armed QUALIFY recency <= 1000),
 ar AS (SELECT *, row_number() OVER (PARTITION BY experiment, arm ORDER BY latency) AS r, count(*) OVER (PARTITION BY experiment, arm) AS n FROM alast),
 ap AS (SELECT experiment, arm, sum(latency)::DOUBLE / count(*) AS avg_latency, {_pick(0.95, 'floor')} AS p95, {_pick(0.99, 'floor')} AS p99 FROM ar GROUP BY 1, 2),
 ac AS (SELECT experiment, arm, count(*) AS requests, count_if(ok) AS successes, count_if(NOT ok) AS errors, string_agg(DISTINCT error, ',' ORDER BY error) AS error_types FROM armed GROUP BY 1, 2),
 metrics AS (SELECT * FROM ac JOIN ap USING (experiment, arm))"""


@query("arm_metrics", f"WITH {_METRICS} SELECT * FROM metrics")
def arm_metrics(spark, sf):
    m = E.arm_metrics(armed(spark, sf))
    return m.withColumn("error_types", F.array_join(F.map_keys("error_types"), ","))


@query("significance", f"""WITH {_METRICS}, w AS (SELECT experiment, max(CASE WHEN arm = 'control' THEN requests END) AS cr, max(CASE WHEN arm = 'control' THEN successes END) AS cs,
  max(CASE WHEN arm = 'variant' THEN requests END) AS vr, max(CASE WHEN arm = 'variant' THEN successes END) AS vs FROM metrics GROUP BY 1),
 q AS (SELECT *, cs::DOUBLE / cr AS c, vs::DOUBLE / vr AS v, least(cr, vr) AS n FROM w), z AS (SELECT *, sqrt((c + v) / 2 * (1 - (c + v) / 2) * (2.0::DOUBLE / n)) AS se FROM q),
 f AS (SELECT *, CASE WHEN n < 30 THEN 0.0::DOUBLE WHEN se = 0 THEN CASE WHEN c = v THEN 0.0::DOUBLE ELSE 0.99::DOUBLE END WHEN abs(v - c) / se > 2.58 THEN 0.99::DOUBLE WHEN abs(v - c) / se > 1.96 THEN 0.95::DOUBLE
   WHEN abs(v - c) / se > 1.64 THEN 0.9::DOUBLE ELSE abs(v - c) / se / 2.58::DOUBLE END AS conf FROM z),
 g AS (SELECT *, CASE WHEN conf > 0.95 THEN CASE WHEN v > c THEN 'variant' ELSE 'control' END WHEN abs(v - c) < 0.001 THEN 'tie' END AS winner FROM f)
 SELECT experiment, round(conf, 9) AS confidence, winner, CASE WHEN winner = 'variant' AND v > 0.98 THEN 'Safe to migrate - variant performing better' WHEN winner = 'control' THEN 'Do not migrate - control performing better'
  WHEN winner = 'tie' THEN 'Safe to migrate - no performance difference' ELSE 'Continue testing' END AS recommendation FROM g""")
def significance(spark, sf):
    return E.significance(E.arm_metrics(armed(spark, sf))).select("experiment", F.round("confidence", 9).alias("confidence"), "winner", "recommendation")


@query("can_graduate", f"""WITH {_METRICS}, s(stage, pct, mins, maxe, minn) AS (VALUES (0, 10.0::DOUBLE, 0.98, 0.02, 100), (1, 25.0::DOUBLE, 0.98, 0.02, 500), (2, 50.0::DOUBLE, 0.98, 0.02, 2500), (3, 100.0::DOUBLE, 0.98, 0.02, 5000)),
 m AS (SELECT *, CAST(length(experiment) % 4 AS INTEGER) AS stage FROM metrics WHERE arm = 'variant')
 SELECT experiment, m.stage, pct AS next_percentage, coalesce(successes::DOUBLE / requests >= mins AND errors::DOUBLE / requests <= maxe AND requests >= minn, false) AS graduates FROM m LEFT JOIN s ON s.stage = m.stage + 1""")
def can_graduate(spark, sf):
    m = E.arm_metrics(armed(spark, sf)).withColumn("stage", F.length("experiment") % 4)
    return E.can_graduate(m, E.stage_table(spark, "low_risk"))


@query("auto_rollback", f"""WITH {_METRICS}, w AS (SELECT experiment, max(CASE WHEN arm = 'variant' THEN errors END)::DOUBLE / max(CASE WHEN arm = 'variant' THEN requests END) AS error_rate,
 max(CASE WHEN arm = 'variant' THEN avg_latency END) / max(CASE WHEN arm = 'control' THEN avg_latency END) AS latency_ratio FROM metrics GROUP BY 1)
 SELECT *, CASE WHEN error_rate > 0.05 THEN 'errors' WHEN latency_ratio > 2.0 THEN 'latency' END AS cause, error_rate > 0.05 OR latency_ratio > 2.0 AS roll_back FROM w""")
def auto_rollback(spark, sf):
    return E.should_roll_back(E.arm_metrics(armed(spark, sf)))


def rollout_log(spark, sf):
    k, t = F.col("k"), F.col("op")
    action = (
        F.when((t == "purchase") & (k % 10 == 0), "start").when((t == "error") & (k % 25 == 0), "rollback").when((t == "click") & (k % 10 == 0), "pause").when(t == "signup", "increase")
    )
    return calls(spark, sf).select(
        F.concat(F.lit("op"), (F.col("user_id") % 40).cast("string")).alias("op"), "ts", F.col("event_id").alias("seq"), action.alias("action"),
        F.when(t == "purchase", k).when(k % 4 == 0, -(k % 30)).otherwise(k % 12).alias("amount"),
    ).filter("action IS NOT NULL")


_LOG = f"""{CALLS}, log AS (SELECT * FROM (SELECT 'op' || (user_id % 40) AS op, ts, event_id AS seq, CASE WHEN op = 'purchase' AND k % 10 = 0 THEN 'start' WHEN op = 'error' AND k % 25 = 0 THEN 'rollback' WHEN op = 'click' AND k % 10 = 0 THEN 'pause' WHEN op = 'signup' THEN 'increase' END AS action,
   CASE WHEN op = 'purchase' THEN k WHEN k % 4 = 0 THEN -(k % 30) ELSE k % 12 END AS amount FROM calls) WHERE action IS NOT NULL),
 states AS (SELECT op, coalesce(max_by(CASE WHEN action = 'start' THEN true ELSE false END, seq) FILTER (WHERE action <> 'increase'), false) AS enabled,
  list_reduce(list({{'a': action, 'v': amount}} ORDER BY seq), lambda s, x: CASE WHEN x.a = 'start' THEN {{'a': 's', 'v': x.v}} WHEN x.a = 'rollback' THEN {{'a': 's', 'v': 0::BIGINT}} WHEN x.a = 'increase' THEN {{'a': 's', 'v': least(100, s.v + x.v)}} ELSE s END, {{'a': 's', 'v': 0::BIGINT}}).v AS percentage FROM log GROUP BY op)"""


@query("rollout_state", f"WITH {_LOG} SELECT op, enabled, percentage FROM states")
def rollout_state(spark, sf):
    return E.rollout_state(rollout_log(spark, sf))


@query("rollback_plan_gradual", f"WITH {_LOG} SELECT op, 1 AS step, 'decrease' AS action, percentage - CAST(floor(percentage / 2) AS BIGINT) AS to_percentage FROM states WHERE enabled UNION ALL SELECT op, 2, 'rollback', 0 FROM states WHERE enabled")
def rollback_plan_gradual(spark, sf):
    return E.rollback_plan(E.rollout_state(rollout_log(spark, sf)), None, "gradual")


@query("rollback_plan_immediate", f"""WITH {_LOG}, c AS (SELECT op, max_by(amount, seq) AS p FROM log WHERE action = 'start' GROUP BY 1)
 SELECT op, 1 AS step, 'rollback' AS action, 0::BIGINT AS to_percentage FROM states UNION ALL SELECT op, 2, 'start', p FROM states JOIN c USING (op)""")
def rollback_plan_immediate(spark, sf):
    log = rollout_log(spark, sf)
    checks = log.filter(F.col("action") == "start").select("op", F.struct("ts", "seq").alias("ts"), F.lit(True).alias("enabled"), F.col("amount").alias("percentage"))
    return E.rollback_plan(E.rollout_state(log), checks, "immediate")


@query("latest_checkpoint_as_of", """WITH c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'signup'), a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
 SELECT event_id, epoch_us(c.ts) AS as_of_us, value FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.ts >= c.ts""")
def latest_checkpoint_as_of(spark, sf):
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), "value")
    out = O.as_of_join(left, right, "user_id", "ts", "at", ["value"])
    return out.select("event_id", F.unix_micros(F.col("as_of").cast("timestamp")).alias("as_of_us"), "value")


@query("latest_checkpoint", "SELECT user_id, max(event_id) AS checkpoint, max_by(value, ts) AS value FROM events WHERE event_type = 'signup' GROUP BY 1")
def latest_checkpoint(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'signup'")
    return e.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("checkpoint"), F.max_by("value", "ts").alias("value"))
