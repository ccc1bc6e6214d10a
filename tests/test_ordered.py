import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tidewright.functions.hashing import bucket, fingerprint, hash31
from tidewright.operators import experiments as E
from tidewright.operators import health as H
from tidewright.operators import ordered as O

T0 = dt.datetime(2024, 1, 1)


def calls(spark, rows):
    return spark.createDataFrame(rows, "event_id int, ts timestamp, op string, ok boolean, latency bigint")


def test_exact_percentiles_on_skewed_values(spark):
    rng = random.Random(1)
    data = {"hot": [rng.choice([7, 7, 7, rng.randrange(10**6)]) for _ in range(3000)], "one": [5], "two": [9, 1]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "op string, latency bigint")
    ps = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for rule in ("ceil", "floor"):
        got = {r["op"]: r for r in O.exact_percentiles(df, ["op"], "latency", ps, rule).collect()}
        for k, vs in data.items():
            s, n = sorted(vs), len(vs)
            for name, p in ps.items():
                i = max(0, math.ceil(n * p) - 1) if rule == "ceil" else min(n - 1, math.floor(n * p))
                assert got[k][name] == s[i], (rule, k, name)


def test_last_n_with_salting(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(5000)], "event_id int, op string")
    got = O.last_n_per_key(df, ["op"], ["event_id"], 1500)
    assert got.agg(F.min("event_id"), F.count("*")).first() == (3500, 1500)


def test_as_of_join_carries_across_periods(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), T0 + dt.timedelta(hours=rng.randrange(200))) for i in range(60)]
    right = [(rng.choice("ab"), T0 + dt.timedelta(hours=h), h) for h in rng.sample(range(200), 25)]
    ldf = spark.createDataFrame(left, "id int, k string, ts timestamp")
    rdf = spark.createDataFrame(right, "k string, at timestamp, v int")
    got = {r["id"]: r["v"] for r in O.as_of_join(ldf, rdf, "k", "ts", "at", ["v"]).collect()}
    for i, k, ts in left:
        before = [(at, v) for rk, at, v in right if rk == k and at <= ts]
        assert got[i] == (max(before)[1] if before else None)
    assert len(got) == 60


def js_hash(s):
    h = 0
    units = s.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i:i + 2], "little")) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_hash_matches_utf16_rule(spark):
    words = ["", "abc", "Zürich", "日本語", "😀 smile", "x" * 300]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", hash31(F.col("w")), fingerprint(F.col("w"), "base36")).collect()
    assert [r[1] for r in rows] == [abs(js_hash(w)) for w in words]
    assert int(rows[1][2], 36) == js_hash("abc") == 96354


def test_variant_set_only_grows_with_the_split(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("u"))
    arms = [df.filter(E.assign_arm(F.col("u"), F.lit(p)) == "variant").select("u").collect() for p in (0, 10, 50, 100)]
    sets = [{r[0] for r in a} for a in arms]
    assert sets[0] == set() and sets[0] <= sets[1] <= sets[2] <= sets[3] and len(sets[3]) == 500
    assert df.filter(bucket(F.col("u")) >= 100).count() == 0


def test_confidence_bands(spark):
    cases = [(0.5, 0.6, 29, 0.0), (1.0, 1.0, 100, 0.0), (1.0, 0.0, 100, 0.99), (0.5, 0.9, 100, 0.99), (0.9, 0.9, 100, 0.0)]
    df = spark.createDataFrame(cases, "c double, v double, n int, want double")
    for r in df.select("want", E.confidence(F.col("c"), F.col("v"), F.col("n")).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 1e-12


def test_rollout_state_with_caps_and_decreases(spark):
    rng = random.Random(3)
    log, state = [], {}
    for i in range(800):
        op, action = rng.choice("abc"), rng.choice(["start", "rollback", "pause", "segments"] + ["increase"] * 12)
        amount = rng.randrange(101) if action == "start" else rng.randrange(-20, 40)
        log.append((op, T0 + dt.timedelta(hours=i), i, action, amount))
        enabled, pct = state.get(op, (False, 0))
        if action == "start":
            enabled, pct = True, amount
        elif action == "rollback":
            enabled, pct = False, 0
        elif action == "increase":
            pct = min(100, pct + amount)
        else:
            enabled = action == "segments"
        state[op] = (enabled, pct)
    df = spark.createDataFrame(log, "op string, ts timestamp, seq int, action string, amount int")
    got = {r["op"]: (r["enabled"], r["percentage"]) for r in E.rollout_state(df).collect()}
    assert got == state


def test_health_statuses(spark):
    rows = []
    for i in range(200):
        at = T0 + dt.timedelta(minutes=i)
        rows += [(i, at, "good", True, 10), (i, at, "slow", True, 3000), (i, at, "bad", i % 10 > 0, 10)]
    rows += [(i, T0, "few", False, 1) for i in range(99)]
    got = {r["op"]: (r["status"], r["issues"]) for r in H.health(calls(spark, rows)).collect()}
    assert got["good"] == ("healthy", "") and got["slow"] == ("degraded", "high")
    assert got["few"] == ("healthy", "low") and got["bad"][0] == "unhealthy"


def test_trend_edges(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), "nine", True, 5) for i in range(9)]
    rows += [(i, T0 + dt.timedelta(seconds=i), "hundred", True, 5) for i in range(100)]
    rows += [(i, T0 + dt.timedelta(seconds=i), "worse", True, 5 if i < 50 else 50) for i in range(150)]
    got = {r["op"]: r["trend"] for r in H.trends(calls(spark, rows)).collect()}
    assert got == {"hundred": "stable", "worse": "degrading"}


def test_threshold_prefers_exact_name(spark):
    th = spark.createDataFrame(
        [(0, "ab", 1, 2, 1, 2), (1, "abc", 10, 20, 1, 2)], "seq int, name string, warn_ms long, error_ms long, warn_mb long, error_mb long"
    )
    ev = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, "zz")], "event_id int, op string")
    got = {r["op"]: r["warn_ms"] for r in H.attach_thresholds(ev, th).collect()}
    assert got == {"abc": 10, "abcd": 1, "zz": None}


def test_rank_rows_spreads_one_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot", i) for i in rng.sample(range(10**6), 3000)] + [("b", 5), ("c", 1), ("c", 0)]
    got = O.rank_rows(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()
    for key in ("hot", "b", "c"):
        want = sorted(v for k, v in rows if k == key)
        assert [r["v"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in got if r["k"] == key) == list(range(1, len(want) + 1))
