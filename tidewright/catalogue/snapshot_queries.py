"""Snapshot comparison: pairing, differences, verdicts, repairs and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import SNAPSHOTS, snapshots
from tidewright.catalogue.registry import query, table
from tidewright.functions import comparators
from tidewright.operators import diff as D
from tidewright.operators import repairs as R


def compared(spark, sf, cfg=None):
    return D.compare_pairs(D.pair_snapshots(*snapshots(spark, sf)), cfg)


@query("pair_snapshots", f"WITH {SNAPSHOTS} SELECT id, has_base, has_cand FROM snap2")
def pair_snapshots(spark, sf):
    return D.pair_snapshots(*snapshots(spark, sf)).select("id", "has_base", "has_cand")


@query("diff_rows", f"WITH {SNAPSHOTS} SELECT id, path, type, severity, fixable FROM raw_diffs")
def diff_rows(spark, sf):
    return D.diff_rows(compared(spark, sf)).select("id", "path", "type", "severity", "fixable")


@query("compare_snapshots", f"""WITH {SNAPSHOTS} SELECT id, identical, round(similarity, 9) AS similarity, breaking, medium, round(latency_change, 9) AS latency_change,
 round(size_change, 9) AS size_change, verdict FROM compared""")
def compare_snapshots(spark, sf):
    r = lambda c: F.round(c, 9).alias(c)
    return compared(spark, sf).select(
        "id", "identical", r("similarity"), F.col("breaking").cast("bigint").alias("breaking"),
        F.col("medium").cast("bigint").alias("medium"), r("latency_change"), r("size_change"), "verdict",
    )


@query("performance_impact", f"""WITH {SNAPSHOTS} SELECT id, CASE WHEN NOT (has_base AND has_cand) THEN 'Cannot compare performance - response missing' ELSE
 CASE WHEN abs(latency_change) > 50 AND latency_change <> 'inf'::DOUBLE THEN CASE WHEN latency_change > 0 THEN 'Significant latency increase detected. Consider optimization.' ELSE 'Significant latency improvement detected.' END
  ELSE 'Performance impact is acceptable' END || CASE WHEN abs(size_change) > 50 AND size_change <> 'inf'::DOUBLE THEN CASE WHEN size_change > 0 THEN ' Response size increased significantly.' ELSE ' Response size decreased significantly.' END ELSE '' END END AS performance FROM compared""")
def performance_impact(spark, sf):
    return compared(spark, sf).select("id", "performance")


@query("validation_summary", f"""WITH {SNAPSHOTS}, a AS (SELECT count(*) AS total, count_if(identical) AS identical, count_if(NOT identical) AS modified, CAST(sum(breaking) AS BIGINT) AS breaking, avg(similarity) AS m,
 count_if(similarity < 0.9) AS low_similarity, count_if(abs(latency_change) > 20) AS latency_issues, count_if(verdict = 'review') AS needs_review FROM compared)
 SELECT total, identical, modified, breaking, round(m, 6) AS mean_similarity, low_similarity, latency_issues, needs_review, breaking = 0 AND m > 0.95 AS safe_to_migrate,
 CASE WHEN breaking > 0 OR m < 0.9 THEN 'high' WHEN m < 0.95 THEN 'medium' ELSE 'low' END AS risk, breaking = 0 AND total > 10 AS suggest_rollout,
 CASE WHEN breaking = 0 AND m > 0.98 THEN 25 WHEN breaking > 0 THEN 1 ELSE 10 END AS initial_split FROM a""")
def validation_summary(spark, sf):
    return D.validation_summary(compared(spark, sf)).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("ci_gate", f"""WITH {SNAPSHOTS} SELECT count(*) AS total, count_if(identical) AS passed, count_if(breaking > 0) AS failed, count_if(NOT identical AND breaking = 0) AS warnings, count_if(breaking > 0) = 0 AS ok FROM compared""")
def ci_gate(spark, sf):
    return D.ci_gate(compared(spark, sf))


@query("breaking_changes", f"""WITH {SNAPSHOTS} SELECT DISTINCT CASE type WHEN 'missing-field' THEN 'removed-field' ELSE 'type-change' END AS change, path, 'high' AS impact,
 CASE type WHEN 'missing-field' THEN 'Add field mapping or provide default value' ELSE 'Add type conversion in alignment function' END AS advice FROM raw_diffs WHERE type IN ('missing-field','type-mismatch')""")
def breaking_changes(spark, sf):
    return D.breaking_changes(compared(spark, sf))


def _ignoring():
    return D.CompareConfig(
        ignore=[D.IgnorePattern("data.st*", "volatile"), D.IgnorePattern("data.extra", "new field", "extra-field"),
                D.IgnorePattern(r"^data\.items(\.|$)", "lists", regex=True)],
        expected=[D.Expected("data.total", "type-mismatch"), D.Expected("data.none")],
    )


@query("diff_rows_with_ignores", f"""WITH {SNAPSHOTS} SELECT id, path, type, severity, CASE WHEN path = 'data.extra' THEN 'new field' END AS ignored FROM raw_diffs
 WHERE path NOT IN ('data.status', 'data.items', 'data.total')""")
def diff_rows_with_ignores(spark, sf):
    return D.diff_rows(compared(spark, sf, _ignoring())).select("id", "path", "type", "severity", "ignored")


@query("ignored_counts", f"WITH {SNAPSHOTS} SELECT 'data.extra' AS path, 'new field' AS reason, count(*) AS n FROM raw_diffs WHERE path = 'data.extra'")
def ignored_counts(spark, sf):
    return D.ignored_counts(compared(spark, sf, _ignoring()))


@query("drop_expected", f"""WITH {SNAPSHOTS} SELECT id, path, type FROM raw_diffs WHERE path <> 'data.status' AND NOT (path = 'data.items' AND type = 'array-order')""")
def drop_expected(spark, sf):
    expected = spark.createDataFrame([("data.status", None), ("data.items", "array-order")], "path string, type string")
    return D.drop_expected(D.diff_rows(compared(spark, sf)).select("id", "path", "type"), expected)


@query("diff_rows_with_comparators", f"""WITH {SNAPSHOTS} SELECT id, path, type FROM raw_diffs WHERE NOT (path = 'data.total' AND err = 0)""")
def diff_rows_with_comparators(spark, sf):
    cfg = D.CompareConfig(comparators={"data.total": ("type-coercion", {}), "data.cust": ("numeric-tolerance", {"tolerance": 0.5})})
    return D.diff_rows(compared(spark, sf, cfg)).select("id", "path", "type")


@query("flatten_json", """SELECT event_id AS id, '$' AS path, NULL AS parent, 0 AS depth, 'object' AS node_type, NULL AS value, '' AS ordinal FROM events
 UNION ALL SELECT event_id, '$.k', '$', 1, 'number', json_extract_string(props, '$.k'), '.00000000' FROM events""")
def flatten_json(spark, sf):
    return D.flatten_json(table(spark, sf, "events").select("event_id", "props"), "event_id", "props")


@query("pair_paths", """WITH b AS (SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events)
 SELECT event_id AS id, '$' AS path, 'object' AS base_type, CASE WHEN event_id % 5 > 0 THEN 'object' END AS cand_type, NULL AS base_value, NULL AS cand_value FROM b
 UNION ALL SELECT event_id, '$.k', 'number', CASE WHEN event_id % 5 > 0 THEN 'number' END, k, CASE WHEN event_id % 5 > 0 THEN CAST(user_id AS VARCHAR) END FROM b
 UNION ALL SELECT event_id, '$.t', NULL, 'string', NULL, event_type FROM b WHERE event_id % 5 > 0""")
def pair_paths(spark, sf):
    e = table(spark, sf, "events")
    base = D.flatten_json(e.select("event_id", "props"), "event_id", "props")
    other = e.filter("event_id % 5 > 0").select(
        "event_id", F.to_json(F.struct(F.col("user_id").alias("k"), F.col("event_type").alias("t"))).alias("j")
    )
    return D.pair_paths(base, D.flatten_json(other, "event_id", "j"))


_PAIRS = """SELECT a.conv_id, a.turn, a.text AS x, b.text AS y, a.role AS r, b.role AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def turn_pairs(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", "role")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"), F.col("role").alias("s"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("x"), "y", F.col("role").alias("r"), "s")


@query("comparators", """SELECT o_orderkey AS id, abs(o_totalprice - floor(o_totalprice)) <= 0.01 AS near, CASE WHEN greatest(abs(o_totalprice), abs(o_totalprice + o_custkey)) = 0 THEN true ELSE o_custkey / greatest(o_totalprice, o_totalprice + o_custkey) <= 0.01 END AS near_relative,
 true AS same_case, o_custkey % 120001 <= 60000 AS near_date, true AS same_number, o_custkey % 2 = 0 AS same_bool, o_custkey % 3 = 0 AS same_space, o_custkey % 4 = 0 AS same_items FROM orders""")
def comparators_query(spark, sf):
    o = table(spark, sf, "orders")
    s, n, b, a = (F.lit(t) for t in ("string", "number", "boolean", "array"))
    total = F.col("o_totalprice").cast("string")
    moved = (F.col("o_totalprice") + F.col("o_custkey")).cast("string")
    start = F.lit("1996-01-01 00:00:00")
    later = F.date_format(F.timestamp_millis(F.lit(820454400000) + F.col("o_custkey") % 120001), "yyyy-MM-dd HH:mm:ss.SSS")
    even = (F.col("o_custkey") % 2 == 0).cast("string")
    spaced = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit(" a   b\t"), "o_orderstatus")).otherwise(F.concat(F.lit("ab "), "o_orderstatus"))
    items = F.when(F.col("o_custkey") % 4 == 0, '["b","a"]').otherwise('["b","b"]')
    c = comparators.build
    return o.select(
        F.col("o_orderkey").alias("id"),
        c("numeric-tolerance")(total, F.floor("o_totalprice").cast("string"), n, n).alias("near"),
        c("numeric-tolerance", relative=True)(total, moved, n, n).alias("near_relative"),
        c("case-insensitive")(F.col("o_orderpriority"), F.lower("o_orderpriority"), s, s).alias("same_case"),
        c("date-tolerance")(start, later, s, s).alias("near_date"),
        c("type-coercion")(total, total, n, s).alias("same_number"),
        c("type-coercion")(even, F.lit("true"), b, s).alias("same_bool"),
        c("ignore-whitespace")(spaced, F.concat(F.lit("a b "), "o_orderstatus"), s, s).alias("same_space"),
        c("array-unordered")(F.lit('["a","b"]'), items, a, a).alias("same_items"),
    )


@query("array_matches", f"""WITH p AS ({_PAIRS}), w AS (SELECT conv_id, turn, string_split(x, ' ') AS a, string_split(y, ' ') AS b FROM p)
 SELECT conv_id, turn, CAST(list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN a[i] = b[i] THEN 1 ELSE 0 END)) AS BIGINT) AS in_place,
 list_sort(a) = list_sort(b) AS same_bag, list_sort(a) = list_sort(list_reverse(a)) AS self_bag FROM w""")
def array_matches(spark, sf):
    p = turn_pairs(spark, sf).select("conv_id", "turn", F.split("x", " ").alias("a"), F.split("y", " ").alias("b"))
    return p.select(
        "conv_id", "turn", D.positional_matches(F.col("a"), F.col("b")).cast("bigint").alias("in_place"),
        D.multiset_equal(F.col("a"), F.col("b")).alias("same_bag"),
        D.multiset_equal(F.col("a"), F.reverse("a")).alias("self_bag"),
    )


@query("line_diff", f"""WITH p AS ({_PAIRS}), l AS (SELECT conv_id * 1000 + turn AS id, string_split(x, chr(10)) AS o, string_split(y, chr(10)) AS n FROM p),
 r AS (SELECT id, o, n, unnest(range(1, greatest(len(o), len(n)) + 1)) AS i FROM l), d AS (SELECT id, CAST(i - 1 AS INTEGER) AS line_no, o[i] AS a, n[i] AS b FROM r WHERE o[i] IS DISTINCT FROM n[i])
 SELECT id, line_no, '-' AS op, a AS text FROM d WHERE a IS NOT NULL UNION ALL SELECT id, line_no, '+', b FROM d WHERE b IS NOT NULL""")
def line_diff(spark, sf):
    p = turn_pairs(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return D.line_diff(p, "id", "x", "y")


@query("applied_change_totals", f"""WITH p AS ({_PAIRS}), l AS (SELECT conv_id, string_split(x, chr(10)) AS o, string_split(y, chr(10)) AS n FROM p),
 r AS (SELECT conv_id, o, n, unnest(range(1, greatest(len(o), len(n)) + 1)) AS i FROM l)
 SELECT count_if(o[i] IS DISTINCT FROM n[i] AND n[i] IS NOT NULL) AS lines_added, count_if(o[i] IS DISTINCT FROM n[i] AND o[i] IS NOT NULL) AS lines_removed,
 count(DISTINCT CASE WHEN o[i] IS DISTINCT FROM n[i] THEN conv_id END) AS files FROM r""")
def applied_change_totals(spark, sf):
    p = turn_pairs(spark, sf).withColumn("id", F.col("conv_id"))
    d = D.line_diff(p, "id", "x", "y")
    return d.agg(
        F.count_if(F.col("op") == "+").alias("lines_added"), F.count_if(F.col("op") == "-").alias("lines_removed"),
        F.countDistinct("id").alias("files"),
    )


@query("word_diff")
def word_diff(spark, sf):
    p = turn_pairs(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return R.word_diff(p, "id", "x", "y")


@query("word_diff_totals", f"""WITH p AS ({_PAIRS}), t AS (SELECT conv_id, turn, len(regexp_extract_all(x, '\\w+', 0)) - len(regexp_extract_all(y, '\\w+', 0)) AS net FROM p) SELECT conv_id, turn, net FROM t""")
def word_diff_totals(spark, sf):
    p = turn_pairs(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0)))
    d = R.word_diff(p, "id", "x", "y").groupBy("id").agg(
        F.sum(words(F.coalesce("old_text", F.lit(""))) - words(F.coalesce("new_text", F.lit("")))).alias("net")
    )
    return p.join(d, "id", "left").select("conv_id", "turn", F.coalesce("net", F.lit(0)).alias("net"))


@query("derive_repairs", f"""WITH {SNAPSHOTS} SELECT id, path, CASE type WHEN 'extra-field' THEN 'remove-field' WHEN 'null-mismatch' THEN 'handle-null' ELSE 'reorder-array' END AS action,
 CASE WHEN err = 1 THEN 1 ELSE 2 END AS depth FROM raw_diffs WHERE fixable""")
def derive_repairs(spark, sf):
    rows = R.derive_repairs(D.diff_rows(compared(spark, sf)))
    return rows.select("id", "path", "action", "depth")


@query("verify_repairs", f"""WITH {SNAPSHOTS} SELECT path, type, count(*) AS n FROM raw_diffs WHERE NOT fixable AND err = 0 AND path <> 'response' GROUP BY 1, 2""")
def verify_repairs(spark, sf):
    base, cand = snapshots(spark, sf)
    pairs = D.pair_snapshots(base.drop("errors"), cand.drop("errors"))
    again = R.verify_repairs(pairs)
    return D.diff_rows(again).filter("path <> 'response'").groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query("strip_nulls", """SELECT event_id AS id, '{"k": ' || json_extract_string(props, '$.k') || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "t": "' || event_type || '"' END
 || ', "list": [null, {"in": "a: null, b"}], "deep": {' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '"u": ' || user_id END || '}}' AS data FROM events""")
def strip_nulls(spark, sf):
    e = table(spark, sf, "events")
    t = F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    u = F.when(F.col("event_id") % 2 == 0, "null").otherwise(F.col("user_id").cast("string"))
    text = F.concat(
        F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "t": '), t, F.lit(', "list": [null, {"in": "a: null, b", "x": null}], "deep": {"a\\"": null, "u": '), u, F.lit(', "z": null}}'))
    return e.select(F.col("event_id").alias("id"), D.strip_nulls(text).alias("data"))


@query("percent_change", """SELECT event_id AS id, CASE WHEN user_id % 10 = 0 THEN CASE WHEN event_id % 3 > 0 THEN 'inf'::DOUBLE ELSE 0.0::DOUBLE END
 ELSE round((event_id % 3 - user_id % 10)::DOUBLE / (user_id % 10) * 100.0::DOUBLE, 9) END AS pct FROM events""")
def percent_change(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.round(D.percent_change(F.col("user_id") % 10, F.col("event_id") % 3), 9).alias("pct")
    )


@query("convertible_values", """SELECT event_id AS id, true AS number_from_text, TRY_CAST(event_type AS DOUBLE) IS NOT NULL AS word_from_text, user_id % 2 = 0 AS flag_from_text FROM events""")
def convertible_values(spark, sf):
    s, n, b = (F.lit(t) for t in ("string", "number", "boolean"))
    v = F.col("value").cast("string")
    flag = F.when(F.col("user_id") % 2 == 0, "true").otherwise("yes")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), D.convertible(v, v, n, s).alias("number_from_text"),
        D.convertible(v, F.col("event_type"), n, s).alias("word_from_text"),
        D.convertible(F.lit("true"), flag, b, s).alias("flag_from_text"),
    )


@query("render_paths", """SELECT o_orderkey AS id, 'data.' || o_orderstatus || '[' || (o_custkey % 10) || '].name' AS path, 'data.' || o_orderstatus || '.' || (o_custkey % 10) || '.name' AS dotted FROM orders""")
def render_paths(spark, sf):
    seg = F.array(F.lit("data"), F.col("o_orderstatus"), F.concat(F.lit("#"), (F.col("o_custkey") % 10).cast("string")), F.lit("name"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), D.render_path(seg).alias("path"), D.dotted_path(seg).alias("dotted")
    )


@query("remap_paths", """SELECT o_orderkey AS id, '{"name":"' || o_orderstatus || '","profile":{"logoUrl":"' || o_orderpriority || '"},"items":[0,1,2,3,4,5,6,7,8,9]}' AS data FROM orders""")
def remap_paths(spark, sf):
    doc = F.to_json(F.struct(
        F.col("o_orderstatus").alias("displayName"), F.col("o_orderpriority").alias("logoUrl"),
        F.sequence(F.lit(0), F.lit(11)).alias("items"),
    ))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), doc.alias("data"))
    return R.remap_json(rows, "data", (("displayName", "name"), ("logoUrl", "profile.logoUrl")), head=10)
