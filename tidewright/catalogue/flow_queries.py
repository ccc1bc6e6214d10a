"""End-to-end jobs and the remaining scalar checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import OPS, SNAPSHOTS, ops, snapshots
from tidewright.catalogue.registry import query, table
from tidewright.functions import comparators, json_trees
from tidewright.operators import diff as D
from tidewright.operators import repairs as R
from tidewright.operators.strategies import FieldMapping, extract_with, map_fields, regex_strategy
from tidewright.plans import flows


@query("extraction_flow", f"""WITH {OPS}, k AS (SELECT *, md5(trim(regexp_replace(regexp_replace(content, '(?m)#.*$', '', 'g'), '\\s+', ' ', 'g'))) AS fp,
 CASE WHEN name = '' THEN 'Order' || o_custkey || 'Query' ELSE name END AS nm, file_path || '#' || id || '#0' AS rid FROM ops),
 f AS (SELECT nm, fp, min(rid) AS first FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY nm ORDER BY first) - 1 AS sfx FROM f)
 SELECT rid AS id, CASE WHEN sfx = 0 THEN nm ELSE nm || '_' || sfx END AS query_name FROM k JOIN r USING (nm, fp)""")
def extraction_flow(spark, sf):
    files = ops(spark, sf).select(
        F.concat_ws("#", "file_path", F.col("id").cast("string")).alias("path"), F.concat(F.lit("const q = gql`"), "content", F.lit("`;")).alias("content")
    )
    tagged = regex_strategy("tagged", r"\.js", r"gql`([^`]*)`")
    return flows.extract_operations(files, [tagged]).select("id", "query_name")


@query("strategy_extraction", r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<b>([^<]*)</b>', 1) AS x, regexp_extract_all(html, '<title>([^<]*)</title>', 1) AS y FROM pages),
 c AS (SELECT page_id, CASE WHEN len(x) > 0 THEN 'bold' WHEN len(y) > 0 THEN 'title' END AS strategy, CASE WHEN len(x) > 0 THEN x ELSE y END AS bs FROM a)
 SELECT page_id, strategy, CAST(i - 1 AS INTEGER) AS block_no, bs[i] AS block FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM c)""")
def strategy_extraction(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
    found = extract_with(pages, [regex_strategy("bold", "^http", "<b>([^<]*)</b>"), regex_strategy("title", "^http", "<title>([^<]*)</title>")])
    return found.select("page_id", "strategy", "block_no", "block")


@query("map_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS doubled, json_extract_string(props, '$.k') AS raw FROM events")
def map_fields_query(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    out = map_fields(e, "props", [FieldMapping("k", "doubled", lambda c: c.cast("bigint") * 2), FieldMapping("k", "raw")])
    return out.select("event_id", "doubled", "raw")


@query("important_fields", "SELECT DISTINCT event_type AS field, regexp_matches(event_type, 'id|key|name|type|status') AS important FROM events UNION SELECT DISTINCT p_name, regexp_matches(lower(p_name), 'id|key|name|type|status') FROM part")
def important_fields(spark, sf):
    names = table(spark, sf, "events").select(F.col("event_type").alias("field")).union(table(spark, sf, "part").select("p_name")).distinct()
    return names.select("field", D.is_important(F.array(F.lit("data"), F.col("field"))).alias("important"))


@query("convert_types", "SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS as_text, TRY_CAST(o_orderpriority[1] AS DOUBLE) AS as_number, TRY_CAST(o_orderstatus AS DOUBLE) AS none, o_custkey <> 0 AS as_flag FROM orders")
def convert_types(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), R.convert_value(F.col("o_orderkey"), "string").alias("as_text"),
        R.convert_value(F.substring("o_orderpriority", 1, 1), "number").alias("as_number"), R.convert_value(F.col("o_orderstatus"), "number").alias("none"),
        R.convert_value(F.col("o_custkey"), "boolean").alias("as_flag"),
    )


@query("dice_similarity", """WITH n AS (SELECT l_orderkey, min(p_name) AS p, max(p_name) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
 p AS (SELECT DISTINCT replace(p, ' ', '') AS x, replace(q, ' ', '') AS y FROM n),
 g AS (SELECT x, y, 'x' AS s, unnest(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS b FROM p UNION ALL SELECT x, y, 'y', unnest(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) FROM p),
 c AS (SELECT x, y, b, count_if(s = 'x') AS nx, count_if(s = 'y') AS ny FROM g GROUP BY 1, 2, 3)
 SELECT x, y, 2.0::DOUBLE * sum(least(nx, ny)) / (length(x) + length(y) - 2) AS d FROM c GROUP BY x, y""")
def dice_similarity(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    names = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(F.min("p_name").alias("p"), F.max("p_name").alias("q"))
    strip = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    pairs = names.select(strip(F.col("p")).alias("x"), strip(F.col("q")).alias("y")).distinct()
    return pairs.withColumn("d", json_trees.dice(F.col("x"), F.col("y")))


@query("json_leaves", f"WITH {SNAPSHOTS} SELECT id, 5 + 2 * len(items) AS leaves, 1 + len(items) AS objects, 'cust,id,priority,status,total' AS top_keys FROM snap2 WHERE has_base")
def json_leaves(spark, sf):
    base, _ = snapshots(spark, sf)
    nodes = D.flatten_json(base, "id", "data")
    leaf = F.col("node_type").isin("string", "number", "boolean")
    return nodes.groupBy("id").agg(
        F.count_if(leaf).alias("leaves"), F.count_if(F.col("node_type") == "object").alias("objects"),
        F.array_join(F.sort_array(F.collect_list(F.when((F.col("depth") == 1) & leaf, F.expr("substring(path, 3)")))), ",").alias("top_keys"),
    )


@query("deep_partial", """SELECT event_id AS id, event_id % 3 <> 2 AS inside, event_id % 2 = 0 AS head, user_id % 2 = 0 AS nested FROM events""")
def deep_partial(spark, sf):
    o, a = F.lit("object"), F.lit("array")
    k = F.get_json_object("props", "$.k")
    base = F.concat(F.lit('{"k":'), k, F.lit(',"t":1}'))
    cand = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":'), k, F.lit("}"))).when(F.col("event_id") % 3 == 1, "{}").otherwise('{"z":0}')
    test = comparators.build("deep-partial")
    items = F.when(F.col("event_id") % 2 == 0, "[1,2]").otherwise("[2,1]")
    deep = F.when(F.col("user_id") % 2 == 0, '{"a": {"y": [{"q":2}]}}').otherwise('{"a":{"y":[{"q":"2"}]}}')
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), test(base, cand, o, o).alias("inside"), test(F.lit("[1,2,3]"), items, a, a).alias("head"),
        test(F.lit('{"a":{"x":1,"y":[{"p":1,"q":2},3]},"b":"1"}'), deep, o, o).alias("nested"),
    )


@query("apply_repairs", f"""WITH {SNAPSHOTS} SELECT e, count(*) AS n FROM snap2 WHERE has_base AND has_cand AND (e IN (0, 2, 4, 5)) GROUP BY 1""")
def apply_repairs(spark, sf):
    base, cand = snapshots(spark, sf)
    fixed = R.apply_repairs(D.pair_snapshots(base.drop("errors"), cand.drop("errors")))
    back = F.parse_json("base_data").cast("string") == F.parse_json("cand_data").cast("string")
    return fixed.filter(back).groupBy((F.col("id") % 7).alias("e")).agg(F.count(F.lit(1)).alias("n"))


@query("repairs_in_order", f"""WITH {SNAPSHOTS} SELECT id, CASE type WHEN 'extra-field' THEN 'remove-field' WHEN 'null-mismatch' THEN 'handle-null' ELSE 'reorder-array' END AS action, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE WHEN err = 1 THEN 1 ELSE 2 END DESC, path) AS INTEGER) AS step FROM raw_diffs WHERE fixable""")
def repairs_in_order(spark, sf):
    diffs = D.diff_rows(D.compare_pairs(D.pair_snapshots(*snapshots(spark, sf))))
    return R.in_order(R.derive_repairs(diffs)).select("id", "action", "step")
