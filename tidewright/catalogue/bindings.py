"""Frames the queries run on, derived from the given tables, with the same
derivation as a SQL common table expression for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.catalogue.registry import table
from tidewright.functions.rules import normalize_prefix

PREFIX_MAP = (
    ("economy.brand_1", "account.entry"),
    ("economy", "billing"),
    ("promo.brand_2", "email.offer"),
    ("promo", "billing"),
    ("small", "appointments.status"),
    ("large.brand_10", "website.Id_10"),
    ("large", "billing"),
)


def access(spark: SparkSession, sf: str) -> DataFrame:
    """Field accesses: customers (units) touching part attributes (fields)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_discount")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    field = F.concat(F.lower("p_type"), F.lit("."), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")))
    method = (
        F.when(F.col("l_discount") > 0.08, "destructuring")
        .when(F.col("l_linestatus") == "O", "direct")
        .otherwise("pick")
    )
    return (
        li.join(p, li.l_partkey == p.p_partkey)
        .join(o, li.l_orderkey == o.o_orderkey)
        .select(
            F.col("o_custkey").alias("unit"),
            field.alias("field"),
            normalize_prefix(field, PREFIX_MAP).alias("normalized"),
            F.col("l_returnflag").alias("entity_type"),
            method.alias("access_method"),
        )
    )


_PREFIX_CASE = " ".join(
    f"WHEN starts_with(field, '{old}') THEN '{new}' || substr(field, {len(old) + 1})" for old, new in PREFIX_MAP
)
ACCESS = f"""
raw_access AS (
  SELECT o_custkey AS unit, lower(p_type) || '.' || replace(lower(p_brand), '#', '_') AS field,
         l_returnflag AS entity_type,
         CASE WHEN l_discount > 0.08 THEN 'destructuring' WHEN l_linestatus = 'O' THEN 'direct' ELSE 'pick' END AS access_method
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
access AS (SELECT *, CASE {_PREFIX_CASE} ELSE field END AS normalized FROM raw_access)
"""


# One operation text per order, its selections from the order's parts.
FRAGMENTS = ("UrgentFields", "HighFields", "MediumFields", "NotspecifiedFields", "LowFields")


def ops(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    sel = (
        li.join(p, li.l_partkey == p.p_partkey)
        .select("l_orderkey", F.concat(F.lower("p_type"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("f"))
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_set("f")).alias("selections"))
    )
    k = F.col("o_orderkey")
    word = F.regexp_replace("o_orderpriority", "[^A-Z]", "")
    kind = F.when(k % 5 == 0, "mutation").when(k % 5 == 1, "subscription").otherwise("query")
    name = (
        F.when((k % 7 == 0) & (k % 5 > 1), "")
        .when(k % 6 == 0, F.concat(F.lit("get_"), F.lower(word), F.lit("_order")))
        .when(k % 6 == 1, F.concat(F.lit("byId"), F.initcap(F.lower(word)), F.lit("V2")))
        .when(k % 6 == 2, F.concat(F.lit("$dynamic"), F.initcap(F.lower(word))))
        .otherwise(F.concat(F.lit("getUser"), F.initcap(F.lower(word))))
    )
    head = F.when(F.col("name") == "", F.lit("{")).otherwise(F.concat("kind", F.lit(" "), "name", F.lit(" {")))
    root = F.when(k % 13 == 0, "orderConnection").otherwise("order")
    spread = F.when(k % 3 == 0, F.concat(F.lit("    ..."), F.initcap(F.lower(word)), F.lit("Fields\n"))).otherwise("")
    hole = F.when(k % 4 == 0, "    ${status}Extra\n    ${queryNames.item}\n").otherwise("")
    return (
        o.join(sel, k == sel.l_orderkey)
        .withColumn("kind", kind)
        .withColumn("name", name)
        .select(
            k.alias("id"),
            F.concat(F.lit("src/components/"), "o_orderstatus", F.lit("/order"), F.col("o_custkey").cast("string"), F.lit(".js")).alias("file_path"),
            "kind", "name", "selections", "o_custkey",
            F.when(k % 3 == 0, F.concat(F.initcap(F.lower(word)), F.lit("Fields"))).alias("fragment"),
            F.concat(
                F.lit("# order "), k.cast("string"), F.lit("\n"), head, F.lit("\n  "), root, F.lit(" {\n"),
                F.array_join(F.transform("selections", lambda s: F.concat(F.lit("    "), s, F.lit("\n"))), ""),
                spread, hole, F.lit("  }\n}"),
            ).alias("content"),
        )
    )


OPS = r"""
op_sel AS (SELECT l_orderkey, list_sort(list_distinct(list(lower(p_type) || replace(p_brand, '#', '')))) AS selections
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
op_raw AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, selections, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS word
  FROM orders JOIN op_sel ON o_orderkey = l_orderkey),
op_cap AS (SELECT *, upper(word[1]) || lower(word[2:]) AS cap,
  CASE WHEN k % 5 = 0 THEN 'mutation' WHEN k % 5 = 1 THEN 'subscription' ELSE 'query' END AS kind FROM op_raw),
op_named AS (SELECT *, CASE WHEN k % 7 = 0 AND k % 5 > 1 THEN '' WHEN k % 6 = 0 THEN 'get_' || lower(word) || '_order'
  WHEN k % 6 = 1 THEN 'byId' || cap || 'V2' WHEN k % 6 = 2 THEN '$dynamic' || cap ELSE 'getUser' || cap END AS name FROM op_cap),
ops AS (SELECT k AS id, 'src/components/' || o_orderstatus || '/order' || o_custkey || '.js' AS file_path, kind, name, selections, o_custkey,
  CASE WHEN k % 3 = 0 THEN cap || 'Fields' END AS fragment,
  '# order ' || k || chr(10) || CASE WHEN name = '' THEN '{' ELSE kind || ' ' || name || ' {' END || chr(10) || '  '
  || CASE WHEN k % 13 = 0 THEN 'orderConnection' ELSE 'order' END || ' {' || chr(10)
  || array_to_string(list_transform(selections, lambda s: '    ' || s || chr(10)), '')
  || CASE WHEN k % 3 = 0 THEN '    ...' || cap || 'Fields' || chr(10) ELSE '' END
  || CASE WHEN k % 4 = 0 THEN '    ${status}Extra' || chr(10) || '    ${queryNames.item}' || chr(10) ELSE '' END
  || '  }' || chr(10) || '}' AS content FROM op_named)
"""


# One code snippet per order with the three access forms and a join condition.
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    o = ops(spark, sf).select("id", "selections")
    k = F.col("id")
    s1 = F.element_at("selections", 1)
    sn = F.element_at("selections", -1)
    quoted = F.array_join(F.transform("selections", lambda s: F.concat(F.lit("'gem."), s, F.lit("'"))), ", ")
    var = F.when(k % 4 == 0, "shopItem").when(k % 4 == 1, "cart").when(k % 4 == 2, "listRow").otherwise("plain")
    join = F.when(
        k % 3 == 0,
        "joinEntities(items, users, (l, r) => (l.type === 'cart' && r.type === \"user\" && l.ownerId === r.userId && l.k === r.k))\n",
    ).otherwise("")
    check = F.when(k % 4 == 1, "if (entity.type === 'order' && cart) {}\n").when(
        k % 4 == 3, "map(plain.type === 'basket')\n"
    ).otherwise("")
    ret = (
        F.when(k % 5 == 0, "return [];").when(k % 5 == 1, "return [{ type: 'none' }];").when(k % 5 == 2, "return [{ ...base }];")
        .when(k % 5 == 3, "return { ventureId: 1 };").otherwise("return items;")
    )
    return o.withColumn("v", var).select(
        "id",
        F.concat(
            F.lit("const { "), s1, F.lit(", "), sn, F.lit(": alias } = "), "v", F.lit(";\n"), join, check,
            F.lit("entityPick("), "v", F.lit(", ["), quoted, F.lit("])\nx = "), "v", F.lit("?."), s1, F.lit(" && "), "v", F.lit("."), sn,
            F.lit(".current > profile.request.query.page || Math.max(1)\n"), ret,
        ).alias("code"),
    )


SNIPPETS = OPS + r""",
snip_raw AS (SELECT id, selections, selections[1] AS s1, selections[len(selections)] AS sn,
  CASE id % 4 WHEN 0 THEN 'shopItem' WHEN 1 THEN 'cart' WHEN 2 THEN 'listRow' ELSE 'plain' END AS v FROM ops),
snippets AS (SELECT id, 'const { ' || s1 || ', ' || sn || ': alias } = ' || v || ';' || chr(10)
  || CASE WHEN id % 3 = 0 THEN 'joinEntities(items, users, (l, r) => (l.type === ''cart'' && r.type === "user" && l.ownerId === r.userId && l.k === r.k))' || chr(10) ELSE '' END
  || CASE WHEN id % 4 = 1 THEN 'if (entity.type === ''order'' && cart) {}' || chr(10) WHEN id % 4 = 3 THEN 'map(plain.type === ''basket'')' || chr(10) ELSE '' END
  || 'entityPick(' || v || ', [' || array_to_string(list_transform(selections, lambda s: '''gem.' || s || ''''), ', ') || '])' || chr(10)
  || 'x = ' || v || '?.' || s1 || ' && ' || v || '.' || sn || '.current > profile.request.query.page || Math.max(1)' || chr(10)
  || CASE id % 5 WHEN 0 THEN 'return [];' WHEN 1 THEN 'return [{ type: ''none'' }];' WHEN 2 THEN 'return [{ ...base }];'
     WHEN 3 THEN 'return { ventureId: 1 };' ELSE 'return items;' END AS code FROM snip_raw)
"""


# Catalog, usages and contract texts over part types (types) and brands x sizes (fields).
def _part_field():
    return F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))


def _reason():
    s = F.col("p_size")
    base = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_"))
    return (
        F.when(s == 10, F.concat(F.lit("Use `"), base, F.lit("_new`")))
        .when(s == 20, F.concat(F.lit("please switch to using "), base, F.lit("_next")))
        .when(s == 30, F.concat(F.lit("moved to profile."), base))
        .when(s == 40, F.lit("Legacy field"))
    )


def catalog(spark: SparkSession, sf: str, keep=None) -> DataFrame:
    p = table(spark, sf, "part").select("p_type", "p_brand", "p_size")
    rows = p.filter(F.col("p_size") <= 40 if keep is None else keep)
    return rows.select(
        F.col("p_type").alias("type_name"), _part_field().alias("field_name"),
        (F.col("p_size") % 10 == 0).alias("is_deprecated"), _reason().alias("reason"),
    ).distinct()


def usages(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("id"), F.col("p_type").alias("type_name"), _part_field().alias("field_name")
    )


def contract_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One contract file per part type; the file text is split back into lines."""
    from tidewright.operators.catalog import read_lines

    c = catalog(spark, sf)
    line = F.concat(
        F.lit("  "), "field_name", F.lit("(first: Int): String"),
        F.when(F.col("is_deprecated"), F.concat(F.lit(' @deprecated(reason: "'), "reason", F.lit('")'))).otherwise(""),
    )
    body = c.groupBy("type_name").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(
        F.lit("# contract\ntype "), F.initcap(F.lower("type_name")), F.lit(" {\n"), "body",
        F.lit('\n}\n  stray: Int @deprecated(reason: "Use `x`")\nenum E {\n  odd: Int @deprecated(reason: "Use `y`")\n}'),
    )
    return read_lines(body.select("type_name", text.alias("text")), "type_name", "text")


CATALOG = r"""
part_f AS (SELECT p_partkey, p_type AS type_name, replace(lower(p_brand), '#', '_') || '_' || p_size AS field_name, p_size, replace(lower(p_brand), '#', '_') AS base FROM part),
part_r AS (SELECT *, CASE p_size WHEN 10 THEN 'Use `' || base || '_new`' WHEN 20 THEN 'please switch to using ' || base || '_next'
  WHEN 30 THEN 'moved to profile.' || base WHEN 40 THEN 'Legacy field' END AS reason,
  CASE p_size WHEN 10 THEN base || '_new' WHEN 20 THEN base || '_next' WHEN 30 THEN 'profile.' || base END AS replacement FROM part_f),
catalog AS (SELECT DISTINCT type_name, field_name, p_size % 10 = 0 AS is_deprecated, reason, replacement FROM part_r WHERE p_size <= 40),
usages AS (SELECT l_orderkey AS id, type_name, field_name FROM lineitem JOIN part_f ON l_partkey = p_partkey),
rules AS (SELECT upper(type_name[1]) || lower(type_name[2:]) AS object_type, field_name, reason, replacement, replacement IS NULL AS is_vague,
  CASE WHEN replacement IS NULL THEN 'comment-out' ELSE 'replace' END AS action FROM catalog WHERE is_deprecated)
"""


# Snapshots: an order and its items as JSON; the candidate is edited by order key.
def snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    items = li.groupBy("l_orderkey").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "q"))),
            lambda r: F.struct(r["l_partkey"].alias("part"), r["q"].alias("qty")),
        ).alias("items")
    )
    o = table(spark, sf, "orders")
    return o.join(items, o.o_orderkey == items.l_orderkey).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey", "o_orderpriority", "items"
    )


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = snapshot_rows(spark, sf)
    k = F.col("o_orderkey")
    e = k % 7

    def doc(status, total, priority, items, extra):
        return F.to_json(F.struct(
            k.alias("id"), status.alias("status"), total.alias("total"), F.col("o_custkey").alias("cust"),
            priority.alias("priority"), items.alias("items"), extra.alias("extra"),
        ))

    nothing = F.lit(None).cast("string")
    status, total, priority, items = (F.col(c) for c in ("o_orderstatus", "o_totalprice", "o_orderpriority", "items"))
    base = rows.select(
        k.alias("id"), doc(status, total, priority, items, nothing).alias("data"),
        F.when(k % 11 == 0, '[{"message":"slow"}]').alias("errors"),
        (F.col("o_custkey") % 90).alias("duration"), (k % 50).alias("size"),
    ).filter(k % 29 != 1)
    plain = doc(
        F.when(e == 6, F.concat(status, F.lit("x"))).otherwise(status), total,
        F.when(e != 1, priority),
        F.when(e == 5, F.reverse(items)).when(e == 6, F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(items),
        F.when(e == 2, F.lit("new")),
    )
    edited = F.when(
        e == 3, F.regexp_replace(plain, r'"total":([0-9.E]+)', r'"total":"$1"')
    ).when(e == 4, F.regexp_replace(plain, r'"status":"[A-Z]"', '"status":null')).otherwise(plain)
    cand = rows.select(
        k.alias("id"), edited.alias("data"),
        F.when(((k % 11 == 0) & (k % 2 == 0)) | (k % 11 == 1), '[{"message":"slow"}]').alias("errors"),
        (F.col("o_custkey") % 90 + (k % 5) * 20).alias("duration"), (k % 40).alias("size"),
    ).filter(k % 31 != 2)
    return base, cand


SNAPSHOTS = r"""
snap AS (SELECT o_orderkey AS id, o_orderkey % 7 AS e, o_orderstatus AS status, o_totalprice AS total, o_custkey AS cust, o_orderpriority AS priority, items, o_orderkey AS k FROM orders JOIN
  (SELECT l_orderkey, list({'part': l_partkey, 'qty': CAST(l_quantity AS INTEGER)} ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
snap2 AS (SELECT *, id % 29 <> 1 AS has_base, id % 31 <> 2 AS has_cand FROM snap WHERE id % 29 <> 1 OR id % 31 <> 2),
raw_diffs AS (
  SELECT id, 'response' AS path, 'missing-field' AS type, 'critical' AS severity, false AS fixable, 0 AS err FROM snap2 WHERE NOT (has_base AND has_cand)
  UNION ALL SELECT id, 'data.priority', 'missing-field', 'critical', false, 0 FROM snap2 WHERE has_base AND has_cand AND e = 1
  UNION ALL SELECT id, 'data.extra', 'extra-field', 'low', true, 0 FROM snap2 WHERE has_base AND has_cand AND e = 2
  UNION ALL SELECT id, 'data.total', 'type-mismatch', 'critical', false, 0 FROM snap2 WHERE has_base AND has_cand AND e = 3
  UNION ALL SELECT id, 'data.status', 'null-mismatch', 'low', true, 0 FROM snap2 WHERE has_base AND has_cand AND e = 4
  UNION ALL SELECT id, 'data.items', 'array-order', 'low', true, 0 FROM snap2 WHERE has_base AND has_cand AND e = 5 AND items <> list_reverse(items)
  UNION ALL SELECT id, 'data.items', 'array-length', 'low', false, 0 FROM snap2 WHERE has_base AND has_cand AND e = 6
  UNION ALL SELECT id, 'data.status', 'value-change', 'medium', false, 0 FROM snap2 WHERE has_base AND has_cand AND e = 6
  UNION ALL SELECT id, 'errors', 'missing-field', 'critical', false, 1 FROM snap2 WHERE has_base AND has_cand AND id % 11 = 0 AND id % 2 = 1
  UNION ALL SELECT id, 'errors', 'extra-field', 'low', true, 1 FROM snap2 WHERE has_base AND has_cand AND id % 11 = 1),
counts AS (SELECT id, count(*) AS n, count_if(severity = 'critical') AS critical, count_if(severity = 'medium') AS medium, count_if(type IN ('missing-field','type-mismatch')) AS breaking FROM raw_diffs GROUP BY 1),
leafy AS (SELECT *, list_concat(['n:' || id, 's:' || status, 'n:' || total, 'n:' || cust, 's:' || priority], flatten(list_transform(items, lambda i: ['n:' || i.part, 'n:' || i.qty]))) AS lb,
  list_concat(list_filter(['n:' || id, CASE WHEN e <> 4 THEN 's:' || status || CASE WHEN e = 6 THEN 'x' ELSE '' END END, CASE WHEN e = 3 THEN 's:' ELSE 'n:' END || total, 'n:' || cust, CASE WHEN e <> 1 THEN 's:' || priority END], lambda x: x IS NOT NULL),
   list_concat(flatten(list_transform(CASE WHEN e = 5 THEN list_reverse(items) WHEN e = 6 THEN items[1:len(items)-1] ELSE items END, lambda i: ['n:' || i.part, 'n:' || i.qty])), CASE WHEN e = 2 THEN ['s:new'] ELSE [] END)) AS lc,
  '{"id":"number","status":"string","total":"number","cust":"number","priority":"string","items":[{"part":"number","qty":"number"}]}' AS sb FROM snap2),
shaped AS (SELECT *, CASE e WHEN 1 THEN replace(sb, '"priority":"string",', '') WHEN 2 THEN replace(sb, '}]}', '}],"extra":"string"}') WHEN 3 THEN replace(sb, '"total":"number"', '"total":"string"')
   WHEN 4 THEN replace(sb, '"status":"string"', '"status":null') WHEN 6 THEN CASE WHEN len(items) = 1 THEN replace(sb, '[{"part":"number","qty":"number"}]', '[]') ELSE sb END ELSE sb END AS sc,
   list_sum(list_transform(range(1, least(len(lb), len(lc)) + 1), lambda i: CASE WHEN lb[i] = lc[i] THEN 1 ELSE 0 END)) AS same FROM leafy),
shapes AS (SELECT DISTINCT sb, sc FROM shaped),
big AS (SELECT sb, sc, 'b' AS side, unnest(list_transform(range(1, length(sb)), lambda i: substr(sb, i, 2))) AS g FROM shapes
  UNION ALL SELECT sb, sc, 'c', unnest(list_transform(range(1, length(sc)), lambda i: substr(sc, i, 2))) FROM shapes),
dice AS (SELECT sb, sc, 2.0::DOUBLE * sum(least(nb, nc)) / (length(sb) + length(sc) - 2) AS d FROM (SELECT sb, sc, g, count_if(side = 'b') AS nb, count_if(side = 'c') AS nc FROM big GROUP BY 1, 2, 3) GROUP BY 1, 2),
impact AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(critical, 0) AS critical, coalesce(medium, 0) AS medium, coalesce(breaking, 0) AS breaking,
  cust % 90 AS d1, cust % 90 + (id % 5) * 20 AS d2, id % 50 AS s1, id % 40 AS s2 FROM shaped s LEFT JOIN counts USING (id)),
scored AS (SELECT i.id, has_base, has_cand, n = 0 AS identical, CASE WHEN NOT (has_base AND has_cand) THEN 0.0::DOUBLE WHEN n = 0 THEN 1.0::DOUBLE
   ELSE greatest(0.0::DOUBLE, (CASE WHEN e IN (0, 5) AND (e = 0 OR items = list_reverse(items)) THEN 1.0::DOUBLE * 0.7::DOUBLE + 1.0::DOUBLE * 0.3::DOUBLE ELSE d * 0.7::DOUBLE + same::DOUBLE / greatest(len(lb), len(lc)) * 0.3::DOUBLE END) - critical * 0.1::DOUBLE) END AS similarity,
  breaking, medium,
  CASE WHEN NOT (has_base AND has_cand) THEN 0.0::DOUBLE WHEN d1 = 0 THEN CASE WHEN d2 > 0 THEN 'inf'::DOUBLE ELSE 0.0::DOUBLE END ELSE (d2 - d1)::DOUBLE / d1 * 100.0::DOUBLE END AS latency_change,
  CASE WHEN NOT (has_base AND has_cand) THEN 0.0::DOUBLE WHEN s1 = 0 THEN CASE WHEN s2 > 0 THEN 'inf'::DOUBLE ELSE 0.0::DOUBLE END ELSE (s2 - s1)::DOUBLE / s1 * 100.0::DOUBLE END AS size_change
  FROM impact i JOIN dice USING (sb, sc)),
compared AS (SELECT *, CASE WHEN breaking > 0 OR similarity < 0.8 THEN 'unsafe' WHEN abs(latency_change) > 30 OR abs(size_change) > 30 OR medium > 0 THEN 'review' ELSE 'safe' END AS verdict FROM scored)
"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Call events: the key in ``props`` decides success, cents are the latency."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    ok = k % 10 != 0
    return e.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("op"), ok.alias("ok"),
        F.round(F.col("value") * 100).cast("bigint").alias("latency"), k.alias("k"),
        F.when(~ok, F.concat(F.lit("E"), (k % 3).cast("string"))).alias("error"),
    )


CALLS = r"""
calls AS (SELECT event_id, ts, user_id, event_type AS op, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 <> 0 AS ok, CAST(round(value * 100) AS BIGINT) AS latency,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 THEN 'E' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) END AS error FROM events)
"""
