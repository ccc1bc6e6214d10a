"""Operation groups, similarity, closure, reconciliation, variants and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import ACCESS, OPS, access, ops
from tidewright.catalogue.registry import query, table
from tidewright.functions import text as T
from tidewright.operators import grouping as G

_ITEMS = f"""{OPS}, sz AS (SELECT name, kind, count(*) AS variants, count(DISTINCT file_path) AS files FROM ops GROUP BY 1, 2),
 it AS (SELECT name, kind, item, count(*) AS v FROM (SELECT name, kind, unnest(selections) AS item FROM ops) GROUP BY 1, 2, 3),
 gi AS (SELECT it.*, CASE WHEN v = variants THEN 'common' ELSE 'differing' END AS status FROM it JOIN sz USING (name, kind)),
 g AS (SELECT name, kind, variants, files, count_if(status = 'common') AS common, count_if(status = 'differing') AS differing FROM sz JOIN gi USING (name, kind) GROUP BY ALL)"""


@query("group_items", f"WITH {_ITEMS} SELECT name, kind, item, v AS variants, status FROM gi")
def group_items(spark, sf):
    return G.group_items(ops(spark, sf))


@query("group_operations", f"WITH {_ITEMS} SELECT * FROM g")
def group_operations(spark, sf):
    return G.group_operations(ops(spark, sf))


@query("operation_report", f"""WITH {_ITEMS} SELECT CAST(sum(variants) AS BIGINT) AS total, count(*) AS unique_groups, count_if(kind = 'query') AS query_groups, count_if(kind = 'mutation') AS mutation_groups,
 count_if(kind = 'subscription') AS subscription_groups, count_if(variants > 1) AS duplicate_groups, 0::BIGINT AS unnamed_groups, (sum(variants) - count(*))::DOUBLE / sum(variants) AS duplicate_rate FROM g""")
def operation_report(spark, sf):
    return G.operation_report(G.group_operations(ops(spark, sf)))


@query("reference_usage", f"WITH {OPS} SELECT fragment AS reference, count(DISTINCT name) AS usage FROM ops WHERE fragment IS NOT NULL GROUP BY 1")
def reference_usage(spark, sf):
    rows = ops(spark, sf).select("name", T.spread_refs(F.col("content")).alias("refs"))
    return G.reference_usage(rows, "refs")


@query("suggested_names", f"WITH {OPS} SELECT id, 'Get' || array_to_string(list_transform(selections[1:3], lambda s: upper(s[1]) || s[2:]), '') AS suggestion FROM ops WHERE name = ''")
def suggested_names(spark, sf):
    return ops(spark, sf).filter("name = ''").select("id", G.suggested_name(F.col("selections")).alias("suggestion"))


@query("pairwise_overlap", """WITH s AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS item FROM lineitem), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT a, b, common, common::DOUBLE / (na.n + nb.n - common) AS similarity FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b ORDER BY similarity DESC, a, b LIMIT 20""")
def pairwise_overlap(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("l_partkey").alias("items"))
    return G.pairwise_overlap(sets).withColumn("common", F.col("common").cast("bigint"))


@query("group_similar_operations")
def group_similar_operations(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    k = F.col("id")
    sets = (
        li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("p_type").alias("items"))
        .withColumn("kind", F.when(k % 5 == 0, "mutation").when(k % 5 == 1, "subscription").otherwise("query"))
    )
    return G.group_similar(sets)


_EDGES = """e AS (SELECT p_partkey AS src, p_partkey // 10 AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT 0, 3 UNION ALL SELECT p_partkey, p_partkey + 1000000 FROM part WHERE p_partkey % 50 = 0),
 r(root, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT root, dst FROM r JOIN e ON node = src)"""


def _closure(spark, sf):
    k = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    up = k.select(F.col("k").alias("src"), F.when(F.col("k") == 0, F.lit(3)).otherwise(F.floor(F.col("k") / 10)).cast("bigint").alias("dst"))
    far = k.filter("k % 50 = 0").select(F.col("k").alias("src"), (F.col("k") + 1000000).alias("dst"))
    return G.reference_closure(up.unionByName(far), k.select(F.col("k").alias("node"))), k


@query("reference_closure", f"WITH RECURSIVE {_EDGES} SELECT root, node FROM r")
def reference_closure(spark, sf):
    return _closure(spark, sf)[0]


@query("missing_references", f"WITH RECURSIVE {_EDGES} SELECT root, node FROM r WHERE node NOT IN (SELECT p_partkey FROM part)")
def missing_references(spark, sf):
    reach, k = _closure(spark, sf)
    return G.missing_references(reach, k.select(F.col("k").alias("node")))


_FRAGS = ((1, "UrgentFields", "Order", "id ...LowFields"), (2, "HighFields", "Order", "id price"), (3, "MediumFields", "Order", "qty ...HighFields"), (4, "LowFields", "Order", "tax"))


def fragments(spark):
    rows = [(s, n, t, b, f"fragment {n} on {t} {{ {b} }}") for s, n, t, b in _FRAGS]
    return spark.createDataFrame(rows, "seq int, name string, type_name string, body string, content string")


_FRAG_TEXT = {n: f"fragment {n} on {t} {{ {b} }}" for _, n, t, b in _FRAGS}


@query("inline_references_append", f"""WITH {OPS} SELECT id, content || CASE fragment WHEN 'UrgentFields' THEN chr(10) || chr(10) || '{_FRAG_TEXT["UrgentFields"]}' || chr(10) || chr(10) || '{_FRAG_TEXT["LowFields"]}'
 WHEN 'HighFields' THEN chr(10) || chr(10) || '{_FRAG_TEXT["HighFields"]}' WHEN 'MediumFields' THEN chr(10) || chr(10) || '{_FRAG_TEXT["HighFields"]}' || chr(10) || chr(10) || '{_FRAG_TEXT["MediumFields"]}'
 WHEN 'LowFields' THEN chr(10) || chr(10) || '{_FRAG_TEXT["LowFields"]}' ELSE '' END AS content FROM ops""")
def inline_references_append(spark, sf):
    return G.inline_references(ops(spark, sf), fragments(spark))


@query("inline_references_in_place", f"""WITH {OPS} SELECT id, replace(replace(replace(replace(content, '...UrgentFields', '... on Order {{ id ... on Order {{ tax }} }}'), '...MediumFields', '... on Order {{ qty ... on Order {{ id price }} }}'),
 '...HighFields', '... on Order {{ id price }}'), '...LowFields', '... on Order {{ tax }}') AS content FROM ops""")
def inline_references_in_place(spark, sf):
    return G.inline_references(ops(spark, sf), fragments(spark), mode="inline")


def _two_sets(spark, sf):
    o = ops(spark, sf).withColumn("key", F.concat(F.lit("k"), F.col("id").cast("string")))
    k = F.col("id")
    before = o.select("key", "name", "content", "kind")
    after = o.filter(k % 17 != 0).select(
        "key", F.when(k % 19 == 0, F.concat("name", F.lit("X"))).otherwise(F.col("name")).alias("name"),
        F.when(k % 23 == 0, F.concat("content", F.lit(" # more"))).otherwise(F.col("content")).alias("content"),
        F.when(k % 29 == 0, "query").otherwise(F.col("kind")).alias("kind"),
        ((k % 4 == 0) & (k % 8 != 0)).alias("has_interpolation"),
    )
    extra = o.filter(k % 31 == 0).select(F.concat(F.lit("new"), F.col("key")).alias("key"), "name", "content", "kind", F.lit(False).alias("has_interpolation"))
    return before, after.unionByName(extra)


_ISSUES = f"""{OPS}, iss AS (SELECT 'k' || id AS key, 'missing' AS type, 'error' AS severity FROM ops WHERE id % 17 = 0 UNION ALL SELECT 'newk' || id, 'extra', 'warning' FROM ops WHERE id % 31 = 0
 UNION ALL SELECT 'k' || id, 'naming', 'warning' FROM ops WHERE id % 17 <> 0 AND id % 19 = 0 UNION ALL SELECT 'k' || id, 'structural', 'warning' FROM ops WHERE id % 17 <> 0 AND id % 23 = 0
 UNION ALL SELECT 'k' || id, 'kind', 'error' FROM ops WHERE id % 17 <> 0 AND id % 29 = 0 AND kind <> 'query' UNION ALL SELECT 'k' || id, 'interpolation', 'warning' FROM ops WHERE id % 17 <> 0 AND id % 8 = 0)"""


@query("reconcile", f"WITH {_ISSUES} SELECT * FROM iss")
def reconcile(spark, sf):
    return G.reconcile(*_two_sets(spark, sf))


@query("reconcile_status", f"WITH {_ISSUES} SELECT count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, CASE WHEN count_if(severity = 'error') > 0 THEN 'failed' WHEN count_if(severity = 'warning') > 0 THEN 'warning' ELSE 'passed' END AS status FROM iss")
def reconcile_status(spark, sf):
    return G.reconcile_status(G.reconcile(*_two_sets(spark, sf)))


def switches(spark, sf):
    k = F.col("id")
    row = lambda seq, name, *values: F.struct(
        F.lit(seq).alias("seq"), F.lit(name).alias("variable"), (F.array(*[F.lit(v) for v in values]) if values else F.array()).cast("array<string>").alias("choices")
    )
    found = F.array_compact(F.array(
        F.when(k % 4 == 0, row(1, "status", "open", "held", "closed")), F.when(k % 12 == 0, row(2, "queryNames.item", "a", "b")), F.when(k % 20 == 0, row(3, "none")),
    ))
    return ops(spark, sf).select("id", F.inline(found))


_SW = f"""{OPS}, st(s, v1) AS (VALUES (0, 'open'), (1, 'held'), (2, 'closed')), md(m, v2) AS (VALUES (0, 'a'), (1, 'b')),
 variants AS (SELECT id, s AS variant_no, 'status=' || v1 AS condition, replace(content, '${{status}}', v1) AS content, v1 FROM ops, st WHERE id % 4 = 0 AND id % 12 <> 0
 UNION ALL SELECT id, s * 2 + m, 'status=' || v1 || ', queryNames.item=' || v2, replace(replace(content, '${{status}}', v1), '${{queryNames.item}}', v2), v1 FROM ops, st, md WHERE id % 12 = 0)"""


@query("expand_variants", f"WITH {_SW} SELECT id, variant_no, condition, content FROM variants")
def expand_variants(spark, sf):
    return G.expand_variants(ops(spark, sf), switches(spark, sf))


@query("validate_variants", f"WITH {_SW} SELECT CASE WHEN v1 = 'held' THEN 'invalid' ELSE 'valid' END AS status, count(*) AS n FROM variants GROUP BY 1")
def validate_variants(spark, sf):
    v = G.expand_variants(ops(spark, sf), switches(spark, sf))
    fields = v.select("id", "variant_no", F.explode(F.regexp_extract_all("content", F.lit(r"(\w+Extra)\b"), F.lit(1))).alias("field_name"))
    known = spark.createDataFrame([("openExtra",), ("closedExtra",)], "field_name string")
    bad = fields.join(known, "field_name", "left_anti").select("id", "variant_no").distinct().withColumn("_bad", F.lit(True))
    status = F.when(F.col("_bad"), "invalid").otherwise("valid")
    return v.join(bad, ["id", "variant_no"], "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("variant_report", f"WITH {_SW} SELECT count(DISTINCT id) AS ids_with_variants, count(*) AS combinations FROM variants")
def variant_report(spark, sf):
    return G.variant_report(switches(spark, sf))


@query("condition_usage", f"WITH {OPS} SELECT 'status' AS variable, count(*) AS ids, 3 AS choices FROM ops WHERE id % 4 = 0 UNION ALL SELECT 'queryNames.item', count(*), 2 FROM ops WHERE id % 12 = 0 UNION ALL SELECT 'none', count(*), 0 FROM ops WHERE id % 20 = 0")
def condition_usage(spark, sf):
    return G.condition_usage(switches(spark, sf))


@query("shared_fields", f"WITH {ACCESS} SELECT normalized FROM access WHERE entity_type = 'A' INTERSECT SELECT normalized FROM access WHERE entity_type = 'R'")
def shared_fields(spark, sf):
    a = access(spark, sf)
    return a.filter("entity_type = 'A'").select("normalized").intersect(a.filter("entity_type = 'R'").select("normalized"))


@query("lost_fields", f"WITH {ACCESS} SELECT unit, normalized FROM access WHERE access_method = 'direct' EXCEPT SELECT unit, normalized FROM access WHERE access_method = 'pick'")
def lost_fields(spark, sf):
    a = access(spark, sf)
    return a.filter("access_method = 'direct'").select("unit", "normalized").subtract(a.filter("access_method = 'pick'").select("unit", "normalized"))
