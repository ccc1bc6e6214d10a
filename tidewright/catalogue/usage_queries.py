"""Field-usage analytics on the access fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import ACCESS, PREFIX_MAP, access
from tidewright.catalogue.registry import query
from tidewright.functions.rules import HEAD_CATEGORIES, categorize, has_prefix, infer_dtype, subcategory
from tidewright.operators import usage


def _case(col, rules, default):
    arms = []
    for label, kind, words in rules:
        tests = []
        for w in words:
            tests.append(f"split_part({col}, '.', 1) = '{w}'" if kind == "head" else f"contains({col}, '{w}')")
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{label}'")
    return f"CASE {' '.join(arms)} ELSE '{default}' END"


def category():
    return categorize(F.col("normalized"), HEAD_CATEGORIES)


CATEGORY_SQL = _case("normalized", HEAD_CATEGORIES, "Other")
DTYPE_SQL = """CASE
 WHEN contains(normalized,'Count') OR contains(normalized,'total') OR contains(normalized,'number') THEN 'number'
 WHEN regexp_matches(normalized,'Date|date|Time|time') THEN 'datetime'
 WHEN regexp_matches(normalized,'is|has|Enabled|Connected|Published') THEN 'boolean'
 WHEN regexp_matches(normalized,'Status|status|Type|type') THEN 'enum'
 WHEN regexp_matches(normalized,'Id|id|ID') THEN 'identifier'
 WHEN regexp_matches(normalized,'widgets|data|intentions') THEN 'array/object' ELSE 'string' END"""
SUB_SQL = "CASE WHEN split_part(normalized,'.',1) IN ('account','entity','email','social') THEN split_part(normalized,'.',1) WHEN split_part(normalized,'.',1) IN ('billing','payment') THEN 'billing' WHEN split_part(normalized,'.',1) NOT IN ('entitlements','website','commerce','appointments','customer','links','context') THEN 'uncategorized' WHEN contains(normalized,'.') THEN split_part(normalized,'.',2) ELSE 'general' END"


@query("usage_report", f"""WITH {ACCESS},
 c AS (SELECT normalized, count(*) AS uses FROM access GROUP BY 1),
 e AS (SELECT entity_type, normalized, count(*) AS uses FROM access GROUP BY 1, 2)
SELECT 'top_fields' AS section, '' AS grp, normalized AS item, uses FROM (SELECT * FROM c ORDER BY uses DESC, normalized LIMIT 20)
UNION ALL SELECT 'entity_fields', entity_type, normalized, uses FROM
 (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY uses DESC, normalized) AS rk FROM e) WHERE rk <= 10
UNION ALL SELECT 'access_methods', '', access_method, count(*) FROM access GROUP BY access_method
UNION ALL SELECT 'variations', '', normalized, count(DISTINCT field) FROM access GROUP BY normalized""")
def usage_report(spark, sf):
    return usage.usage_report(access(spark, sf))


@query("usage_top_fields", f"""WITH {ACCESS} SELECT normalized, count(*) AS uses FROM access GROUP BY 1
ORDER BY uses DESC, normalized LIMIT 20""")
def usage_top_fields(spark, sf):
    return usage.top_fields(access(spark, sf))


@query("usage_top_fields_per_entity", f"""WITH {ACCESS}, e AS (SELECT entity_type, normalized, count(*) AS uses FROM access GROUP BY 1, 2)
SELECT entity_type, normalized, uses, CAST(rk AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY uses DESC, normalized) AS rk FROM e) WHERE rk <= 10""")
def usage_top_fields_per_entity(spark, sf):
    return usage.top_fields_per_entity(access(spark, sf))


@query("usage_variations", f"""WITH {ACCESS} SELECT normalized, count(DISTINCT field) AS variation_count,
string_agg(DISTINCT field, ',' ORDER BY field) AS spellings FROM access
WHERE {' OR '.join(f"starts_with(field, '{old}')" for old, _ in PREFIX_MAP)} GROUP BY 1""")
def usage_variations(spark, sf):
    return usage.variations(access(spark, sf), has_prefix(F.col("field"), PREFIX_MAP))


@query("category_report", f"""WITH {ACCESS}, c AS (SELECT normalized, count(*) AS uses FROM access GROUP BY 1),
r AS (SELECT *, {CATEGORY_SQL} AS category FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY uses DESC, normalized) AS rk FROM r)
SELECT category, count(*) AS fields, CAST(sum(uses) AS BIGINT) AS total_uses, round(sum(uses) / count(*), 6) AS mean_uses,
 string_agg(normalized, ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS top_fields FROM k GROUP BY 1""")
def category_report(spark, sf):
    return usage.category_report(access(spark, sf), category())


@query("usage_pivot", f"""WITH {ACCESS} SELECT normalized, count(*) AS total,
 coalesce(CAST(nullif(count_if(entity_type = 'A'), 0) AS VARCHAR), '-') AS n_a,
 coalesce(CAST(nullif(count_if(entity_type = 'N'), 0) AS VARCHAR), '-') AS n_n,
 coalesce(CAST(nullif(count_if(entity_type = 'R'), 0) AS VARCHAR), '-') AS n_r
 FROM access GROUP BY 1 ORDER BY total DESC, normalized LIMIT 30""")
def usage_pivot(spark, sf):
    return usage.usage_pivot(access(spark, sf), ["A", "N", "R"])


@query("access_share", f"""WITH {ACCESS}, c AS (SELECT normalized, count(*) AS uses FROM access GROUP BY 1)
SELECT {CATEGORY_SQL} AS category, normalized, uses, round(uses * 100.0::DOUBLE / (SELECT sum(uses) FROM c), 4) AS share_pct FROM c""")
def access_share(spark, sf):
    return usage.access_share(access(spark, sf), category())


@query("data_dictionary", f"""WITH {ACCESS} SELECT normalized, {CATEGORY_SQL} AS category, count(DISTINCT unit) AS used_by,
 string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS entities,
 string_agg(DISTINCT access_method, ',' ORDER BY access_method) AS methods,
 count(DISTINCT field) > 1 AS has_variations FROM access GROUP BY normalized""")
def data_dictionary(spark, sf):
    return usage.data_dictionary(access(spark, sf), category())


@query("dictionary_users", f"WITH {ACCESS} SELECT DISTINCT normalized, unit FROM access")
def dictionary_users(spark, sf):
    return usage.dictionary_users(access(spark, sf))


@query("unique_fields", f"""WITH {ACCESS} SELECT normalized, {CATEGORY_SQL} AS category, {SUB_SQL} AS subcategory, {DTYPE_SQL} AS dtype,
 count(DISTINCT unit) AS units, count(DISTINCT field) AS variation_count,
 array_to_string(list_sort(list_distinct(list(field)))[1:3], ',') AS examples,
 string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS entities
 FROM access GROUP BY normalized ORDER BY units DESC, normalized LIMIT 20""")
def unique_fields(spark, sf):
    n = F.col("normalized")
    return usage.unique_fields(access(spark, sf), category(), subcategory(n, category()), infer_dtype(n))


@query("usage_bands", f"""WITH {ACCESS}, u AS (SELECT normalized, count(DISTINCT unit) AS units FROM access GROUP BY 1)
SELECT CASE WHEN units >= 20 THEN '20+' WHEN units >= 10 THEN '10-19' WHEN units >= 5 THEN '5-9' WHEN units >= 2 THEN '2-4' ELSE '1' END AS band,
 count(*) AS fields FROM u GROUP BY 1""")
def usage_bands(spark, sf):
    return usage.usage_bands(access(spark, sf))


@query("field_flags", f"""WITH {ACCESS}, u AS (SELECT normalized, count(DISTINCT unit) AS units, count(DISTINCT field) AS spellings FROM access GROUP BY 1),
n AS (SELECT count(DISTINCT unit) AS all_units FROM access)
SELECT normalized, units, spellings, units > all_units * 0.5 AS critical, units >= 10 AS shared, units = 1 AS rare, spellings > 2 AS inconsistent FROM u, n""")
def field_flags(spark, sf):
    return usage.field_flags(access(spark, sf))


@query("most_inconsistent_fields", f"""WITH {ACCESS} SELECT normalized, count(DISTINCT field) AS variation_count,
string_agg(DISTINCT field, ',' ORDER BY field) AS spellings FROM access GROUP BY 1 HAVING count(DISTINCT field) > 2
ORDER BY variation_count DESC, normalized LIMIT 5""")
def most_inconsistent_fields(spark, sf):
    return usage.most_inconsistent(access(spark, sf), spread=2)


_PATTERNS = (
    ("Basic", ("billing.brand_3", "billing.brand_4")),
    ("Mail", ("email.offer", "account.entry")),
    ("Wide", ("standard.brand_1", "medium.brand_7", "billing.brand_5")),
)
_PATTERN_ROWS = [(name, field) for name, fields in _PATTERNS for field in fields]


@query("match_patterns", f"""WITH {ACCESS}, p(pattern, field) AS (VALUES {', '.join(str(r) for r in _PATTERN_ROWS)})
SELECT pattern, unit FROM (SELECT DISTINCT unit, normalized FROM access) a JOIN p ON p.field = a.normalized
GROUP BY pattern, unit HAVING count(*) = (SELECT count(*) FROM p q WHERE q.pattern = p.pattern)""")
def match_patterns(spark, sf):
    patterns = spark.createDataFrame(_PATTERN_ROWS, "pattern string, field string")
    return usage.match_patterns(access(spark, sf), patterns)


@query("relationship_edges", """WITH l AS (SELECT l_orderkey, list(n_name ORDER BY l_linenumber, l_suppkey, l_partkey) AS ents
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
e AS (SELECT unnest(list_zip(ents[1:len(ents)-1], ents[2:])) AS z FROM l WHERE len(ents) > 1)
SELECT z[1] AS src, z[2] AS dst, count(*) AS weight FROM e GROUP BY 1, 2""")
def relationship_edges(spark, sf):
    from tidewright.catalogue.registry import table

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    lists = rows.groupBy("l_orderkey").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "n_name"))),
            lambda r: r["n_name"],
        ).alias("ents")
    )
    return usage.relationship_edges(lists, "l_orderkey", "ents")
