"""Rule mining, conformance, catalog choice and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import CATALOG, OPS, catalog, contract_lines, ops, usages
from tidewright.catalogue.registry import query, table
from tidewright.operators import catalog as C


def rules(spark, sf):
    return C.mine_rules(contract_lines(spark, sf)).select(
        "object_type", "field_name", "reason", "replacement", "is_vague", "action"
    )


def typed(df):
    """Usage types spelled as the contract texts spell them."""
    return df.withColumn("type_name", F.initcap(F.lower("type_name")))


@query("mine_rules", f"WITH {CATALOG} SELECT * FROM rules")
def mine_rules(spark, sf):
    return rules(spark, sf)


@query("actionable_rules", f"WITH {CATALOG} SELECT * FROM rules WHERE NOT is_vague")
def actionable_rules(spark, sf):
    return C.actionable(rules(spark, sf))


@query("rename_rules", f"WITH {CATALOG} SELECT object_type, field_name AS old, regexp_extract(reason, 'Use `(\\w+)`', 1) AS new FROM rules WHERE regexp_matches(reason, 'Use `(\\w+)`')")
def rename_rules(spark, sf):
    return C.rename_rules(rules(spark, sf))


@query("rule_summary", f"WITH {CATALOG} SELECT count(*) AS total, count_if(NOT is_vague) AS replaceable, count_if(is_vague) AS vague FROM rules")
def rule_summary(spark, sf):
    return C.rule_summary(rules(spark, sf))


_ALIASES = (("Economy", "Promo"), ("Promo", "Economy"), ("Large", "Medium"))
_RULED = f"""{CATALOG}, al(src, dst) AS (VALUES {', '.join(str(a) for a in _ALIASES)}),
 allr AS (SELECT *, 0 AS p FROM rules UNION ALL SELECT dst, field_name, reason, replacement, is_vague, action, 1 FROM rules JOIN al ON src = object_type),
 ruled AS (SELECT object_type, field_name, min_by(reason, p) AS reason, min_by(replacement, p) FILTER (WHERE true) AS replacement FROM allr GROUP BY 1, 2),
 tu AS (SELECT id, upper(type_name[1]) || lower(type_name[2:]) AS type_name, field_name, id % 2 = 0 AS is_root FROM usages)"""


@query("apply_rule_lookup", f"""WITH {_RULED} SELECT u.id, u.type_name, u.field_name, is_root, coalesce(r.reason, q.reason) AS reason FROM tu u
 LEFT JOIN ruled r ON r.object_type = u.type_name AND r.field_name = u.field_name
 LEFT JOIN ruled q ON q.object_type = 'Standard' AND q.field_name = u.field_name AND is_root""")
def apply_rule_lookup(spark, sf):
    u = typed(usages(spark, sf)).withColumn("is_root", F.col("id") % 2 == 0)
    ruled = C.with_aliases(rules(spark, sf), _ALIASES)
    return C.apply_rule_lookup(u, ruled, root_type="Standard").select("id", "type_name", "field_name", "is_root", "reason")


@query("conformance", f"""WITH {CATALOG} SELECT u.*, CASE WHEN c.field_name IS NULL THEN 'error' WHEN is_deprecated THEN 'warning' ELSE 'ok' END AS status,
 CASE WHEN is_deprecated THEN replacement END AS suggestion FROM usages u LEFT JOIN catalog c USING (type_name, field_name)""")
def conformance(spark, sf):
    return C.conformance(usages(spark, sf), catalog(spark, sf))


@query("unknown_usages", f"WITH {CATALOG} SELECT * FROM usages u WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.type_name = u.type_name AND c.field_name = u.field_name)")
def unknown_usages(spark, sf):
    return C.unknown_usages(usages(spark, sf), catalog(spark, sf))


@query("deprecated_usages", f"""WITH {CATALOG} SELECT u.id, r.object_type AS type_name, u.field_name, reason, replacement FROM usages u
 JOIN rules r ON r.object_type = upper(u.type_name[1]) || lower(u.type_name[2:]) AND r.field_name = u.field_name""")
def deprecated_usages(spark, sf):
    return C.deprecated_usages(typed(usages(spark, sf)), rules(spark, sf))


@query("catalog_diff", f"""WITH {CATALOG}, neu AS (SELECT DISTINCT type_name, field_name FROM part_r WHERE p_size > 5 AND type_name <> 'PROMO')
 SELECT 'TYPE_REMOVED' AS change, type_name, NULL AS field_name FROM (SELECT DISTINCT type_name FROM catalog) WHERE type_name NOT IN (SELECT type_name FROM neu)
 UNION ALL SELECT 'FIELD_REMOVED', type_name, field_name FROM (SELECT type_name, field_name FROM catalog EXCEPT SELECT type_name, field_name FROM neu) WHERE type_name IN (SELECT type_name FROM neu)""")
def catalog_diff(spark, sf):
    new = catalog(spark, sf, (F.col("p_size") > 5) & (F.col("p_type") != "PROMO"))
    return C.catalog_diff(catalog(spark, sf), new)


_PROPS = (("getUserUrgent", "user", "V1"), ("getUserHigh", "user", "V2"), ("getUserLow", "old", "V1"), ("byIdLowV2", "user", "V3"))
_VERSIONS = (("user", "V1", 1, "getUserV1", True), ("user", "V2", 2, "getUserV2", True), ("user", "V3", 3, "getUserV3", False), ("old", "V1", 1, "oldV1", True), ("old", "V2", 2, "oldV2", True))
_MANIFEST = (("user", "V1", "getUserV3", "V1 is gone"), ("old", "V1", "oldV2", "moved"))


@query("recommend_migration", f"""WITH {OPS}, p(name, pattern, version) AS (VALUES {', '.join(str(r) for r in _PROPS)}),
 v(pattern, version, seq, resolved, is_deprecated) AS (VALUES {', '.join(str(r) for r in _VERSIONS)}), m(pattern, version, to_name, reason) AS (VALUES {', '.join(str(r) for r in _MANIFEST)}),
 t AS (SELECT pattern, coalesce(min_by(version, seq) FILTER (WHERE NOT is_deprecated), max_by(version, seq)) AS tv FROM v GROUP BY 1)
 SELECT id, name, resolved, is_deprecated, CASE WHEN is_deprecated THEN tv END AS target_version, coalesce(is_deprecated AND to_name IS NOT NULL, false) AS should_migrate, to_name, reason
 FROM ops LEFT JOIN p USING (name) LEFT JOIN v USING (pattern, version) LEFT JOIN t USING (pattern) LEFT JOIN m USING (pattern, version)""")
def recommend_migration(spark, sf):
    props = spark.createDataFrame(list(_PROPS), "prop string, pattern string, version string")
    versions = spark.createDataFrame(list(_VERSIONS), "pattern string, version string, seq int, name string, is_deprecated boolean")
    manifest = spark.createDataFrame(list(_MANIFEST), "pattern string, version string, to_name string, reason string")
    rows = ops(spark, sf).select("id", F.col("name").alias("prop_name"))
    out = C.recommend_migration(rows, "prop_name", props, versions, manifest)
    return out.select(
        "id", F.col("prop_name").alias("name"), F.col("name").alias("resolved"), "is_deprecated", "target_version",
        "should_migrate", "to_name", "reason",
    )


def catalogs(spark, sf):
    p = table(spark, sf, "part").select("p_type", "p_brand", "p_size")
    s, b = F.col("p_size"), F.col("p_brand")
    from tidewright.catalogue.bindings import _part_field

    names = F.array_compact(F.array(
        F.when(s <= 40, F.struct(F.lit("main").alias("catalog"), F.lit(1).alias("seq"))),
        F.when(s >= 25, F.struct(F.lit("billing").alias("catalog"), F.lit(2).alias("seq"))),
        F.when(b.endswith("1") | b.endswith("2"), F.struct(F.lit("extra").alias("catalog"), F.lit(3).alias("seq"))),
    ))
    return p.select(
        F.inline(names), F.col("p_type").alias("type_name"), _part_field().alias("field_name"), (s % 10 == 0).alias("is_deprecated")
    ).distinct()


_CATS = f"""{CATALOG}, cats AS (SELECT DISTINCT * FROM (SELECT 'main' AS catalog, 1 AS seq, type_name, field_name, p_size % 10 = 0 AS is_deprecated FROM part_f WHERE p_size <= 40
 UNION ALL SELECT 'billing', 2, type_name, field_name, p_size % 10 = 0 FROM part_f WHERE p_size >= 25
 UNION ALL SELECT 'extra', 3, type_name, field_name, p_size % 10 = 0 FROM part_f WHERE base LIKE '%1' OR base LIKE '%2'))"""
_CLASSIFIED = f"""{_CATS}, asked AS (SELECT DISTINCT * FROM usages), tot AS (SELECT id, count(*) AS total FROM asked GROUP BY 1),
 names AS (SELECT DISTINCT catalog, seq FROM cats),
 sc AS (SELECT id, x.catalog, x.seq, total, count(c.field_name) AS valid FROM (SELECT a.*, n.catalog, n.seq, total FROM asked a JOIN tot USING (id), names n) x
   LEFT JOIN cats c ON c.catalog = x.catalog AND c.type_name = x.type_name AND c.field_name = x.field_name GROUP BY id, x.catalog, x.seq, total),
 s2 AS (SELECT *, total - valid AS errors, greatest(0.0::DOUBLE, valid::DOUBLE / total - least((total - valid) * 0.1::DOUBLE, 0.5::DOUBLE)) AS score FROM sc),
 best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) AS rk FROM s2),
 classified AS (SELECT id, catalog, CASE WHEN errors = 0 THEN 1.0::DOUBLE ELSE score END AS confidence, CASE WHEN errors = 0 THEN 'valid' WHEN score > 0.7 THEN 'partial_match' ELSE 'wrong_schema' END AS label FROM best WHERE rk = 1)"""


@query("classify_by_catalog", f"WITH {_CLASSIFIED} SELECT * FROM classified")
def classify_by_catalog(spark, sf):
    return C.classify_by_catalog(usages(spark, sf), catalogs(spark, sf))


@query("classification_report", f"WITH {_CLASSIFIED} SELECT label, catalog, count(*) AS n FROM classified GROUP BY GROUPING SETS ((label), (catalog))")
def classification_report(spark, sf):
    return C.classification_report(C.classify_by_catalog(usages(spark, sf), catalogs(spark, sf)))


@query("confidence_bands", f"""WITH {_CLASSIFIED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM classified)
 SELECT label, count(*) AS n, count_if(confidence > 0.7) AS high, count_if(confidence > 0.4 AND confidence <= 0.7) AS middle, count_if(confidence <= 0.4) AS low,
 string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE k <= 5) AS examples FROM r GROUP BY 1""")
def confidence_bands(spark, sf):
    return C.confidence_bands(C.classify_by_catalog(usages(spark, sf), catalogs(spark, sf)))


_MULTI = f"""{_CATS}, routed AS (SELECT *, CASE WHEN id % 10 = 0 THEN 'extra' WHEN id % 3 = 0 THEN 'billing' ELSE 'main' END AS catalog FROM usages),
 checked AS (SELECT id, r.catalog, type_name, field_name, CASE WHEN c.is_deprecated IS NULL THEN 'error' WHEN c.is_deprecated THEN 'warning' ELSE 'ok' END AS status FROM routed r LEFT JOIN cats c USING (catalog, type_name, field_name))"""


def checked_multi(spark, sf):
    k = F.col("id")
    u = usages(spark, sf).withColumn("forced", F.when(k % 10 == 0, "extra")).withColumn("detected", F.when(k % 3 == 0, "billing"))
    return C.validate_multi(u, catalogs(spark, sf), "main")


@query("validate_multi", f"WITH {_MULTI} SELECT * FROM checked")
def validate_multi(spark, sf):
    return checked_multi(spark, sf)


@query("per_catalog_report", f"""WITH {_MULTI}, p AS (SELECT catalog, id, count_if(status = 'error') AS e, count_if(status = 'warning') AS w FROM checked GROUP BY 1, 2)
 SELECT catalog, count(*) AS total, count_if(e = 0) AS valid, count_if(e > 0) AS invalid, CAST(sum(w) AS BIGINT) AS warnings FROM p GROUP BY ROLLUP (catalog)""")
def per_catalog_report(spark, sf):
    return C.per_catalog_report(checked_multi(spark, sf))


@query("validation_report", f"""WITH {_MULTI}, p AS (SELECT id, count_if(status = 'error') AS e, count_if(status = 'warning') AS w FROM checked GROUP BY 1)
 SELECT count(*) AS total, count_if(e = 0) AS valid, count_if(e > 0) AS invalid, CAST(sum(w) AS BIGINT) AS warnings, count_if(e > 0) > 0 AS exit_failed FROM p""")
def validation_report(spark, sf):
    return C.validation_report(checked_multi(spark, sf))


@query("compare_stages", f"""WITH {_CATS}, b AS (SELECT id, count_if(c.field_name IS NULL) AS e FROM usages LEFT JOIN (SELECT * FROM cats WHERE catalog = 'main') c USING (type_name, field_name) GROUP BY 1),
 a AS (SELECT id, count_if(c.field_name IS NULL) AS e FROM usages LEFT JOIN (SELECT * FROM cats WHERE catalog = 'billing') c USING (type_name, field_name) WHERE id % 3 <> 0 GROUP BY 1)
 SELECT CASE WHEN a.e < b.e THEN 'improved' WHEN a.e > b.e THEN 'degraded' ELSE 'unchanged' END AS change, count(*) AS n FROM a JOIN b USING (id) GROUP BY 1""")
def compare_stages(spark, sf):
    def errors(name, u):
        cat = catalogs(spark, sf).filter(F.col("catalog") == name).withColumn("reason", F.lit(None).cast("string"))
        checked = C.conformance(u, cat)
        return checked.groupBy("id").agg(F.count_if(F.col("status") == "error").alias("errors"))

    u = usages(spark, sf)
    return C.compare_stages(errors("main", u), errors("billing", u.filter("id % 3 <> 0")))


@query("error_frequency", f"""WITH {CATALOG} SELECT split_part('Unknown field ' || type_name || ': ' || field_name, ':', 1) AS error_key, count(*) AS n FROM usages u
 WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.type_name = u.type_name AND c.field_name = u.field_name) GROUP BY 1""")
def error_frequency(spark, sf):
    bad = C.unknown_usages(usages(spark, sf), catalog(spark, sf))
    msg = bad.select(F.concat(F.lit("Unknown field "), "type_name", F.lit(": "), "field_name").alias("message"))
    return C.error_frequency(msg, "message")


@query("readiness_score", f"""WITH {CATALOG}, {OPS}, c AS (SELECT id, count_if(c.field_name IS NULL) AS e FROM usages LEFT JOIN catalog c USING (type_name, field_name) GROUP BY 1),
 a AS (SELECT count(*) AS total, count_if(e = 0) AS valid, count(DISTINCT content) AS uniq, count_if(name <> '') AS named FROM ops JOIN c USING (id))
 SELECT CAST(floor(valid * 100.0::DOUBLE / total * 0.4::DOUBLE + uniq * 100.0::DOUBLE / total * 0.2::DOUBLE + named * 100.0::DOUBLE / total * 0.2::DOUBLE + CASE WHEN valid = total THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END * 0.2::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS readiness FROM a""")
def readiness_score(spark, sf):
    checked = C.conformance(usages(spark, sf), catalog(spark, sf)).groupBy("id").agg(
        F.count_if(F.col("status") == "error").alias("errors")
    )
    agg = ops(spark, sf).join(checked, "id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("errors") == 0).alias("valid"),
        F.countDistinct("content").alias("uniq"), F.count_if(F.col("name") != "").alias("named"),
    )
    t, v = F.col("total"), F.col("valid")
    return agg.select(C.readiness_score(t, v, F.col("uniq"), F.col("named"), v == t).alias("readiness"))
