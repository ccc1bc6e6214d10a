"""Rewriting by rules, scoring, gating and change reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import OPS, ops
from tidewright.catalogue.registry import query, table
from tidewright.functions import text as T
from tidewright.operators import rewrite as W

_RULES = """rule AS (SELECT DISTINCT lower(p_type) || replace(p_brand, '#', '') AS f, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 5 AS n FROM part)"""


def field_rules(spark, sf):
    f = F.concat(F.lower("p_type"), F.replace("p_brand", F.lit("#"), F.lit("")))
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 5
    rows = table(spark, sf, "part").select(f.alias("field_name"), n.alias("n")).distinct().filter("n < 3")
    new = F.when(F.col("n") == 1, F.concat("field_name", F.lit("V2"))).when(F.col("n") == 2, F.concat(F.lit("profile."), "field_name"))
    return rows.select("field_name", new.alias("replacement"), (F.col("n") == 0).alias("is_vague"), F.lit("old").alias("reason"))


def changes(spark, sf):
    used = ops(spark, sf).select("id", F.posexplode("selections").alias("pos", "field_name"))
    ruled = used.join(field_rules(spark, sf), "field_name").withColumn("path", F.concat(F.lit("order."), "field_name"))
    return W.change_rows(ruled)


_CH = f"""{OPS}, {_RULES}, used AS (SELECT id, unnest(selections) AS f, unnest(range(0, len(selections))) AS pos FROM ops),
 ch AS (SELECT id, CAST(pos AS INTEGER) AS pos, f AS old, CASE n WHEN 0 THEN 'comment-out' WHEN 1 THEN 'field-rename' ELSE 'nested-replacement' END AS type, CASE n WHEN 1 THEN f || 'V2' WHEN 2 THEN 'profile.' || f END AS new FROM used JOIN rule USING (f) WHERE n < 3),
 folded AS (SELECT id, string_agg('# DEPRECATED: ' || old || ' - old' || chr(10), '' ORDER BY pos DESC) FILTER (WHERE type = 'comment-out') AS notes, count(*) AS changes FROM ch GROUP BY 1),
 body AS (SELECT id, string_agg(CASE coalesce(n, 9) WHEN 0 THEN '' WHEN 1 THEN '    ' || f || 'V2' || chr(10) WHEN 2 THEN '    profile {{ ' || f || ' }}' || chr(10) ELSE '    ' || f || chr(10) END, '' ORDER BY pos) AS b FROM used LEFT JOIN rule USING (f) GROUP BY 1),
 rewritten AS (SELECT ops.id, content AS original, coalesce(notes, '') || replace(content, array_to_string(list_transform(selections, lambda s: '    ' || s || chr(10)), ''), b) AS transformed, coalesce(changes, 0) AS applied FROM ops JOIN body USING (id) LEFT JOIN folded USING (id))"""


@query("rewrite_changes", f"WITH {_CH} SELECT id, pos, type, old, new FROM ch")
def rewrite_changes(spark, sf):
    return changes(spark, sf).select("id", "pos", "type", "old", "new")


@query("rewrite_operations", f"WITH {_CH} SELECT id, transformed, applied, false AS needs_review FROM rewritten")
def rewrite_operations(spark, sf):
    out = W.rewrite(ops(spark, sf), changes(spark, sf))
    return out.select("id", "transformed", F.col("applied").cast("bigint").alias("applied"), "needs_review")


@query("rewrite_delta", f"WITH {_CH} SELECT type, count(*) AS n, count(DISTINCT id) AS operations FROM ch GROUP BY 1")
def rewrite_delta(spark, sf):
    changed = W.rewrite_delta(W.rewrite(ops(spark, sf), changes(spark, sf))).select("id")
    return changes(spark, sf).join(changed, "id").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("operations"))


@query("rewrite_words", """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\bthe\\b', 'this', 'g'), '\\band\\b', 'plus', 'g')) AS digest FROM documents""")
def rewrite_words(spark, sf):
    text = W.rewrite_words(F.col("text"), (("the", "this"), ("and", "plus")))
    return table(spark, sf, "documents").select("doc_id", F.md5(text).alias("digest"))


_GLOBAL = (("fragment", "Fields", "Parts"), ("directive", "order {", "order @live {"), ("fragment", "LowParts", "LowBits"))


@query("global_replacements", f"""WITH {OPS}, a AS (SELECT id, content, replace(content, 'Fields', 'Parts') AS t1 FROM ops), b AS (SELECT *, replace(t1, 'order {{', 'order @live {{') AS t2 FROM a)
 SELECT id, replace(t2, 'LowParts', 'LowBits') AS text, array_to_string(list_filter([CASE WHEN contains(content, 'Fields') THEN 'fragment:Fields' END, CASE WHEN contains(t1, 'order {{') THEN 'directive:order {{' END, CASE WHEN contains(t2, 'LowParts') THEN 'fragment:LowParts' END], lambda x: x IS NOT NULL), ',') AS changes FROM b""")
def global_replacements(spark, sf):
    text, found = W.global_replacements(F.col("content"), _GLOBAL)
    return ops(spark, sf).select("id", text.alias("text"), F.array_join(found, ",").alias("changes"))


@query("flatten_connection", f"""WITH {OPS} SELECT id, CASE WHEN id % 2 = 0 THEN 'nodes {{ ' || selections[1] || ' }}' ELSE 'edges {{ node {{ ' || selections[1] || ' {{ x }} }} }}' END AS text, id % 2 <> 0 AS left_over FROM ops""")
def flatten_connection(spark, sf):
    s = F.element_at("selections", 1)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("edges { node { "), s, F.lit(" } }"))).otherwise(F.concat(F.lit("edges { node { "), s, F.lit(" { x } } }")))
    rows = ops(spark, sf).select("id", text.alias("raw"))
    return rows.select("id", W.flatten_connection(F.col("raw")).alias("text"), W.connection_left(F.col("raw")).alias("left_over"))


_LABEL = f"""{_CH}, lab AS (SELECT id, CASE WHEN bool_and(type = 'field-rename') THEN 'simple-field-rename' WHEN bool_or(type = 'nested-replacement') THEN 'structure-change' ELSE 'mixed' END AS pattern, count(*) AS changes FROM ch GROUP BY 1)"""


@query("pattern_label", f"WITH {_LABEL} SELECT * FROM lab")
def pattern_label(spark, sf):
    return W.pattern_label(changes(spark, sf))


def scored(spark, sf):
    k = F.col("id")
    tail = F.when(k % 4 == 0, "test/a.js").when(k % 4 == 1, "simple.js").when(k % 4 == 2, "complex.js").otherwise("plain.js")
    c = F.col("content")
    rows = ops(spark, sf).join(W.pattern_label(changes(spark, sf)), "id").select(
        "id", c.alias("source"), F.concat(F.lit("src/"), tail).alias("file_path"), "pattern", "changes",
        F.size(T.spread_refs(c)).alias("fragments"), (k % 3).alias("variables"), T.brace_depth(c).alias("depth"), (F.size("selections") * 4).alias("fields"),
    )
    return W.score_changes(rows)


_SCORE = f"""{_LABEL}, si AS (SELECT id, content AS source, 'src/' || CASE id % 4 WHEN 0 THEN 'test/a.js' WHEN 1 THEN 'simple.js' WHEN 2 THEN 'complex.js' ELSE 'plain.js' END AS file_path, pattern, changes,
  CASE WHEN fragment IS NULL THEN 0 ELSE 1 END AS fragments, id % 3 AS variables, len(selections) * 4 AS fields FROM ops JOIN lab USING (id)),
 sc AS (SELECT *, greatest(0, least(100, 100 - greatest(fields - 20, 0) * 2 - fragments * 8 - variables * 10)) AS cx FROM si),
 sd AS (SELECT *, CASE WHEN changes > 1 THEN greatest(0, cx - (changes - 1) * 15) ELSE cx END AS complexity, CASE WHEN pattern = 'simple-field-rename' THEN 95 ELSE 40 END AS pattern_match,
  CASE id % 4 WHEN 0 THEN 95 WHEN 1 THEN 85 WHEN 2 THEN 60 ELSE 75 END AS coverage, CASE WHEN pattern = 'simple-field-rename' THEN 98 ELSE 50 END AS history FROM sc),
 se AS (SELECT *, CAST(floor(complexity * 0.3::DOUBLE + pattern_match * 0.3::DOUBLE + coverage * 0.2::DOUBLE + history * 0.2::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS score FROM sd),
 scored AS (SELECT *, CASE WHEN score >= 90 THEN 'automatic' WHEN score >= 70 THEN 'semi-automatic' ELSE 'manual' END AS category,
  list_filter([CASE WHEN complexity < 60 THEN 'Complex nested structure' END, CASE WHEN variables > 0 THEN 'Contains variables' END, CASE WHEN complexity < 70 THEN 'High query complexity may lead to performance issues' END,
   CASE WHEN pattern_match < 80 THEN 'Non-standard pattern may require manual verification' END], lambda x: x IS NOT NULL) AS risks FROM se)"""


@query("confidence_score", f"WITH {_SCORE} SELECT id, CAST(complexity AS BIGINT) AS complexity, score, category, score < 90 AS requires_review, array_to_string(risks, '; ') AS risks FROM scored")
def confidence_score(spark, sf):
    return scored(spark, sf).select(
        "id", F.col("complexity").cast("bigint").alias("complexity"), "score", "category", "requires_review", F.array_join("risks", "; ").alias("risks")
    )


@query("confidence_gate", f"WITH {_SCORE} SELECT CASE WHEN score >= 80 THEN 'automatic' WHEN score >= 70 THEN 'semi-automatic' ELSE 'manual' END AS gate, count(*) AS n FROM scored GROUP BY 1")
def confidence_gate(spark, sf):
    return W.gate(scored(spark, sf), 80).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query("migration_run_summary", f"""WITH {_SCORE} SELECT (SELECT count(*) FROM ops) AS operations, count(*) AS rewritten, count(DISTINCT file_path) AS files, sum(score)::DOUBLE / count(*) AS mean_confidence,
 (SELECT string_agg(DISTINCT r, '; ' ORDER BY r) FROM (SELECT unnest(risks) AS r FROM scored)) AS risks FROM scored""")
def migration_run_summary(spark, sf):
    return W.run_summary(ops(spark, sf), scored(spark, sf))


@query("change_impact", f"""WITH {_SCORE}, a AS (SELECT CAST(sum(changes) AS BIGINT) AS changes, count_if(pattern = 'structure-change') AS breaking, CAST(floor(sum(score)::DOUBLE / count(*) + 0.5) AS BIGINT) AS confidence FROM scored)
 SELECT *, CASE WHEN breaking > 0 OR changes > 50 THEN 'high' WHEN changes > 10 THEN 'medium' ELSE 'low' END AS impact FROM a""")
def change_impact(spark, sf):
    return W.change_impact(scored(spark, sf), F.col("pattern") == "structure-change")


@query("migration_impact", "SELECT kind, count(*) AS items, CASE WHEN count(*) > 50 THEN 'high' WHEN count(*) > 20 THEN 'medium' ELSE 'low' END AS impact FROM (SELECT 'op' AS kind, o_orderkey FROM orders) GROUP BY 1")
def migration_impact(spark, sf):
    return W.migration_impact(table(spark, sf, "orders")).select(F.lit("op").alias("kind"), "items", "impact")


_MIG = f"""{OPS}, mg AS (SELECT id, CASE WHEN name LIKE 'byId%' THEN 'Update queryNames object' WHEN fragment IS NOT NULL THEN 'Update query string' ELSE 'No migration needed' END AS action, fragment IS NOT NULL AS needs_review,
 CASE WHEN contains(name, 'V2') THEN 'V2' ELSE 'V1' END AS current_version, CASE WHEN id % 4 = 0 THEN 'V2' ELSE 'V3' END AS target_version, CAST(name LIKE 'byId%' AS INTEGER) AS nc, CAST(fragment IS NOT NULL AS INTEGER) AS fc, CAST(id % 13 = 0 AS INTEGER) AS dc FROM ops)"""


def migrations(spark, sf):
    k, n = F.col("id"), F.col("name")
    frag = F.col("fragment").isNotNull()
    return ops(spark, sf).select(
        "id", F.when(n.startswith("byId"), "Update queryNames object").when(frag, "Update query string").otherwise("No migration needed").alias("action"),
        frag.alias("needs_review"), T.detect_version(n).alias("current_version"), F.when(k % 4 == 0, "V2").otherwise("V3").alias("target_version"),
        n.startswith("byId").cast("int").alias("name_changes"), frag.cast("int").alias("fragment_changes"), (k % 13 == 0).cast("int").alias("directive_changes"),
    )


@query("migration_summary", f"""WITH {_MIG} SELECT count(*) AS total, count_if(action <> 'No migration needed') AS needs_migration, count_if(needs_review) AS manual_review, count_if(action = 'Update queryNames object') AS pattern_based,
 count_if(action = 'Update query string') AS static, CAST(sum(nc) AS BIGINT) AS name_changes, CAST(sum(fc) AS BIGINT) AS fragment_changes, CAST(sum(dc) AS BIGINT) AS directive_changes FROM mg""")
def migration_summary(spark, sf):
    return W.migration_summary(migrations(spark, sf))


@query("version_progression", f"WITH {_MIG} SELECT current_version, target_version, count(*) AS n FROM mg WHERE action = 'Update queryNames object' AND current_version <> target_version GROUP BY 1, 2")
def version_progression(spark, sf):
    return W.version_progression(migrations(spark, sf))


@query("name_map_updates", "SELECT p_partkey AS prop, p_name AS name, coalesce(x.new_name, p_name) AS updated, x.new_name IS NOT NULL AS changed FROM part LEFT JOIN (SELECT l_partkey, min_by('n' || l_orderkey, l_orderkey) AS new_name FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) x ON l_partkey = p_partkey")
def name_map_updates(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("prop"), F.col("p_name").alias("name"))
    ch = table(spark, sf, "lineitem").filter("l_discount > 0.09").select(
        F.col("l_partkey").alias("prop"), F.col("l_orderkey").alias("seq"), F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("new_name")
    )
    return W.name_map_updates(names, ch)


_BEFORE = f"""{_CH}, af AS (SELECT used.id, pos, CASE coalesce(n, 9) WHEN 1 THEN f || 'V2' WHEN 2 THEN 'profile' ELSE f END AS g FROM used LEFT JOIN rule USING (f) WHERE coalesce(n, 9) <> 0),
 nf AS (SELECT id, list_distinct(list(g)) AS gs FROM af GROUP BY 1), bf AS (SELECT id, selections AS fs, coalesce(gs, []) AS gs FROM ops LEFT JOIN nf USING (id)),
 lost AS (SELECT id, unnest(list_filter(fs, lambda f: NOT list_contains(gs, f))) AS field, gs FROM bf)"""


def _fields_after(spark, sf):
    used = ops(spark, sf).select("id", "selections", F.explode("selections").alias("field_name")).join(field_rules(spark, sf), "field_name", "left")
    new = F.when(F.col("is_vague"), None).when(F.col("replacement").contains("."), "profile").otherwise(F.coalesce("replacement", "field_name"))
    return used.groupBy("id", F.col("selections").alias("old_fields")).agg(F.collect_set(new).alias("new_fields"))


@query("rename_candidates", f"WITH {_BEFORE} SELECT id, field, list_filter(list_sort(gs), lambda g: contains(lower(g), lower(field)) OR contains(lower(field), lower(g)))[1] AS candidate FROM lost WHERE len(list_filter(gs, lambda g: contains(lower(g), lower(field)) OR contains(lower(field), lower(g)))) > 0")
def rename_candidates(spark, sf):
    b = _fields_after(spark, sf)
    missing = b.select("id", F.explode(F.array_except("old_fields", "new_fields")).alias("field"))
    added = b.select("id", F.posexplode(F.sort_array("new_fields")).alias("seq", "field"))
    return W.rename_candidates(missing, added)


@query("semantic_check", f"""WITH {_BEFORE} SELECT id, CASE WHEN len(list_filter(gs, lambda g: contains(lower(g), lower(field)) OR contains(lower(field), lower(g)))) > 0 THEN 'warning' ELSE 'error' END AS level,
 CASE WHEN len(list_filter(gs, lambda g: contains(lower(g), lower(field)) OR contains(lower(field), lower(g)))) > 0 THEN 'renamed' ELSE 'missing' END AS what, field FROM lost
 UNION ALL SELECT id, 'warning', 'added', unnest(list_filter(gs, lambda g: NOT list_contains(fs, g))) FROM bf
 UNION ALL SELECT id, 'incompatible', 'shallower', '' FROM ops WHERE id % 6 = 0 UNION ALL SELECT id, 'error', 'missing-variable', '' FROM ops WHERE id % 5 = 0 UNION ALL SELECT id, 'error', 'kind changed', '' FROM ops WHERE kind = 'subscription'
 UNION ALL SELECT id, 'warning', 'connection removed', '' FROM ops WHERE id % 10 = 0 UNION ALL SELECT id, 'warning', 'nodes added', '' FROM ops WHERE id % 10 = 0""")
def semantic_check(spark, sf):
    k = F.col("id")
    o = ops(spark, sf).select(
        "id", F.lit(3).alias("old_depth"), F.when(k % 6 == 0, 2).otherwise(3).alias("new_depth"),
        F.when(k % 10 == 0, "edges { node }").otherwise("x").alias("old"), F.when(k % 10 == 0, "nodes { }").otherwise("x").alias("new"),
        F.array(F.lit("id")).alias("old_vars"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("id"))).alias("new_vars"),
        F.col("kind").alias("old_kind"), F.when(F.col("kind") == "subscription", "query").otherwise(F.col("kind")).alias("new_kind"),
    )
    return W.semantic_check(_fields_after(spark, sf).join(o, "id"))


@query("semantic_check_texts", """WITH t AS (SELECT DISTINCT l_orderkey AS id, lower(p_type) AS f FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT DISTINCT id FROM t)
 SELECT id, 'warning' AS level, 'field-rename' AS what, CASE f WHEN 'economy' THEN 'order.economy > order.economyPrice' ELSE 'order.large > order.huge' END AS field FROM t WHERE f IN ('economy', 'large')
 UNION ALL SELECT id, 'error', 'missing-field', 'order.promo' FROM t WHERE f = 'promo' AND id % 2 = 0 UNION ALL SELECT id, 'warning', 'added', 'order.extra' FROM o WHERE id % 3 = 0
 UNION ALL SELECT id, 'error', 'missing-variable', 'b' FROM o WHERE id % 5 = 0 UNION ALL SELECT id, 'warning', 'missing-directive', 'live' FROM o WHERE id % 7 = 0""")
def semantic_check_texts(spark, sf):
    """Texts whose selections are the part types of an order, and the same after a rewrite."""
    li, p = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("f"))
    kinds = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("f")).alias("kinds"))
    i = F.col("id")
    kept = F.filter("kinds", lambda f: (f != "promo") | (i % 2 != 0))
    named = F.transform(kept, lambda f: F.when(f == "economy", "economyPrice").when(f == "large", "huge").otherwise(f))

    def text(names, second, live, more):
        head = F.when(second, 'query Q($a: Int, $b: Int = 1) { order(id: $a, n: $b, text: "$c: @no {") { ').otherwise("query Q($a: Int) { order(id: $a) { ")
        return F.concat(head, F.array_join(names, " "), F.when(live, " status @live").otherwise(" status"), F.when(more, " extra").otherwise(""), F.lit(" } } # { @not $d: "))

    yes, no = F.lit(True), F.lit(False)
    pairs = kinds.select("id", text(F.col("kinds"), yes, yes, no).alias("old"), text(named, i % 5 != 0, i % 7 != 0, i % 3 == 0).alias("new"))
    return W.semantic_check_texts(pairs, "id", "old", "new", known=(("large", "huge"),))


@query("rule_impact", f"WITH {_CH} SELECT id, old AS field, CASE type WHEN 'field-rename' THEN 'field-removal' ELSE 'schema-mismatch' END AS change, CASE type WHEN 'field-rename' THEN 'low' ELSE 'medium' END AS impact FROM ch WHERE type <> 'comment-out'")
def rule_impact(spark, sf):
    return W.rule_impact(changes(spark, sf))


@query("required_arguments", """SELECT l_orderkey AS id, p_brand AS field, 'required-argument' AS change, 'high' AS impact FROM lineitem JOIN part ON l_partkey = p_partkey
 WHERE l_linenumber % 2 = 0 AND (p_type, p_brand) IN (SELECT (p_type, p_brand) FROM part WHERE p_size > 45)""")
def required_arguments(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    cat = p.groupBy(F.col("p_type").alias("type_name"), F.col("p_brand").alias("field_name")).agg(F.bool_or(F.col("p_size") > 45).alias("requires_argument"))
    used = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("id"), F.col("p_type").alias("type_name"), F.col("p_brand").alias("field_name"), (F.col("l_linenumber") % 2 == 1).alias("had_argument")
    )
    return W.required_arguments(used, cat)
