"""Rule-driven rewriting of operation texts, scoring and change reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import json_trees, selections
from tidewright.functions import text as T
from tidewright.operators import extraction as X

# Score weights, pattern scores, history rates and path scores.
WEIGHTS = (("complexity", 0.3), ("pattern_match", 0.3), ("coverage", 0.2), ("history", 0.2))
HIGH_PATTERNS = ("simple-field-rename", "field-rename", "root-query-migration", "connection-to-array", "deprecated-field-removal")
HISTORY = (
    ("simple-field-rename", 98), ("field-rename", 98), ("root-query-migration", 90), ("connection-to-array", 85),
    ("deprecated-field-removal", 95), ("type-change", 75), ("multiple-changes", 85), ("complex-restructure", 35),
    ("custom", 50), ("no-op", 100), ("empty", 100),
)
NESTED_WORDS = (("profile", "settings"), ("criticalData", "sensitiveField"), ("posts", "edges", "node"))
RISK_WORDS = (("profile", "settings"), ("criticalData", "sensitiveField"), ("notifications", "settings"))
PATH_SCORES = (
    (("test", "spec"), 95), (("empty",), 100), (("simple", "user.js"), 85), (("complex",), 60),
)


def _word(col: Column) -> Column:
    return F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), col, F.lit(r"\E(?![A-Za-z0-9_])"))


def change_rows(usages: DataFrame) -> DataFrame:
    """Change per ruled usage: comment-out, nested-replacement or field-rename.

    ``usages`` carries id, field_name, path, pos and the looked-up rule columns.
    """
    kind = (
        F.when(F.col("is_vague"), "comment-out")
        .when(F.col("replacement").contains("."), "nested-replacement")
        .when(F.col("replacement").isNotNull(), "field-rename")
    )
    rows = usages.withColumn("type", kind).filter("type IS NOT NULL")
    at = ["at"] if "at" in usages.columns else []
    return rows.select("id", "pos", *at, "path", "type", F.col("field_name").alias("old"), F.col("replacement").alias("new"), "reason")


def nested_selection(path: Column) -> Column:
    """``a.b.c`` as ``a { b { c } }``."""
    parts = F.split(path, r"\.")
    return F.concat(F.array_join(parts, " { "), F.repeat(F.lit(" }"), F.size(parts) - 1))


def rewrite(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """Folds each operation's changes over its text in text order.

    Fields under an alias or inside a string are left alone and flagged
    ``needs_review``.
    """
    per_op = changes.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "type", "old", "new", "reason"))).alias("_c")
    )
    joined = ops.select("id", F.col("content").alias("original")).join(per_op, "id", "left")
    text = F.col("original")

    def unclear(c):
        return F.rlike(text, F.concat(F.lit(r"(:\s*|\"[^\"\n]*)"), _word(c["old"])))

    safe = F.filter(F.coalesce(F.col("_c"), F.array().cast(changes_type())), lambda c: ~unclear(c))

    def step(acc, c):
        note = F.concat(F.lit("# DEPRECATED: "), c["old"], F.lit(" - "), F.coalesce(c["reason"], F.lit("Deprecated field")), F.lit("\n"))
        line = F.concat(F.lit(r"(?m)^[ \t]*"), _word(c["old"]), F.lit(r"[ \t]*(\n|\z)"))
        dropped = F.concat(note, F.regexp_replace(acc, line, F.lit("")))
        value = F.when(c["type"] == "nested-replacement", nested_selection(c["new"])).otherwise(c["new"])
        return F.when(c["type"] == "comment-out", dropped).otherwise(F.regexp_replace(acc, _word(c["old"]), F.coalesce(value, F.lit(""))))

    return joined.withColumn("_safe", safe).select(
        "id", "original", F.aggregate("_safe", text, step).alias("transformed"),
        F.size("_safe").alias("applied"), (F.size(F.coalesce(F.col("_c"), F.array().cast(changes_type()))) > F.size("_safe")).alias("needs_review"),
    )


def rewrite_at(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """Edits each operation's text at the offsets (``at``) of its changed fields and nowhere else.

    Changes come from :func:`change_rows` over typed usages, so a name in an operation's name, a variable, an argument, a comment or
    under another type stays. Edits go from the last offset to the first. A field to be commented out goes with its line and leaves a
    note on top; if it shares its line it stays and the operation is flagged ``needs_review``.
    """
    per_op = changes.groupBy("id").agg(F.reverse(F.sort_array(F.collect_list(F.struct("at", "type", "old", "new", "reason")))).alias("_c"))
    joined = ops.select("id", F.col("content").alias("original")).join(per_op, "id", "left")
    state = lambda text, notes, left: F.struct(text.alias("text"), notes.alias("notes"), left.alias("left"))

    def step(acc, c):
        head, tail = F.substring(acc["text"], F.lit(1), c["at"]), F.substring(acc["text"], c["at"] + F.length(c["old"]) + 1, F.length(acc["text"]))
        value = F.when(c["type"] == "nested-replacement", nested_selection(c["new"])).otherwise(c["new"])
        own_line = head.rlike(r"(\A|\n)[ \t]*\z") & tail.rlike(r"\A[ \t]*(\n|\z)")
        note = F.concat(F.lit("# DEPRECATED: "), c["old"], F.lit(" - "), F.coalesce(c["reason"], F.lit("Deprecated field")), F.lit("\n"))
        dropped = F.concat(F.regexp_replace(head, r"[ \t]*\z", ""), F.regexp_replace(tail, r"\A[ \t]*\n?", ""))
        renamed = state(F.concat(head, F.coalesce(value, F.lit("")), tail), acc["notes"], acc["left"])
        gone = state(dropped, F.concat(note, acc["notes"]), acc["left"])
        kept = state(acc["text"], acc["notes"], acc["left"] + 1)
        return F.when(c["type"] != "comment-out", renamed).when(own_line, gone).otherwise(kept)

    none = F.array().cast("array<struct<at:int,type:string,old:string,new:string,reason:string>>")
    edits = F.coalesce(F.col("_c"), none)
    folded = joined.withColumn("_r", F.aggregate(edits, state(F.col("original"), F.lit(""), F.lit(0)), step))
    return folded.select(
        "id", "original", F.concat("_r.notes", "_r.text").alias("transformed"), (F.size(edits) - F.col("_r.left")).alias("applied"),
        (F.col("_r.left") > 0).alias("needs_review"))


def changes_type() -> str:
    return "array<struct<pos:int,type:string,old:string,new:string,reason:string>>"


def rewrite_words(content: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``\\bfield\\b`` -> replacement, in rule order."""
    step = lambda acc, r: F.regexp_replace(acc, rf"(?<![A-Za-z0-9_])\Q{r[0]}\E(?![A-Za-z0-9_])", r[1].replace("$", r"\$"))
    return reduce(step, rules, content)


def global_replacements(content: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(text, changes): each ``(type, from, to)`` found is replaced, in order."""
    changes, text = [], content
    for kind, old, new in rules:
        hit = text.contains(old)
        changes.append(F.when(hit, F.concat_ws(":", F.lit(kind), F.lit(old))))
        text = F.when(hit, F.replace(text, F.lit(old), F.lit(new))).otherwise(text)
    return text, F.array_compact(F.array(*changes))


def flatten_connection(content: Column) -> Column:
    """``edges { node { … } }`` -> ``nodes { … }`` for one-level node bodies."""
    return F.regexp_replace(content, r"edges\s*\{\s*node\s*\{([^{}]*)\}\s*\}", "nodes {$1}")


def connection_left(content: Column) -> Column:
    return flatten_connection(content).rlike(r"\bedges\s*\{")


def pattern_label(changes: DataFrame) -> DataFrame:
    structural = F.col("type").isin("nested-replacement", "structure-change")
    label = (
        F.when(F.bool_and(F.col("type") == "field-rename"), "simple-field-rename")
        .when(F.bool_or(structural), "structure-change").otherwise("mixed")
    )
    return changes.groupBy("id").agg(label.alias("pattern"), F.count(F.lit(1)).alias("changes"))


def _all_words(source: Column, sets) -> Column:
    return reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [source.contains(w) for w in s]) for s in sets])


def score_changes(df: DataFrame) -> DataFrame:
    """Confidence of a rewrite: adds factors, score, category and risks.

    Uses source, file_path, pattern, changes, fragments, variables, depth, fields.
    """
    c = F.col
    source = F.coalesce(c("source"), F.lit(""))
    base = F.when(_all_words(source, NESTED_WORDS), 70).otherwise(100)
    raw = (
        base - F.greatest(c("depth") - 5, F.lit(0)) * 10 - F.greatest(c("fields") - 20, F.lit(0)) * 2
        - c("fragments") * 8 - c("variables") * 10
    )
    simple = F.when(F.trim(source) == "", 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw)))
    complexity = F.when(c("changes") > 1, F.greatest(F.lit(0), simple - (c("changes") - 1) * 15)).otherwise(simple)
    p = c("pattern")
    match = (
        F.when((p == "no-op") | (c("changes") == 0), 100).when(p.isin(*HIGH_PATTERNS), 95)
        .when(p.contains("type-change") | p.contains("multiple-changes"), 80)
        .when(p.contains("custom") | p.contains("complex"), 35).otherwise(40)
    )
    coverage = F.lit(75)
    for words, points in reversed(PATH_SCORES):
        coverage = F.when(reduce(lambda a, b: a | b, [c("file_path").contains(w) for w in words]), points).otherwise(coverage)
    history = F.lit(50)
    for name, rate in HISTORY:
        history = F.when(p == name, rate).otherwise(history)
    out = df.withColumns({"complexity": complexity, "pattern_match": match, "coverage": coverage, "history": history})
    total = reduce(lambda a, b: a + b, [c(n) * w for n, w in WEIGHTS])
    out = out.withColumn("score", F.floor(total + 0.5))
    nested = _all_words(source, RISK_WORDS) | (c("complexity") < 60)
    risks = (
        (p.contains("custom"), "Custom transformation logic"),
        (nested, "Complex nested structure"),
        (c("variables") > 0, "Contains variables"),
        (c("complexity") < 70, "High query complexity may lead to performance issues"),
        (c("coverage") < 60, "Low test coverage increases risk of undetected issues"),
        (c("pattern_match") < 80, "Non-standard pattern may require manual verification"),
        (c("fragments") > 5, "Multiple fragments increase transformation complexity"),
    )
    return out.withColumns({
        "category": F.when(c("score") >= 90, "automatic").when(c("score") >= 70, "semi-automatic").otherwise("manual"),
        "requires_review": c("score") < 90,
        "risks": F.array_compact(F.array(*[F.when(t, r) for t, r in risks])),
    })


def gate(scored: DataFrame, minimum: int = 90) -> DataFrame:
    """Changed rows only: automatic, semi-automatic or manual by score."""
    label = F.when(F.col("score") >= minimum, "automatic").when(F.col("score") >= 70, "semi-automatic").otherwise("manual")
    return scored.withColumn("gate", label)


def rewrite_delta(rewritten: DataFrame) -> DataFrame:
    return rewritten.filter(F.col("original") != F.col("transformed"))


def run_summary(ops: DataFrame, scored: DataFrame) -> DataFrame:
    totals = ops.agg(F.count(F.lit(1)).alias("operations"))
    done = scored.agg(
        F.count(F.lit(1)).alias("rewritten"), F.countDistinct("file_path").alias("files"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_confidence"),
    )
    risks = scored.select(F.explode("risks").alias("r")).distinct().agg(F.array_join(F.sort_array(F.collect_list("r")), "; ").alias("risks"))
    return totals.join(done, how="inner").join(risks, how="inner")


def change_impact(scored: DataFrame, breaking: Column) -> DataFrame:
    agg = scored.agg(
        F.sum("changes").alias("changes"), F.sum(F.when(breaking, 1).otherwise(0)).alias("breaking"),
        F.floor(F.avg("score") + 0.5).alias("confidence"),
    )
    impact = F.when((F.col("breaking") > 0) | (F.col("changes") > 50), "high").when(F.col("changes") > 10, "medium").otherwise("low")
    return agg.withColumn("impact", impact)


def migration_impact(ops: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return ops.agg(n.alias("items"), F.when(n > 50, "high").when(n > 20, "medium").otherwise("low").alias("impact"))


def migration_summary(df: DataFrame) -> DataFrame:
    """``action, needs_review, current_version, target_version, change types``."""
    c = F.col
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c("action") != "No migration needed").alias("needs_migration"),
        F.count_if("needs_review").alias("manual_review"),
        F.count_if(c("action") == "Update queryNames object").alias("pattern_based"),
        F.count_if(c("action") == "Update query string").alias("static"),
        F.sum("name_changes").alias("name_changes"), F.sum("fragment_changes").alias("fragment_changes"),
        F.sum("directive_changes").alias("directive_changes"),
    )


def version_progression(df: DataFrame) -> DataFrame:
    moved = df.filter((F.col("action") == "Update queryNames object") & (F.col("current_version") != F.col("target_version")))
    return moved.groupBy("current_version", "target_version").agg(F.count(F.lit(1)).alias("n"))


def name_map_updates(names: DataFrame, changes: DataFrame) -> DataFrame:
    """Current and updated name per property; the first change per property wins."""
    first = changes.groupBy("prop").agg(F.min_by("new_name", "seq").alias("_new"))
    out = names.join(first, "prop", "left")
    return out.select("prop", "name", F.coalesce("_new", "name").alias("updated"), F.col("_new").isNotNull().alias("changed"))


def rename_candidates(missing: DataFrame, added: DataFrame) -> DataFrame:
    """First added field of the same id that equals, contains or is contained.

    ``missing``: id, field. ``added``: id, seq, field. The match is inside one
    id, whose field list is one operation's selection set.
    """
    pool = added.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "field"))).alias("_pool"))
    low = F.lower("field")
    hit = F.get(F.filter("_pool", lambda c: F.lower(c["field"]).contains(low) | low.contains(F.lower(c["field"]))), 0)
    return missing.join(pool, "id").select("id", "field", hit["field"].alias("candidate")).filter("candidate IS NOT NULL")


def semantic_check(df: DataFrame) -> DataFrame:
    """Findings of ``old_fields/new_fields, old_depth/new_depth, old/new`` rows."""
    lost = F.array_except("old_fields", "new_fields")
    added = F.array_except("new_fields", "old_fields")

    def renamed(f):
        return F.exists("new_fields", lambda g: F.lower(g).contains(F.lower(f)) | F.lower(f).contains(F.lower(g)))

    found = [
        F.transform(F.filter(lost, lambda f: ~renamed(f)), lambda f: F.struct(F.lit("error").alias("level"), F.lit("missing").alias("what"), f.alias("field"))),
        F.transform(F.filter(lost, renamed), lambda f: F.struct(F.lit("warning").alias("level"), F.lit("renamed").alias("what"), f.alias("field"))),
        F.transform(added, lambda f: F.struct(F.lit("warning").alias("level"), F.lit("added").alias("what"), f.alias("field"))),
    ]

    def one(test, level, what):
        return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(what).alias("what"), F.lit("").alias("field")))

    flags = F.array_compact(F.array(
        one(F.col("new_depth") < F.col("old_depth"), "incompatible", "shallower"),
        one(F.col("old").contains("edges") & ~F.col("new").contains("edges"), "warning", "connection removed"),
        one(~F.col("old").contains("nodes") & F.col("new").contains("nodes"), "warning", "nodes added"),
        one(F.size(F.array_except("old_vars", "new_vars")) > 0, "error", "missing-variable"),
        one(~F.col("old_kind").eqNullSafe(F.col("new_kind")), "error", "kind changed"),
    ))
    return df.select("id", F.inline(F.concat(*found, flags)))


def alike(a: Column, b: Column, known: Sequence[tuple[str, str]] = ()) -> Column:
    """Whether two names look like a rename: one contains the other, whatever the case, or the pair is ``known``."""
    x, y = F.lower(a), F.lower(b)
    listed = F.concat(a, F.lit(">"), b).isin([f"{old}>{new}" for old, new in known]) if known else F.lit(False)
    return (a != b) & (x.contains(y) | y.contains(x) | listed)


def outline(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with what the semantic check needs of an operation text: paths of its fields, variables, directives, depth and kind.

    Comments, texts and interpolations are stepped over by the field reader; variables are those that the header declares.
    """
    c = F.col(text)
    bare = F.regexp_replace(json_trees.coded(c), r'#[^\n]*+|"[^"\n]*+"', " ")
    paths = F.array_distinct(F.transform(selections.fields(c), lambda f: F.concat(f["trail"], F.array(f["name"]))))
    return df.withColumns({
        f"{prefix}_paths": paths, f"{prefix}_vars": F.array_distinct(X.all_matches(bare, r"\$([A-Za-z_]\w*)\s*:")),
        f"{prefix}_directives": F.array_distinct(X.all_matches(bare, r"@([A-Za-z_]\w*)")), f"{prefix}_depth": T.brace_depth(bare), f"{prefix}_kind": F.coalesce(T.op_kind(c), F.lit("query")),
    })


def semantic_check_texts(df: DataFrame, id_col: str, before: str, after: str, known: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Findings (id, level, what, field) of a rewrite, from the two texts alone.

    A field's place is the path of names above it. A path that the new text lacks is renamed if a new path of the same length agrees in
    every step, each equal or :func:`alike` (the first such path counts), else missing; new paths that no rename explains are added.
    Lost variables are errors, lost directives warnings; kind, depth, connections and node lists are compared as a whole. Null texts
    have no fields; a pair without findings has no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(before).alias("old"), F.col(after).alias("new"))
    rows = outline(outline(rows, "old", "old"), "new", "new")
    empty = F.array().cast("array<array<string>>")
    old, new = F.coalesce("old_paths", empty), F.coalesce("new_paths", empty)
    rows = rows.withColumn("_lost", F.array_except(old, new)).withColumn("_added", F.array_except(new, old))

    def partner(p):
        step = lambda x, y: (x == y) | alike(x, y, known)
        return F.get(F.filter("_added", lambda q: (F.size(q) == F.size(p)) & F.forall(F.zip_with(p, q, step), lambda m: F.coalesce(m, F.lit(False)))), 0)

    rows = rows.withColumn("_matched", F.transform("_lost", lambda p: F.struct(p.alias("path"), partner(p).alias("to"))))
    shown = lambda p: F.array_join(p, ".")
    row = lambda level, what, field: F.struct(F.lit(level).alias("level"), F.lit(what).alias("what"), field.alias("field"))
    used = F.transform(F.filter("_matched", lambda m: m["to"].isNotNull()), lambda m: m["to"])
    lost = lambda kind: F.array_except(F.coalesce(f"old_{kind}", F.array().cast("array<string>")), F.coalesce(f"new_{kind}", F.array().cast("array<string>")))
    one = lambda test, level, what: F.when(test, row(level, what, F.lit("")))
    findings = F.concat(
        F.transform(F.filter("_matched", lambda m: m["to"].isNull()), lambda m: row("error", "missing-field", shown(m["path"]))),
        F.transform(F.filter("_matched", lambda m: m["to"].isNotNull()), lambda m: row("warning", "field-rename", F.concat(shown(m["path"]), F.lit(" > "), shown(m["to"])))),
        F.transform(F.array_except("_added", used), lambda p: row("warning", "added", shown(p))),
        F.transform(lost("vars"), lambda v: row("error", "missing-variable", v)),
        F.transform(lost("directives"), lambda v: row("warning", "missing-directive", v)),
        F.array_compact(F.array(
            one(F.col("new_depth") < F.col("old_depth"), "incompatible", "shallower"),
            one(F.col("old").contains("edges") & ~F.col("new").contains("edges"), "warning", "connection removed"),
            one(~F.col("old").contains("nodes") & F.col("new").contains("nodes"), "warning", "nodes added"),
            one(F.col("old_kind") != F.col("new_kind"), "error", "kind changed"))))
    return rows.select("id", F.inline(findings))


def rule_impact(changes: DataFrame) -> DataFrame:
    """Breaking-change rows implied by rewrite rules."""
    # Fixed values: (rule type, change, impact).
    table = (("field-rename", "field-removal", "low"), ("type-change", "type-change", "high"), ("nested-replacement", "schema-mismatch", "medium"))
    change = impact = None
    for rule, name, level in table:
        test = F.col("type") == rule
        change = F.when(test, name) if change is None else change.when(test, name)
        impact = F.when(test, level) if impact is None else impact.when(test, level)
    return changes.select("id", F.col("old").alias("field"), change.alias("change"), impact.alias("impact")).filter("change IS NOT NULL")


def required_arguments(usages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Fields whose contract needs arguments the original did not pass."""
    need = catalog.filter("requires_argument").select("type_name", "field_name")
    return usages.filter(~F.col("had_argument")).join(need, ["type_name", "field_name"]).select(
        "id", F.col("field_name").alias("field"), F.lit("required-argument").alias("change"), F.lit("high").alias("impact")
    )
