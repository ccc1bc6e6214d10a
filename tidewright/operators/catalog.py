"""Contract catalogs: rule mining, conformance, catalog choice and reports.

``catalog`` rows are ``type_name, field_name[, catalog, is_deprecated, reason]``;
``usages`` rows are ``id, type_name, field_name``. Lookups are equi-joins whose
strategy is left to the optimizer, so a catalog of any size works.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.selections import fields
from tidewright.session import checkpoint

# The contract line patterns and the reason patterns, in order.
TYPE_LINE = r"^\s*(type|interface)\s+(\w+)\s*"
DEPRECATED_LINE = r"""(\w+)\s*(?:\([^)]*\))?\s*:\s*[^@]*@deprecated\(reason:\s*"([^"]+)"\)"""
REASON_USE = r"(?i)^Use\s+`?(\w+(?:\.\w+)*)`?(?:\s+instead)?$"
REASON_SWITCH = r"(?i)switch\s+to\s+using\s+(\w+)"
REASON_PATH = r"(\w+(?:\.\w+)+)"
REASON_EXACT = r"Use `(\w+)`"


def read_lines(df: DataFrame, file: str, content: str) -> DataFrame:
    return df.select(F.col(file).alias("file"), F.posexplode(F.split(content, "\n")).alias("line_no", "line"))


def parse_reason(reason: Column) -> Column:
    """Replacement named by a reason; null when the reason is vague."""
    def hit(pattern):
        found = F.regexp_extract(reason, pattern, 1)
        return F.when(found != "", found)

    return F.coalesce(hit(REASON_USE), hit(REASON_SWITCH), hit(REASON_PATH))


def mine_rules(lines: DataFrame) -> DataFrame:
    """Deprecation rules of contract lines ``file, line_no, line``.

    The current type runs from its header to the first line with a closing
    brace; reasons outside any type are skipped.
    """
    line = F.col("line")
    w = Window.partitionBy("file").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.regexp_extract(line, TYPE_LINE, 2)
    header = F.when(opened != "", opened)
    # A marker per line: the type it opens, or '' where a brace closes one.
    after = F.when(line.contains("}"), F.lit("")).when(header.isNotNull(), header)
    current = F.coalesce(header, F.last(after, ignorenulls=True).over(before))
    rows = lines.withColumn("_type", current).select(
        "file", "line_no", F.col("_type").alias("object_type"),
        F.regexp_extract(line, DEPRECATED_LINE, 1).alias("field_name"),
        F.regexp_extract(line, DEPRECATED_LINE, 2).alias("reason"),
    )
    found = rows.filter((F.col("field_name") != "") & (F.coalesce("object_type", F.lit("")) != ""))
    first = found.groupBy("object_type", "field_name", "reason").agg(F.min(F.struct("file", "line_no")).alias("at"))
    replacement = parse_reason(F.col("reason"))
    return first.select(
        "object_type", "field_name", "reason", replacement.alias("replacement"), replacement.isNull().alias("is_vague"),
        F.when(replacement.isNull(), "comment-out").otherwise("replace").alias("action"),
        F.col("at.file").alias("file"), F.col("at.line_no").alias("line_no"),
    )


def actionable(rules: DataFrame) -> DataFrame:
    return rules.filter(~F.col("is_vague") & F.col("replacement").isNotNull())


def vague(rules: DataFrame) -> DataFrame:
    return rules.filter("is_vague")


def rename_rules(rules: DataFrame) -> DataFrame:
    """Same-type renames: only reasons that name one field in back quotes."""
    target = F.regexp_extract("reason", REASON_EXACT, 1)
    return rules.select(
        F.col("object_type"), F.col("field_name").alias("old"), target.alias("new")
    ).filter("new <> ''")


def rule_summary(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_vague")).alias("replaceable"),
        F.count_if("is_vague").alias("vague"),
    )


def with_aliases(rules: DataFrame, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds rule rows for alias types where the alias has no rule of its own."""
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in aliases])
    keys = [c for c in rules.columns if c != "object_type"]
    own = rules.select(F.lit(0).alias("_p"), "object_type", *keys)
    via = (
        rules.withColumn("_pair", F.explode(F.filter(pairs, lambda p: p["src"] == F.col("object_type"))))
        .select(F.lit(1).alias("_p"), F.col("_pair.dst").alias("object_type"), *keys)
    )
    rest = [c for c in keys if c != "field_name"]
    best = own.unionByName(via).groupBy("object_type", "field_name").agg(
        F.min_by(F.struct(*rest), F.struct("_p", *[F.col(c) for c in ("reason",) if c in rest])).alias("_r")
    )
    return best.select("object_type", "field_name", *[F.col(f"_r.{c}").alias(c) for c in rest])


# The root type of each kind of operation.
ROOTS = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}


def mine_usages(ops: DataFrame, catalog: DataFrame, roots: dict[str, str] | None = None) -> DataFrame:
    """Typed field usages of operation texts: id, pos, at, path, type_name, field_name, is_root.

    ``ops``: id, content. ``catalog``: type_name, field_name, field_type. ``at`` is the character offset of the field's name, ``pos`` its
    number in the text. The parent type of a field is found by walking down from the root or fragment type it stands under, one
    join with the catalog per level for all fields at once; it is null below a field the catalog does not know.
    """
    roots = roots or ROOTS
    start = F.col("f.scope")
    for kind, name in roots.items():
        start = F.when(F.col("f.scope") == kind, name).otherwise(start)
    # texts of one file, or of a few, are dealt over all tasks before they are read
    texts = ops.select("id", "content").repartition(int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select("id", F.posexplode(fields(F.col("content"))).alias("pos", "f")).select(
        "id", "pos", "f.at", F.array_join(F.concat("f.trail", F.array("f.name")), ".").alias("path"), start.alias("type_name"),
        F.col("f.name").alias("field_name"), (F.size("f.trail") == 0).alias("is_root"), F.col("f.trail").alias("_rest"))
    steps = last_per_key(catalog.select("type_name", "field_name", "field_type"), ["type_name", "field_name"])
    steps = steps.select(F.col("type_name").alias("_t"), F.col("field_name").alias("_f"), "field_type")
    open_, done = checkpoint(rows), None
    while True:
        ended = open_.filter(F.size("_rest") == 0).drop("_rest")
        done = ended if done is None else done.unionByName(ended)
        deeper = open_.filter(F.size("_rest") > 0)
        if deeper.isEmpty():
            return done
        walked = deeper.join(steps, (F.col("type_name") == F.col("_t")) & (F.get("_rest", F.lit(0)) == F.col("_f")), "left")
        open_ = checkpoint(walked.withColumns({"type_name": F.col("field_type"), "_rest": F.slice("_rest", F.lit(2), F.size("_rest"))}).select(open_.columns))


def last_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: of repeated ones the last by file and line where these are given, else by content."""
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(c) for c in ("file", "line_no", *rest) if c in rest]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def apply_rule_lookup(usages: DataFrame, rules: DataFrame, root_type: str | None = None) -> DataFrame:
    """Rule per usage by ``type.field``; root usages also try ``root_type``. A repeated rule counts once, the last."""
    rules = last_per_key(rules, ["object_type", "field_name"])
    payload = [c for c in ("reason", "replacement", "is_vague", "action") if c in rules.columns]
    key = rules.select(
        F.col("object_type").alias("type_name"), "field_name", F.struct(*payload).alias("_own")
    )
    out = usages.join(key, ["type_name", "field_name"], "left")
    rule = F.col("_own")
    if root_type is not None:
        roots = rules.filter(F.col("object_type") == root_type).select("field_name", F.struct(*payload).alias("_root"))
        out = out.join(roots, "field_name", "left")
        rule = F.coalesce(F.col("_own"), F.when(F.col("is_root"), F.col("_root")))
    out = out.withColumn("_rule", rule)
    return out.select(*usages.columns, *[F.col(f"_rule.{c}").alias(c) for c in payload])


def conformance(usages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Usage rows labelled ``error`` (unknown), ``warning`` (deprecated) or ``ok``. A repeated catalog row counts once."""
    known = last_per_key(catalog.select("type_name", "field_name", "is_deprecated", "reason"), ["type_name", "field_name"]).withColumn("_known", F.lit(True))
    status = (
        F.when(F.col("_known").isNull(), "error").when(F.col("is_deprecated"), "warning").otherwise("ok")
    )
    return usages.join(known, ["type_name", "field_name"], "left").select(
        *usages.columns, status.alias("status"),
        F.when(F.col("is_deprecated"), parse_reason(F.col("reason"))).alias("suggestion"),
    )


def unknown_usages(usages: DataFrame, catalog: DataFrame) -> DataFrame:
    return usages.join(catalog.select("type_name", "field_name"), ["type_name", "field_name"], "left_anti")


def deprecated_usages(usages: DataFrame, rules: DataFrame) -> DataFrame:
    key = rules.select(F.col("object_type").alias("type_name"), "field_name", "reason", "replacement")
    return usages.join(key, ["type_name", "field_name"])


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """TYPE_REMOVED, and FIELD_REMOVED for the types both sides have."""
    old_types = old.select("type_name").filter(~F.col("type_name").startswith("__")).distinct()
    new_types = new.select("type_name").distinct()
    gone = old_types.join(new_types, "type_name", "left_anti").select(
        F.lit("TYPE_REMOVED").alias("change"), "type_name", F.lit(None).cast("string").alias("field_name")
    )
    fields = (
        old.filter(~F.col("type_name").startswith("__")).select("type_name", "field_name").distinct()
        .join(new_types, "type_name", "left_semi")
        .join(new.select("type_name", "field_name"), ["type_name", "field_name"], "left_anti")
        .select(F.lit("FIELD_REMOVED").alias("change"), "type_name", "field_name")
    )
    return gone.unionByName(fields)


def recommend_migration(df: DataFrame, prop: str, properties: DataFrame, versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Property -> (pattern, version) -> name, target version and manifest advice.

    ``properties``: prop, pattern, version. ``versions``: pattern, version, seq,
    name, is_deprecated. ``manifest``: pattern, version, to_name, reason.
    """
    target = versions.groupBy("pattern").agg(
        F.coalesce(
            F.min_by("version", F.when(~F.col("is_deprecated"), F.col("seq"))), F.max_by("version", "seq")
        ).alias("_target")
    )
    return (
        df.join(properties.withColumnRenamed("prop", prop), prop, "left")
        .join(versions.select("pattern", "version", "name", "is_deprecated"), ["pattern", "version"], "left")
        .join(target, "pattern", "left")
        .join(manifest, ["pattern", "version"], "left")
        .withColumn("target_version", F.when(F.col("is_deprecated"), F.col("_target")))
        .withColumn("should_migrate", F.coalesce(F.col("is_deprecated") & F.col("to_name").isNotNull(), F.lit(False)))
        .drop("_target")
    )


def classify_by_catalog(usages: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Best catalog per id by share of known fields less a penalty per unknown one.

    Only matching catalogs are joined; an id that matches none falls to the
    first catalog with score 0, as trying every catalog would give.
    """
    asked = usages.select("id", "type_name", "field_name").distinct()
    total = asked.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    valid = (
        asked.join(catalogs.select("catalog", "seq", "type_name", "field_name").distinct(), ["type_name", "field_name"])
        .groupBy("id", "catalog", "seq").agg(F.count(F.lit(1)).alias("valid"))
    )
    scored = valid.join(total, "id")
    errors = F.col("total") - F.col("valid")
    score = F.greatest(F.lit(0.0), F.col("valid") / F.col("total") - F.least(errors * F.lit(0.1), F.lit(0.5)))
    best = scored.withColumn("score", score).withColumn("errors", errors).groupBy("id").agg(
        F.max_by(F.struct("catalog", "score", "errors"), F.struct("score", -F.col("seq"))).alias("b")
    )
    first = catalogs.agg(F.min_by("catalog", "seq").alias("_first"))
    out = total.join(best, "id", "left").join(first, how="inner")
    none_left = F.coalesce(F.col("b.errors"), F.col("total")) == 0
    s = F.coalesce(F.col("b.score"), F.lit(0.0))
    return out.select(
        "id",
        F.coalesce(F.when(s > 0, F.col("b.catalog")), F.col("_first")).alias("catalog"),
        F.when(none_left, F.lit(1.0)).otherwise(s).alias("confidence"),
        F.when(none_left, "valid").when(s > 0.7, "partial_match").otherwise("wrong_schema").alias("label"),
    )


def validate_multi(usages: DataFrame, catalogs: DataFrame, default: str) -> DataFrame:
    """Routes each usage to its forced, detected or default catalog, then checks it."""
    routed = usages.withColumn("catalog", F.coalesce("forced", "detected", F.lit(default)))
    known = catalogs.groupBy("catalog", "type_name", "field_name").agg(F.max("is_deprecated").alias("is_deprecated")).withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), "error").when(F.col("is_deprecated"), "warning").otherwise("ok")
    return routed.join(known, ["catalog", "type_name", "field_name"], "left").select(
        "id", "catalog", "type_name", "field_name", status.alias("status")
    )


def validation_report(checked: DataFrame) -> DataFrame:
    """Counts per id from ``id, status`` rows, with the exit flag."""
    per_id = checked.groupBy("id").agg(
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings")
    )
    return per_id.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("errors") == 0).alias("valid"),
        F.count_if(F.col("errors") > 0).alias("invalid"),
        F.sum("warnings").alias("warnings"),
        (F.count_if(F.col("errors") > 0) > 0).alias("exit_failed"),
    )


def per_catalog_report(checked: DataFrame) -> DataFrame:
    """Per catalog counts plus the overall row (``catalog`` null)."""
    per_id = checked.groupBy("catalog", "id").agg(
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings")
    )
    return per_id.rollup("catalog").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("errors") == 0).alias("valid"),
        F.count_if(F.col("errors") > 0).alias("invalid"),
        F.sum("warnings").alias("warnings"),
    )


def classification_report(classified: DataFrame) -> DataFrame:
    """Counts per label and per suggested catalog in one pass."""
    return classified.groupingSets([["label"], ["catalog"]], "label", "catalog").agg(F.count(F.lit(1)).alias("n"))


def confidence_bands(classified: DataFrame, k: int = 5) -> DataFrame:
    c = F.col("confidence")
    counts = classified.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c > 0.7).alias("high"),
        F.count_if((c > 0.4) & (c <= 0.7)).alias("middle"),
        F.count_if(c <= 0.4).alias("low"),
    )
    ranked = classified.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).filter(F.col("_r") <= k)
    top = ranked.groupBy("label").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("examples")
    )
    return counts.join(top, "label")


def error_frequency(errors: DataFrame, message: str) -> DataFrame:
    return errors.groupBy(F.substring_index(message, ":", 1).alias("error_key")).agg(F.count(F.lit(1)).alias("n"))


def compare_stages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per id present in both: improved, degraded or unchanged by error count."""
    joined = before.select("id", F.col("errors").alias("_b")).join(after.select("id", F.col("errors").alias("_a")), "id")
    change = F.when(F.col("_a") < F.col("_b"), "improved").when(F.col("_a") > F.col("_b"), "degraded").otherwise("unchanged")
    return joined.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def readiness_score(total: Column, valid: Column, unique: Column, named: Column, clean: Column) -> Column:
    """0.4 valid + 0.2 unique + 0.2 named + 0.2 * (100 or 50), rounded half up."""
    pct = lambda c: c * F.lit(100.0) / total
    raw = pct(valid) * 0.4 + pct(unique) * 0.2 + pct(named) * 0.2 + F.when(clean, 100.0).otherwise(50.0) * 0.2
    return F.floor(raw + 0.5)
