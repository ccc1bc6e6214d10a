"""Comparison of two JSON snapshots per id.

The one shuffle is the pairing by id. Alignment, classification, scoring and
the verdict then are columns of the paired row, so no path row is ever exchanged.
Pairs with equal texts are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import comparators, json_trees

# Field words that raise a value change to medium, and the
# breaking-change table.
IMPORTANT = "id|key|name|type|status"
BREAKING = (
    ("missing-field", "removed-field", "high", "Add field mapping or provide default value"),
    ("type-mismatch", "type-change", "high", "Add type conversion in alignment function"),
    ("structure-change", "semantic-change", "medium", "Restructure data in alignment function"),
)
MALFORMED = "malformed-json"  # of the one difference of a pair whose texts cannot be read


@dataclass(frozen=True)
class IgnorePattern:
    path: str
    reason: str
    type: str | None = None
    regex: bool = False

    def test(self, dotted: Column) -> Column:
        if self.regex:
            return dotted.rlike(self.path)
        if "*" in self.path:
            return dotted.rlike("^" + re.escape(self.path).replace(r"\*", ".*") + "$")
        return dotted == self.path


@dataclass(frozen=True)
class Expected:
    path: str
    type: str | None = None


@dataclass
class CompareConfig:
    strict: bool = False
    ignore: list[IgnorePattern] = field(default_factory=list)
    expected: list[Expected] = field(default_factory=list)
    comparators: dict[str, tuple[str, dict]] = field(default_factory=dict)

    def add_ignore(self, pattern: IgnorePattern) -> None:
        self.ignore.append(pattern)

    def add_expected(self, expected: Expected) -> None:
        self.expected.append(expected)


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def is_ignored(dotted: Column, patterns: Sequence[IgnorePattern]) -> Column:
    return any_of([p.test(dotted) for p in patterns])


def plain_segments(segments: Column) -> Column:
    return F.transform(segments, lambda s: F.regexp_replace(s, r"^#(\d+)$", "$1"))


def dotted_path(segments: Column) -> Column:
    return F.array_join(plain_segments(segments), ".")


def render_path(segments: Column) -> Column:
    """``a.b[0].c``: any numeric segment but the first is an index."""
    plain = plain_segments(segments)
    tail = F.transform(
        F.slice(plain, 2, F.size(plain)),
        lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(F.lit("."), s)),
    )
    return F.concat(F.element_at(plain, 1), F.array_join(tail, ""))


def is_important(segments: Column) -> Column:
    return F.lower(F.element_at(segments, -1)).rlike(IMPORTANT)


def convertible(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    numeric = lambda v: F.trim(v).try_cast("double").isNotNull() | (F.trim(v) == "")
    return (
        F.when((ta == "number") & (tb == "string"), numeric(b))
        .when((ta == "string") & (tb == "number"), numeric(a))
        .when((ta == "boolean") & (tb == "string"), b.isin("true", "false"))
        .otherwise(False)
    )


def severity(type_: Column, important: Column) -> Column:
    return (
        F.when(type_.isin("missing-field", "type-mismatch", MALFORMED), "critical")
        .when(type_ == "structure-change", "high")
        .when((type_ == "value-change") & important, "medium")
        .otherwise("low")
    )


def fixable(type_: Column, a: Column, b: Column, ta: Column, tb: Column) -> Column:
    return F.when(type_.isin("extra-field", "array-order", "null-mismatch"), True).when(
        type_ == "value-change", convertible(a, b, ta, tb)
    ).otherwise(False)


def pair_snapshots(base: DataFrame, cand: DataFrame, id_col: str = "id") -> DataFrame:
    """Full outer pairing; columns are prefixed ``base_`` and ``cand_``."""
    def side(df, p):
        cols = [F.col(c).alias(f"{p}_{c}") for c in df.columns if c != id_col]
        return df.select(F.col(id_col).alias("id"), *cols, F.lit(True).alias(f"has_{p}"))

    both = side(base, "base").join(side(cand, "cand"), "id", "full_outer")
    return both.withColumns({f"has_{p}": F.coalesce(f"has_{p}", F.lit(False)) for p in ("base", "cand")})


def _diffs(nodes: Column, cfg: CompareConfig) -> Column:
    """Classified, filtered difference structs of one aligned pair."""
    def ancestors(n, drop):
        parts = plain_segments(n["segments"])
        size = F.size(parts) - drop
        return F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))

    def visible(n):
        one_sided = n["side"].isin("left", "right")
        keep = F.lit(True)
        if cfg.ignore:
            drop = F.when(one_sided, 1).otherwise(0)
            hit = F.exists(ancestors(n, drop), lambda p: is_ignored(p, cfg.ignore))
            keep = keep & ~F.when(one_sided & (F.size(n["segments"]) == 1), False).otherwise(hit)
        for path, (name, options) in cfg.comparators.items():
            test = comparators.build(name, **options)
            passed = test(n["base_value"], n["cand_value"], n["base_type"], n["cand_type"])
            keep = keep & ~((n["side"] == "custom") & (dotted_path(n["segments"]) == path) & F.coalesce(passed, F.lit(False)))
        return keep

    def classify(n):
        moved = n["reorder"].isNotNull() if not cfg.strict else F.lit(False)
        type_ = F.when(moved, "array-order").otherwise(
            F.when(n["side"] == "left", "missing-field").when(n["side"] == "right", "extra-field")
            .when(n["side"] == "null", "null-mismatch").when(n["side"] == "type", "type-mismatch")
            .when(n["side"] == "length", "array-length").otherwise("value-change")
        )
        segments = F.when(moved, n["reorder"]).otherwise(n["segments"])

        def value(v, length):
            return F.when(moved, F.lit(None)).when(n["side"] == "length", length.cast("string")).otherwise(v)

        def typed(t):
            return F.when(moved, "array").otherwise(t)

        return F.struct(
            segments.alias("segments"), type_.alias("type"),
            value(n["base_value"], n["base_len"]).alias("baseline"), value(n["cand_value"], n["cand_len"]).alias("candidate"),
            typed(n["base_type"]).alias("base_type"), typed(n["cand_type"]).alias("cand_type"),
        )

    def finish(d):
        dotted = dotted_path(d["segments"])
        reason = F.coalesce(*[F.when(p.test(dotted), p.reason) for p in cfg.ignore], F.lit(None).cast("string"))
        lowered = any_of([p.test(dotted) & (d["type"] == p.type) for p in cfg.ignore if p.type])
        level = F.when(lowered, "low").otherwise(severity(d["type"], is_important(d["segments"])))
        return F.struct(
            render_path(d["segments"]).alias("path"), d["segments"].alias("segments"), d["type"].alias("type"),
            d["baseline"].alias("baseline"), d["candidate"].alias("candidate"),
            d["base_type"].alias("base_type"), d["cand_type"].alias("cand_type"), level.alias("severity"),
            fixable(d["type"], d["baseline"], d["candidate"], d["base_type"], d["cand_type"]).alias("fixable"),
            reason.alias("ignored"),
        )

    found = F.array_distinct(F.transform(F.filter(nodes, visible), classify))
    out = F.transform(found, finish)
    def unexpected(e):
        typed = (lambda d: d["type"] == e.type) if e.type else (lambda d: F.lit(True))
        return lambda d: ~((d["path"] == e.path) & typed(d))

    for e in cfg.expected:
        out = F.filter(out, unexpected(e))
    return out


def _unread(root: str, base: Column, cand: Column) -> Column:
    """The difference of a pair of which a text is malformed."""
    null = F.lit(None).cast("string")
    return F.array(F.struct(
        F.lit(root).alias("path"), F.array(F.lit(root)).alias("segments"), F.lit(MALFORMED).alias("type"), base.alias("baseline"), cand.alias("candidate"),
        F.lit("string").alias("base_type"), F.lit("string").alias("cand_type"), F.lit("critical").alias("severity"), F.lit(False).alias("fixable"), null.alias("ignored")))


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, F.when(new > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise((new - old) / old * 100.0)


def impact_text(latency: Column, size: Column) -> Column:
    inf = F.lit(float("inf"))
    big = lambda c: (F.abs(c) > 50) & (F.abs(c) != inf)
    head = (
        F.when(big(latency) & (latency > 0), "Significant latency increase detected. Consider optimization.")
        .when(big(latency), "Significant latency improvement detected.")
        .otherwise("Performance impact is acceptable")
    )
    tail = (
        F.when(big(size) & (size > 0), " Response size increased significantly.")
        .when(big(size), " Response size decreased significantly.").otherwise("")
    )
    return F.concat(head, tail)


def compare_pairs(pairs: DataFrame, cfg: CompareConfig | None = None, keep: bool = False) -> DataFrame:
    """One row per id with its differences, scores and verdict.

    ``pairs`` comes from ``pair_snapshots`` over frames with ``data`` (JSON),
    and optionally ``errors`` (JSON), ``duration`` and ``size``. ``keep`` carries
    the input columns, the alignment ``_p`` and the coded text of the candidate ``_p_code`` along.

    No data is JSON's null: a side without data differs from one with data at the root. Texts that differ and of which one is
    malformed give one difference of type ``malformed-json`` at the root, similarity 0 and the verdict unsafe.
    """
    cfg = cfg or CompareConfig()
    null = F.lit(None).cast("string")
    have = lambda c, t: F.col(c) if c in pairs.columns else F.lit(None).cast(t)
    data = {p: F.coalesce(F.col(f"{p}_data"), F.lit("null")) for p in ("base", "cand")}
    changed = F.col("has_base") & F.col("has_cand") & (data["base"] != data["cand"])
    be, ce = have("base_errors", "string"), have("cand_errors", "string")
    err_changed = F.col("has_base") & F.col("has_cand") & ~be.eqNullSafe(ce)
    # Equal texts are left out as nulls, which have no nodes.
    gate = lambda test, c: F.when(test, c).otherwise(null)
    rows = pairs.withColumn("_base", gate(changed, data["base"])).withColumn("_cand", gate(changed, data["cand"]))
    rows = json_trees.align(rows, "_base", "_cand", "_p", "data", cfg.comparators)
    malformed = F.coalesce(F.col("_p.malformed"), F.lit(False))
    if "base_errors" in pairs.columns:
        rows = rows.withColumn("_base", gate(err_changed, be)).withColumn("_cand", gate(err_changed, ce))
        rows = json_trees.align(rows, "_base", "_cand", "_e", "errors", cfg.comparators)
        error_diffs = _diffs(F.col("_e.nodes"), CompareConfig(cfg.strict, cfg.ignore, [], cfg.comparators))
        error_diffs = F.when(F.col("_e.malformed"), _unread("errors", be, ce)).otherwise(error_diffs)
        malformed = malformed | F.coalesce(F.col("_e.malformed"), F.lit(False))
    else:
        error_diffs = F.filter(_diffs(F.col("_p.nodes"), cfg), lambda d: F.lit(False))
    data_diffs = F.when(F.col("_p.malformed"), _unread("data", data["base"], data["cand"])).otherwise(_diffs(F.col("_p.nodes"), cfg))
    both = F.col("has_base") & F.col("has_cand")
    lost = F.array(
        F.struct(
            F.lit("response").alias("path"), F.array(F.lit("response")).alias("segments"), F.lit("missing-field").alias("type"),
            F.when(F.col("has_base"), "present").otherwise("missing").alias("baseline"),
            F.when(F.col("has_cand"), "present").otherwise("missing").alias("candidate"),
            F.lit("string").alias("base_type"), F.lit("string").alias("cand_type"),
            F.lit("critical").alias("severity"), F.lit(False).alias("fixable"), null.alias("ignored"),
        )
    )
    rows = rows.withColumn(
        "diffs", F.when(both, F.flatten(F.array(data_diffs, error_diffs))).otherwise(lost)
    ).withColumn("_structure", json_trees.dice(F.col("_p_stats.base_shape"), F.col("_p_stats.cand_shape"))).withColumn("_malformed", malformed)
    count = lambda f: F.size(F.filter("diffs", f))
    breaking = [b[0] for b in BREAKING]
    values = F.when(F.coalesce(F.col("_p_stats.base_leaves"), F.lit(0)) == 0, 1.0).otherwise(
        F.col("_p_stats.same_leaves") / F.greatest("_p_stats.base_leaves", "_p_stats.cand_leaves")
    )
    weighted = F.coalesce("_structure", F.lit(1.0)) * 0.7 + values * 0.3
    raw = weighted - count(lambda d: d["severity"] == "critical") * 0.1
    similarity = F.when(~both | F.col("_malformed"), 0.0).when(F.size("diffs") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), raw))
    zero = F.lit(0.0)
    change = lambda n: (
        F.when(both, percent_change(F.col(f"base_{n}"), F.col(f"cand_{n}"))).otherwise(zero)
        if f"base_{n}" in pairs.columns else zero
    )
    carried = [c for c in pairs.columns if c not in ("id", "has_base", "has_cand")] + ["_p", "_p_code"] if keep else []
    out = rows.select(
        "id", "has_base", "has_cand", *carried, "diffs", (F.size("diffs") == 0).alias("identical"), similarity.alias("similarity"),
        count(lambda d: d["type"].isin(*breaking)).alias("breaking"),
        count(lambda d: d["severity"] == "medium").alias("medium"),
        change("duration").alias("latency_change"), change("size").alias("size_change"),
    )
    verdict = (
        F.when((F.col("breaking") > 0) | (F.col("similarity") < 0.8), "unsafe")
        .when((F.abs("latency_change") > 30) | (F.abs("size_change") > 30) | (F.col("medium") > 0), "review")
        .otherwise("safe")
    )
    text = F.when(F.col("has_base") & F.col("has_cand"), impact_text(F.col("latency_change"), F.col("size_change"))).otherwise(
        "Cannot compare performance - response missing"
    )
    return out.withColumns({"verdict": verdict, "performance": text})


def diff_rows(compared: DataFrame) -> DataFrame:
    """One row per difference. The outer form keeps the optimizer from adding a
    non-empty test that would run the alignment a second time."""
    return compared.select("id", F.inline_outer("diffs")).filter("path IS NOT NULL")


def drop_expected(diffs: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` has ``path, type``; a null type matches every type."""
    any_type = expected.filter(F.col("type").isNull()).select("path")
    typed = expected.filter(F.col("type").isNotNull()).select("path", "type")
    return diffs.join(any_type, "path", "left_anti").join(typed, ["path", "type"], "left_anti")


def breaking_changes(compared: DataFrame) -> DataFrame:
    """Distinct (type, path) breaking changes with impact, high first."""
    d = diff_rows(compared)
    kind = impact = advice = None
    for source, name, level, text in BREAKING:
        test = F.col("type") == source
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        impact = F.when(test, level) if impact is None else impact.when(test, level)
        advice = F.when(test, text) if advice is None else advice.when(test, text)
    rows = d.select(kind.alias("change"), "path", impact.alias("impact"), advice.alias("advice")).filter("change IS NOT NULL")
    order = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    return rows.dropDuplicates(["change", "path"]).orderBy(order, "path")


def validation_summary(compared: DataFrame) -> DataFrame:
    agg = compared.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("identical").alias("identical"),
        F.count_if(~F.col("identical")).alias("modified"),
        F.coalesce(F.sum("breaking"), F.lit(0)).alias("breaking"),
        F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean_similarity"),
        F.count_if(F.col("similarity") < 0.9).alias("low_similarity"),
        F.count_if(F.abs("latency_change") > 20).alias("latency_issues"),
        F.count_if(F.col("verdict") == "review").alias("needs_review"),
    )
    b, s = F.col("breaking"), F.col("mean_similarity")
    risk = F.when((b > 0) | (s < 0.9), "high").when(s < 0.95, "medium").otherwise("low")
    split = F.when((b == 0) & (s > 0.98), 25).when(b > 0, 1).otherwise(10)
    return agg.withColumns({
        "safe_to_migrate": (b == 0) & (s > 0.95), "risk": risk,
        "suggest_rollout": (b == 0) & (F.col("total") > 10), "initial_split": split,
    })


def ci_gate(compared: DataFrame) -> DataFrame:
    bad = F.col("breaking") > 0
    return compared.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("identical").alias("passed"), F.count_if(bad).alias("failed"),
        F.count_if(~F.col("identical") & ~bad).alias("warnings"), (F.count_if(bad) == 0).alias("ok"),
    )


def ignored_counts(compared: DataFrame) -> DataFrame:
    return diff_rows(compared).filter("ignored IS NOT NULL").groupBy("path", F.col("ignored").alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def flatten_json(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every node of the JSON column ``text`` with its path, type, scalar and order key. Null and malformed texts have no rows."""
    return df.select(F.col(id_col).alias("id"), F.inline(json_trees.flat_nodes(f"`{text}`")))


def pair_paths(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Leaf and container paths of both flattened sides, aligned by (id, path)."""
    cols = lambda p: ["id", "path", F.col("node_type").alias(f"{p}_type"), F.col("value").alias(f"{p}_value")]
    return base.select(*cols("base")).join(cand.select(*cols("cand")), ["id", "path"], "full_outer")


def multiset_equal(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.sort_array(a) == F.sort_array(b))


def positional_matches(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda m: m))


strip_nulls = json_trees.strip_nulls


def line_diff(df: DataFrame, id_col: str, old: str, new: str) -> DataFrame:
    """Line-by-position differences; both texts are on the row, so no join."""
    pairs = F.arrays_zip(F.split(old, "\n").alias("o"), F.split(new, "\n").alias("n"))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(pairs).alias("line_no", "p"))
    rows = rows.filter(~F.col("p.o").eqNullSafe(F.col("p.n")))
    ops = F.array_compact(F.array(
        F.when(F.col("p.o").isNotNull(), F.struct(F.lit("-").alias("op"), F.col("p.o").alias("text"))),
        F.when(F.col("p.n").isNotNull(), F.struct(F.lit("+").alias("op"), F.col("p.n").alias("text"))),
    ))
    return rows.select("id", "line_no", F.inline(ops))
