"""The three end-to-end jobs and the audit, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import hashing
from tidewright.functions import text as T
from tidewright.operators import catalog as C
from tidewright.operators import diff as D
from tidewright.operators import experiments as E
from tidewright.operators import extraction as X
from tidewright.operators import repairs as R
from tidewright.operators import rewrite as W
from tidewright.operators import usage as U
from tidewright.operators.strategies import Strategy, extract_with


def extract_operations(
    files: DataFrame, strategies: Sequence[Strategy], endpoints: Sequence[tuple[str, str, Sequence[str]]] = (), default_endpoint: str = "default"
) -> DataFrame:
    """Files to the public operation rows, fingerprinted and uniquely named."""
    blocks = extract_with(files, strategies)
    text = F.col("block")
    kind = F.coalesce(T.op_kind(text), F.lit("query"))
    ops = blocks.select(
        F.concat_ws("#", "path", F.col("block_no").cast("string")).alias("id"), F.col("path").alias("file_path"),
        text.alias("content"), T.infer_name(F.coalesce(T.op_name(text), F.lit("")), text, F.col("path"), kind).alias("name"),
        F.col("strategy").alias("source"),
    )
    named = X.uniquify_names(ops, "name", "content", "id").withColumn("name", F.col("unique_name"))
    endpoint = T.classify_endpoint(F.col("file_path"), F.col("content"), endpoints, default_endpoint)
    out = X.standardize(named.withColumn("endpoint", endpoint))
    return out.withColumn("fingerprint", hashing.fingerprint(T.normalize_text(F.col("content"))))


def migrate(ops: DataFrame, usages: DataFrame, rules: DataFrame, aliases: Sequence[tuple[str, str]] = (), root_type: str | None = None) -> DataFrame:
    """Operations and rules to rewritten, scored and gated rows.

    ``usages``: id, type_name, field_name, pos, path, is_root.
    """
    ruled = C.apply_rule_lookup(usages, C.with_aliases(rules, aliases) if aliases else rules, root_type)
    changes = W.change_rows(ruled.filter(F.col("is_vague").isNotNull()))
    done = W.rewrite_delta(W.rewrite(ops, changes)).select("id", "transformed", "needs_review")
    labels = W.pattern_label(changes)
    c = F.col("content")
    rows = ops.join(done, "id").join(labels, "id").select(
        "id", "file_path", c.alias("source"), "transformed", "needs_review", "pattern", "changes",
        F.size(T.spread_refs(c)).alias("fragments"), F.size(F.array_distinct(X.all_matches(c, r"\$([A-Za-z_]\w*)\s*:"))).alias("variables"),
        T.brace_depth(c).alias("depth"), F.size(X.all_matches(c, r"(?m)^\s*([A-Za-z_]\w*)")).alias("fields"),
    )
    return W.gate(W.score_changes(rows))


def validate(base: DataFrame, cand: DataFrame, cfg: D.CompareConfig | None = None) -> dict[str, DataFrame]:
    """Two snapshot sets to verdicts, summary, breaking changes and repairs."""
    compared = D.compare_pairs(D.pair_snapshots(base, cand), cfg)
    diffs = D.diff_rows(compared)
    return {
        "comparisons": compared, "differences": diffs, "summary": D.validation_summary(compared),
        "breaking": D.breaking_changes(compared), "repairs": R.derive_repairs(diffs), "gate": D.ci_gate(compared),
    }


def rollout_decision(calls: DataFrame, stages: DataFrame, stage: Column) -> DataFrame:
    """Arm metrics to significance, graduation and rollback per experiment."""
    metrics = E.arm_metrics(calls)
    grown = E.can_graduate(metrics.withColumn("stage", stage), stages)
    return E.significance(metrics).join(E.should_roll_back(metrics).select("experiment", "roll_back", "cause"), "experiment").join(grown, "experiment")


def audit(snippets: DataFrame, unit: str, text: str, category: Column) -> dict[str, DataFrame]:
    """Snippets to the access fact and the reports built on it."""
    access = X.mine_access(snippets, unit, text)
    profiles = X.profile_snippets(snippets, unit, text)
    return {
        "access": access, "profiles": profiles, "usage": U.usage_report(access), "categories": U.category_report(access, category),
        "dictionary": U.data_dictionary(access, category), "bands": U.usage_bands(access), "flags": U.field_flags(access),
        "advice": U.advice(access, profiles),
    }
