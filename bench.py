"""Times headline queries on ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewright.catalogue import QUERIES  # noqa: E402
from tidewright.session import build_session  # noqa: E402

HEADLINE = (
    "usage_report", "category_report", "data_dictionary", "unique_fields", "match_patterns",
    "extract_blocks", "normalize_text_documents", "fingerprints", "mine_access", "snippet_profile", "duplicate_groups",
    "mine_rules", "conformance", "classify_by_catalog", "validate_multi",
    "group_operations", "pairwise_overlap", "group_similar_operations", "reference_closure", "reconcile", "expand_variants",
    "rewrite_operations", "confidence_score", "semantic_check",
    "compare_snapshots", "diff_rows", "verify_repairs", "line_diff",
    "operation_health", "percentile_ceil_rule", "arm_metrics", "significance", "rollout_state", "latest_checkpoint_as_of",
    "upsert_snapshots", "stream_health", "mine_usages", "rewrite_typed", "apply_rule_lookup", "resolve_templates", "inline_references_in_place",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["usage_top_fields"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median wall time per headline query", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
