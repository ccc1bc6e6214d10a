"""Result sinks and the snapshot store as partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def safe_name(col):
    return F.regexp_replace(col, r"[^A-Za-z0-9_-]", "_")


def write_by_kind(df: DataFrame, path: str, kind: str = "kind", name: str = "name") -> None:
    """One folder per operation kind; variants go apart when flagged."""
    group = F.when(F.col("is_variant"), "variants").otherwise("queries") if "is_variant" in df.columns else F.lit("queries")
    out = df.withColumns({"file_name": safe_name(F.col(name)), "section": group})
    out.write.mode("overwrite").partitionBy("section", kind).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat = [F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key by a map-side combined fold, not a sort per key."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def append_snapshots(df: DataFrame, path: str) -> None:
    """Append-only log of captures, partitioned by version and day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("version", "day").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Current state: the last capture per (query_id, version)."""
    return latest_per_key(spark.read.parquet(path), ["query_id", "version"], ["ts"])


def snapshot_pairs(store: DataFrame, key: str = "query_id", payload: str = "payload") -> DataFrame:
    return store.groupBy(key).pivot("version", ["baseline", "transformed"]).agg(F.first(payload, ignorenulls=True))


def stored_ids(store: DataFrame, key: str = "query_id") -> DataFrame:
    return store.select(key).distinct()


def export_pairs(store: DataFrame, key: str = "query_id") -> DataFrame:
    pairs = snapshot_pairs(store, key)
    return pairs.select(key, F.to_json(F.struct("baseline", "transformed")).alias("pair"))


def apply_retention(df: DataFrame, cutoff, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of dropped)."""
    old = F.col(ts) < cutoff
    return df.filter(~old), df.agg(F.count_if(old).alias("dropped"))


def write_reports(df: DataFrame, path: str, id_col: str = "report_id") -> None:
    df.write.mode("append").partitionBy("kind").parquet(path) if "kind" in df.columns else df.write.mode("append").parquet(path)


def write_text_diffs(diffs: DataFrame, path: str, buckets: int = 64) -> None:
    """``id, line_no, op, text`` rows in id buckets, so one id reads one bucket."""
    out = diffs.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    out.write.mode("overwrite").partitionBy("bucket").parquet(path)
