"""Order-dependent operators that stay even when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpoint

def last_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, salts: int = 64) -> DataFrame:
    """The ``n`` latest rows per key; adds ``recency`` (1 = latest).

    Rows are first cut to ``n`` per key and salt, so no task ranks a whole hot key and the last step sees ``salts * n`` rows of it.
    """
    desc = [F.col(c).desc() for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    w = Window.partitionBy(*keys, "_salt").orderBy(*desc)
    cut = salted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r", "_salt")
    w = Window.partitionBy(*keys).orderBy(*desc)
    return cut.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt into ranges of (keys, order), stored once so that their ``_slice`` stays what it is."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(slices, *keys, *order)).withColumn("_slice", F.spark_partition_id())


def rank_rows(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str = "rank", weight: str | None = None) -> DataFrame:
    """``row_number`` per key in ``order``, or the running sum of ``weight``, with no task holding a whole key.

    Rows are numbered inside (key, slice of a range) and shifted by the totals of the key's earlier slices. Keys are not null.
    """
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    ranged = _sliced(df, keys, order)
    amount = F.lit(1) if weight is None else F.col(weight)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_n"))
    shift = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = ranged.withColumn(name, F.sum(amount).over(inside))
    return local.join(shift, [*keys, "_slice"]).withColumn(name, F.col(name) + F.col("_shift")).drop("_slice", "_shift")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, inclusive: bool = True) -> DataFrame:
    """The last non-null ``value`` per key up to each row (or before it) in ``order``, with no task holding a whole key."""
    keys, order = list(keys), list(order)
    ranged = _sliced(df, keys, order)
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    closing = ranged.groupBy(*keys, "_slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("_close"))
    brought = closing.select(*keys, "_slice", F.last("_close", ignorenulls=True).over(before).alias("_brought"))
    local = ranged.withColumn(name, F.last(value, ignorenulls=True).over(inside))
    return local.join(brought, [*keys, "_slice"]).withColumn(name, F.coalesce(name, "_brought")).drop("_slice", "_brought")


def rank_of(p: float, rule: str, n: Column) -> Column:
    """1-based rank of quantile ``p``: index ceil(n*p)-1 or floor(n*p)."""
    if rule == "ceil":
        return F.greatest(F.ceil(n * F.lit(p)), F.lit(1))
    if rule == "floor":
        return F.least(F.floor(n * F.lit(p)) + 1, n)
    raise ValueError(f"unknown percentile rule {rule}")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float], rule: str) -> DataFrame:
    """Exact order statistics per key without sorting a key in one task, however its values are spread.

    Equal values are folded to counts, the counts are summed over ranges of (key, value), and the value whose stretch holds a
    wanted rank is picked.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    summed = rank_rows(counts, keys, value, "_cum", weight="_c")
    totals = summed.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank_of(p, rule, F.col("_n")).alias("rank")) for name, p in ps.items()])
    hit = F.filter(wanted, lambda w: (w["rank"] <= F.col("_cum")) & (w["rank"] > F.col("_cum") - F.col("_c")))
    picked = summed.join(totals, keys).select(*keys, value, F.explode(hit).alias("w"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("w.name") == n, F.col(value))).alias(n) for n in ps])


def sample_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float], rule: str) -> DataFrame:
    """Percentiles over groups that are already bounded (last-N samples)."""
    keys = list(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    rows = df.withColumns({"_n": n, "_r": rank})
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_r") == rank_of(p, rule, F.col("_n")), F.col(value))).alias(name) for name, p in ps.items()]
    )


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, payload: Sequence[str]) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row of the same key.

    Both sides are dealt into ranges of (key, time) and the last row of a key's earlier ranges is brought in, so a hot key is
    spread evenly whatever its times. Of right rows at one time the one with the largest payload counts.
    """
    cargo = F.struct(F.col(right_ts).alias("_at"), *payload)
    r = right.groupBy(F.col(key), F.col(right_ts).alias("_ts")).agg(F.max(cargo).alias("_v")).filter(F.col(key).isNotNull())
    row = F.struct(*left.columns)
    lefts = left.select(F.col(key), F.col(left_ts).alias("_ts"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), row.alias("_l"), F.lit(1).alias("_side"))
    kind = lefts.schema["_l"].dataType
    both = lefts.filter(F.col(key).isNotNull()).unionByName(r.select(key, "_ts", "_v", F.lit(None).cast(kind).alias("_l"), F.lit(0).alias("_side")))
    seen = carry_forward(both, [key], ["_ts", "_side"], "_v", "_m").filter("_side = 1").select("_l", "_m")
    unkeyed = lefts.filter(F.col(key).isNull()).select("_l", F.col("_v").alias("_m"))
    return seen.unionByName(unkeyed).select("_l.*", F.col("_m._at").alias("as_of"), *[F.col(f"_m.{c}").alias(c) for c in payload])


def by_priority(df: DataFrame, label: str, order: Sequence[str], *rest: str) -> DataFrame:
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(label) == name, i).otherwise(rank)
    return df.orderBy(rank, *rest)


def trend(recent: Column, historical: Column) -> Column:
    return F.when(recent < historical * 0.9, "improving").when(recent > historical * 1.1, "degrading").otherwise("stable")
