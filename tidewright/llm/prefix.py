"""Running sums over a globally ordered table, without passing the rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpoint


def range_ordered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt into ranges of ``order`` and stored once, with the range's number as ``_part``.

    Storing it fixes the ranges: their bounds are sampled, so a second evaluation (a lost executor, a second branch) could
    otherwise deal rows differently.
    """
    return checkpoint(df.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())


def running_sums(ranged: DataFrame, order: list[Column], sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running totals of a table made by :func:`range_ordered`, over all rows or within each value of ``by``.

    ``sums`` maps a new column to the column it adds up. Each range is summed on its own; the totals of the ranges (one row
    per range, and per value of ``by`` that occurs in it) are added up in order and joined back.
    """
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["_part", *by]
    totals = ranged.groupBy(*keys).agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    offsets = totals.select(*(F.col(k).alias(f"_k{k}") for k in keys), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums))
    local = ranged.withColumns({f"_in_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    joined = local.join(offsets, same, "left")
    out = joined.withColumns({n: F.col(f"_in_{n}") + F.col(f"_off_{n}") for n in sums})
    return out.drop(*(f"_k{k}" for k in keys), *(f"_in_{n}" for n in sums), *(f"_off_{n}" for n in sums))
