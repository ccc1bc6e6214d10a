"""Contiguous shards of equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.prefix import range_ordered, running_sums
from tidewright.session import checkpoint


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Every row of ``docs`` in one of ``shards`` contiguous shards of nearly equal bytes.

    Rows are ordered by the hash of the text, then the id, so equal texts stand side by side. Byte sizes (UTF-8 bytes of the text
    plus ``overhead``) are summed per range of that order, the ranges' totals give each row its global start, and a row belongs
    to the shard that holds its middle byte. A run of equal texts that a cut would split goes as a whole to the shard of its own
    middle when it is no larger than the largest single row; larger runs are split, since a run may exceed a shard. So no shard
    differs from the mean by more than the largest row at each end.

    Returns (id, size, text_crc32, shard, slot): ``slot`` counts rows of the shard from 0 without gaps. A null text has no bytes
    and checksum 0, as an empty one. Rows may repeat, ids may be null; an empty table gives an empty result. Other columns of
    ``docs`` are not carried.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_run"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    order = [F.col("_run"), F.col(id_col)]
    placed = checkpoint(running_sums(range_ordered(rows, *order), order, {"_end": "size", "_rank": "_one"}))
    whole = placed.agg(F.max("_end").alias("_total"), F.max("size").alias("_largest"))

    def middle(start, size):
        return F.least(F.expr(f"(2 * {start} + {size}) * {shards} div (2 * _total)"), F.lit(shards - 1)).cast("int")

    first = placed.crossJoin(F.broadcast(whole)).withColumn("_start", F.col("_end") - F.col("size")).withColumn("shard", middle("_start", "size"))
    # at most two runs touch each cut: the last of one shard and the first of the next
    edges = first.groupBy("shard").agg(F.min_by("_run", "_end").alias("_lo"), F.max_by("_run", "_end").alias("_hi"))
    at_cut = edges.select(F.explode(F.array("_lo", "_hi")).alias("_run")).distinct()
    runs = first.join(F.broadcast(at_cut), "_run").groupBy("_run").agg(
        F.min("_start").alias("_start"), F.sum("size").alias("_bytes"), F.first("_total").alias("_total"), F.first("_largest").alias("_largest"))
    moved = runs.filter("_bytes <= _largest").select("_run", middle("_start", "_bytes").alias("_moved"))
    settled = first.join(F.broadcast(moved), "_run", "left").withColumn("shard", F.coalesce("_moved", "shard"))
    starts = settled.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return settled.join(F.broadcast(starts), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))
