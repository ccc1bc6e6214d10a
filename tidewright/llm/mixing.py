"""Mixing of sources to target shares by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.prefix import range_ordered, running_sums
from tidewright.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size) with rank, weight, cap and target.

    Sources are ranked by code point, null last, and take ``weights`` in turn. Targets share ``share`` times all sizes by weight,
    no target above ``limit`` times its source; the excess is shared again by weight until none is above, which is one common
    level: target = min(cap, weight * level).
    """
    by_rank, by_ratio, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_ratio", "rank"), Window.partitionBy()
    turn = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") % len(weights))
    ranked = sizes.withColumn("rank", F.row_number().over(by_rank) - 1).withColumn("weight", turn)
    capped = ranked.withColumn("cap", limit * F.col("source_size")).withColumn("_ratio", F.col("cap") / F.col("weight"))
    filled = capped.withColumns({
        "_budget": share * F.sum("source_size").over(everything),
        "_full": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_open": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "rank", "_level"))).over(everything)["_level"]
    return filled.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0)))).select("source", "source_size", "rank", "weight", "cap", "target")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: int = 2, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mix takes each row of ``docs``: (id, source, size, source_size, target, copies, taken) and ``carry``.

    Each source is shuffled by a keyed digest of the id and offered up to ``limit`` times over. A document's virtual finish time
    is the cumulative words of its source, itself included, divided by the source's target. All offers are sorted by finish time
    over ranges, summed globally, and taken while the words before them are below the budget. Sums are integers and every order
    is total up to equal rows, so reruns agree.

    Null texts and empty texts have size 0 and are never taken; a null source is a source, the last; repeated rows count each
    for itself; a table without words takes nothing; an empty table gives an empty result.
    """
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = docs.select(
        ident.alias("_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary")).alias("_key"),
        *(F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry),
    )
    rows = range_ordered(rows, F.col("source"), F.col("_key"), F.col("size"))
    targets = checkpoint(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit))
    budget = share * F.sum("source_size")
    order = [F.col("_key"), F.col("size"), F.col("_row")]
    summed = running_sums(rows.withColumn("_row", F.monotonically_increasing_id()), order, {"_cum": "size"}, by=("source",))
    t = targets.select(F.col("source").alias("_source"), "source_size", "rank", "target")
    placed = summed.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_part")
    offers = placed.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    finish = (F.col("_turn") * F.col("source_size") + F.col("_cum")) / F.col("target")
    offers = offers.withColumn("_finish", F.when(F.col("target") > 0, finish))
    order = [F.col("_finish").asc_nulls_last(), F.col("rank"), F.col("_turn"), F.col("_key"), F.col("size"), F.col("_row")]
    queue = running_sums(range_ordered(offers, *order[:4]), order, {"_end": "size"})
    queue = queue.crossJoin(F.broadcast(targets.agg(budget.alias("_budget"))))
    take = (F.col("_end") - F.col("size") < F.col("_budget")) & (F.col("size") > 0) & F.col("_finish").isNotNull()
    kept = {c: F.first(c) for c in ("_id", "source", "size", "source_size", "target", *(f"_carry_{c}" for c in carry))}
    out = queue.groupBy("_row").agg(*(v.alias(k) for k, v in kept.items()), F.sum(take.cast("int")).alias("copies"))
    return out.select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"),
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), *(F.col(f"_carry_{c}").alias(c) for c in carry),
    )
