"""Extension points: extraction strategies and field mappings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.extraction import all_matches, once


@dataclass(frozen=True)
class Strategy:
    """``handles(path)`` tells which files it takes, ``blocks(text)`` what it finds."""

    name: str
    handles: Callable[[Column], Column]
    blocks: Callable[[Column], Column]


def regex_strategy(name: str, path_pattern: str, block_pattern: str, group: int = 1) -> Strategy:
    return Strategy(name, lambda p: p.rlike(path_pattern), lambda t: all_matches(t, block_pattern, group))


def extract_with(files: DataFrame, strategies: Sequence[Strategy], path: str = "path", text: str = "content") -> DataFrame:
    """Per file the blocks of the first strategy that handles it and finds any."""
    found = F.lit(None).cast("struct<strategy:string,blocks:array<string>>")
    for s in reversed(list(strategies)):
        blocks = s.blocks(F.col(text))
        test = s.handles(F.col(path)) & (F.size(blocks) > 0)
        found = F.when(test, F.struct(F.lit(s.name).alias("strategy"), blocks.alias("blocks"))).otherwise(found)
    # Outer explode, then a test on its output: a test on the blocks themselves
    # would be pushed down and run every pattern twice.
    rows = once(files, _f=found)
    keep = [c for c in files.columns if c != text]
    out = rows.select(*keep, F.col("_f.strategy").alias("strategy"), F.posexplode_outer("_f.blocks").alias("block_no", "block"))
    return out.filter("block_no IS NOT NULL")


@dataclass(frozen=True)
class FieldMapping:
    source: str
    target: str
    transform: Callable[[Column], Column] | None = None


def map_fields(df: DataFrame, json_col: str, mappings: Sequence[FieldMapping]) -> DataFrame:
    """Adds one column per mapping, read from its source path and transformed."""
    def value(m: FieldMapping) -> Column:
        raw = F.get_json_object(json_col, f"$.{m.source}")
        return (m.transform(raw) if m.transform else raw).alias(m.target)

    return df.select("*", *[value(m) for m in mappings])
