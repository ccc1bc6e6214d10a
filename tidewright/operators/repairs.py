"""Repairs derived from differences, their application, and text diffs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import json_trees
from tidewright.functions.text import TOKEN_PATTERN
from tidewright.operators import diff as D
from tidewright.operators.extraction import once

# The repair each difference type asks for.
ACTIONS = (
    ("missing-field", "add-field"),
    ("extra-field", "remove-field"),
    ("type-mismatch", "convert-type"),
    ("value-change", "map-value"),
    ("null-mismatch", "handle-null"),
    ("array-order", "reorder-array"),
    ("array-length", "adjust-array"),
)


def action_of(type_: Column) -> Column:
    out = None
    for source, action in ACTIONS:
        out = F.when(type_ == source, action) if out is None else out.when(type_ == source, action)
    return out


def derive_repairs(diffs: DataFrame) -> DataFrame:
    """Repair rows for the fixable differences; unmappable values are dropped."""
    rows = diffs.filter("fixable").withColumn("action", action_of(F.col("type")))
    mappable = ~F.col("base_type").isin("object", "array", "null") & ~F.col("cand_type").isin("object", "array", "null")
    rows = rows.filter((F.col("action") != "map-value") | mappable)
    return rows.select(
        "id", "path", "segments", "action", F.size("segments").alias("depth"),
        F.col("candidate").alias("from_value"), F.col("baseline").alias("to_value"),
    )


def _repairs_of(diffs: Column, moved: Column) -> Column:
    """Repairs of one pair as structs for ``json_trees.edit``; ``moved`` has the baseline text of reordered lists. A repair without a value is left out."""
    def value(d):
        whole = F.get(F.filter(moved, lambda m: m["path"] == json_trees.path_of(d["segments"])), F.lit(0))["text"]
        text = F.when(d["base_type"] == "string", F.regexp_extract(F.to_json(F.array(d["baseline"])), r"^\[([\s\S]*)\]$", 1)).otherwise(F.coalesce(d["baseline"], F.lit("null")))
        return F.when(d["type"] == "array-order", whole).otherwise(text)

    found = F.transform(
        F.filter(diffs, lambda d: d["fixable"] & (F.size(d["segments"]) > 1) & (F.get(d["segments"], F.lit(0)) == "data")),
        lambda d: F.struct(d["segments"].alias("segments"), action_of(d["type"]).alias("action"), value(d).alias("value")),
    )
    return F.filter(found, lambda r: r["value"].isNotNull())


def apply_repairs(pairs: DataFrame, cfg: D.CompareConfig | None = None) -> DataFrame:
    """The pairs with the candidate repaired toward the baseline.

    Both texts are already on one row, so repairs are derived and applied there
    without another shuffle: members of the root are replaced in the text, for other repairs it is read. Malformed candidates and those without a repair stay as they are.
    """
    compared = D.compare_pairs(pairs, cfg, keep=True).withColumn("_fixes", _repairs_of(F.col("diffs"), F.col("_p.moved")))
    some = F.size("_fixes") > 0
    compared = compared.withColumn("_text", F.when(some & F.col("_p.parted"), json_trees.edit_members("_p_code", "_fixes")))
    compared = json_trees.with_tree(compared.withColumn("_read", F.when(some & F.col("_text").isNull(), F.col("_p_code"))), "_read", "_p_tree", "data", read=False)
    fixed = F.when(F.col("_text").isNotNull(), F.col("_text")).when(F.col("_p_tree").isNull(), F.col("_was")).otherwise(json_trees.edit(F.col("_p_tree"), F.col("_fixes")))
    # a filter on the repaired text must not be moved below its making, which would be written out anew for every use of a column
    return once(compared.withColumnRenamed("cand_data", "_was"), cand_data=fixed).select(*pairs.columns)


def verify_repairs(pairs: DataFrame, cfg: D.CompareConfig | None = None) -> DataFrame:
    return D.compare_pairs(apply_repairs(pairs, cfg), cfg)


def remap_json(df: DataFrame, col: str, renames: Sequence[tuple[str, str]], head: int | None = None) -> DataFrame:
    """Recursive key rename (``a.b`` nests) with arrays cut to their first ``head``."""
    table = dict(renames)

    @F.pandas_udf("string")
    def remap(texts: pd.Series) -> pd.Series:
        def walk(v):
            if isinstance(v, list):
                return [walk(x) for x in (v if head is None else v[:head])]
            if not isinstance(v, dict):
                return v
            out: dict = {}
            for k, x in v.items():
                *parents, last = table.get(k, k).split(".") if k in table else [k]
                at = out
                for p in parents:
                    at = at.setdefault(p, {})
                at[last] = walk(x)
            return out

        return pd.Series([None if t is None else json.dumps(walk(json.loads(t)), separators=(",", ":"), ensure_ascii=False) for t in texts])

    return df.withColumn(col, remap(F.col(col)))


SHORT, MARKS = 4096, 1 << 28  # places of a text that all are marked at once, and bits that marks of a longer one may take


def _marks(y: np.ndarray) -> Callable[[int], int]:
    """For a token a number with a bit set for each of its places in ``y``."""
    places: dict[int, int] = {}
    if len(y) <= SHORT:
        for j, t in enumerate(y.tolist()):
            places[t] = places.get(t, 0) | 1 << j
        return lambda t: places.get(t, 0)

    def marks(t: int) -> int:
        bits = places.get(t)
        if bits is None:
            bits = int.from_bytes(np.packbits(y == t, bitorder="little").tobytes(), "little")
            if (len(places) + 1) * len(y) <= MARKS:
                places[t] = bits
        return bits

    return marks


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and every head of ``y``.

    A row of the table is a number with a bit for each place of ``y``, unset where the length grows: a step on ``x`` is four operations on it.
    """
    marks, full = _marks(y), (1 << len(y)) - 1
    row = full
    for t in x.tolist():
        hits = row & marks(t)
        if hits:
            row = (row + hits | row - hits) & full
    grown = np.unpackbits(np.frombuffer((full ^ row).to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(y)]
    return np.concatenate([[0], np.cumsum(grown, dtype=np.int64)])


def common_steps(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order, in memory linear in the lengths.

    ``x`` is halved and ``y`` cut where the halves' lengths add up best; parts wait on a stack, the earliest on top.
    """
    parts = [(0, len(x), 0, len(y))]
    while parts:
        a, b, c, d = parts.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            hits = np.flatnonzero(y[c:d] == x[a])
            if len(hits):
                yield a, c + int(hits[0])
            continue
        mid = (a + b) // 2
        cut = c + int(np.argmax(_lengths(x[a:mid], y[c:d]) + _lengths(x[mid:b][::-1], y[c:d][::-1])[::-1]))
        parts += [(mid, b, cut, d), (a, mid, c, cut)]


FEW = 256  # edits that a frontier is followed for; texts further apart are halved


def _run(x: np.ndarray, y: np.ndarray, i: int, j: int) -> int:
    """How many places from ``i`` and ``j`` on are equal."""
    done, step = 0, 32
    most = min(len(x) - i, len(y) - j)
    while done < most:
        part = x[i + done:i + min(done + step, most)] != y[j + done:j + min(done + step, most)]
        hit = int(part.argmax()) if part.any() else len(part)
        done += hit
        if hit < len(part):
            break
        step *= 2
    return done


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the edits between two sequences: tokens that one holds more often than the other."""
    most = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    return int(np.abs(np.bincount(x, minlength=most) - np.bincount(y, minlength=most)).sum())


def few_steps(x: np.ndarray, y: np.ndarray, most: int = FEW) -> list[tuple[int, int]] | None:
    """Index pairs of a longest common subsequence of sequences at most ``most`` insertions and deletions apart, else None.

    For each number of edits the furthest place reached on every diagonal is kept, all diagonals in one step; the time is the length times
    the edits at most. ``trace`` has the places before each number of edits, by diagonal from ``-edits - 1`` on.
    """
    n, m = len(x), len(y)
    if _apart(x, y) > most:
        return None
    reach, trace = np.array([-1, 0], np.int64), []  # diagonals -1 and 1 before the first edit
    for edits in range(min(most, n + m) + 1):
        trace.append(reach)
        k = np.arange(-edits, edits + 1, 2)
        below, above = reach[:-1], reach[1:]
        down = below < above
        down[0] = True
        if edits:
            down[-1] = False
        i = np.where(down, above, below + 1)
        going = np.flatnonzero((i < n) & (i >= 0) & (i - k < m) & (i - k >= 0))
        for _ in range(8):
            going = going[x[i[going]] == y[i[going] - k[going]]]
            i[going] += 1
            going = going[(i[going] < n) & (i[going] - k[going] < m)]
            if not len(going):
                break
        for g in going.tolist():  # the long runs
            i[g] += _run(x, y, int(i[g]), int(i[g] - k[g]))
        if ((i >= n) & (i - k >= m)).any():
            return _back(trace, n, m)
        reach = np.concatenate([[-1], i, [-1]])
    return None


def _back(trace: list[np.ndarray], n: int, m: int) -> list[tuple[int, int]]:
    """The equal places on the way that ``trace`` took to the ends."""
    pairs: list[tuple[int, int]] = []
    i, j = n, m
    for edits in range(len(trace) - 1, -1, -1):
        k = i - j
        at = (k + edits) // 2
        below, above = int(trace[edits][at]), int(trace[edits][at + 1])
        down = k == -edits or (k != edits and below < above)
        last = (above, above - k - 1) if down else (below, below - k + 1)
        start = (last[0], last[1] + 1) if down else (last[0] + 1, last[1])
        start = start if edits else (0, 0)
        pairs += zip(range(i - 1, start[0] - 1, -1), range(j - 1, start[1] - 1, -1))
        i, j = last
    return pairs[::-1]


def word_diff(df: DataFrame, id_col: str, old: str, new: str) -> DataFrame:
    """Token-level changes by longest common subsequence: one row per change.

    Texts few edits apart take time in proportion to their length; others are halved, in memory linear in the texts of a pair.
    Rows are dealt over ``spark.sql.shuffle.partitions`` tasks, since few bytes of text may be much work.
    """
    split = re.compile(TOKEN_PATTERN)

    def blocks(a, b):
        lo = 0
        while lo < min(len(a), len(b)) and a[lo] == b[lo]:
            lo += 1
        ha, hb = len(a), len(b)
        while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
            ha, hb = ha - 1, hb - 1
        x, y = a[lo:ha], b[lo:hb]
        numbers = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
        coded = [np.array([numbers[t] for t in tokens], np.int64) for tokens in (x, y)]
        kept = few_steps(*coded)
        kept = list(common_steps(*coded)) if kept is None else kept
        i = j = 0
        for p, q in kept + [(len(x), len(y))]:
            if p > i or q > j:
                yield lo + i, x[i:p], y[j:q]
            i, j = p + 1, q + 1

    schema = "array<struct<token_no int, op string, old_text string, new_text string>>"

    @F.pandas_udf(schema)
    def changes(olds: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for o, n in zip(olds, news):
            a, b = ([m.group(0) for m in split.finditer(t or "")] for t in (o, n))
            out.append([
                (at, "replace" if x and y else "delete" if x else "add", "".join(x) or None, "".join(y) or None)
                for at, x, y in blocks(a, b)
            ])
        return pd.Series(out)

    rows = df.select(F.col(id_col).alias("id"), F.col(old).alias("_old"), F.col(new).alias("_new"))
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("id", F.inline(changes("_old", "_new")))


def convert_value(value: Column, to_type: str) -> Column:
    """String / number / boolean conversion; null where there is no value."""
    if to_type == "string":
        return value.cast("string")
    if to_type == "number":
        return value.try_cast("double")
    if to_type == "boolean":
        text = value.cast("string")
        return F.when(value.isNull() | (text == "") | (text == "0") | (text == "false"), False).otherwise(True)
    return value


def in_order(repairs: DataFrame) -> DataFrame:
    """Application order per id: deepest path first."""
    w = Window.partitionBy("id").orderBy(F.desc("depth"), "path")
    return repairs.withColumn("step", F.row_number().over(w))
