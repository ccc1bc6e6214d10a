"""Near-duplicate vectors by spherical-cap filters."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidewright.llm.components import connected_components
from tidewright.session import checkpoint

SHARED = 12.0  # filters that two vectors at the threshold share on average
TABLES = 8  # independent code books; filters of one book share code words, so their misses go together
PER_CAP = 4.0  # vectors of random directions in one cap
CHUNK = 1024


def _beyond(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def cap_plan(vectors: int, cosine: float, shared: float = SHARED, per_cap: float = PER_CAP) -> tuple[float, int]:
    """(height of the caps, code words per half and book): caps as high as leaves ``per_cap`` of the vectors in each, and so many of
    them that two vectors at the threshold meet in ``shared``."""
    low, high = 1.5, 40.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if vectors * _beyond(mid) > per_cap else (low, mid)
    x = np.linspace(low, low + 8, 4001)
    rest = math.sqrt(max(1 - cosine * cosine, 1e-12))
    tails = np.array([_beyond((low - cosine * v) / rest) for v in x])
    both = np.trapezoid(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * tails, x)
    return low, max(2, math.ceil(math.sqrt(shared / both / TABLES)))


@functools.lru_cache(maxsize=4 * TABLES)
def _codes(dim: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random code words for either half of the components; the sum of one of each is a filter direction."""
    return tuple(np.random.default_rng([seed, dim, half]).standard_normal((words, width)) for half, width in enumerate((dim // 2, dim - dim // 2)))


def caps_of(unit: np.ndarray, height: float, words: int, seed: int) -> list[np.ndarray]:
    """List decoding: for each unit vector the numbers of all filters whose inner product with it exceeds ``height``.

    A filter is a pair of code words and its product the sum of the halves' products, so that only words that can still reach
    the height with the best partner are combined.
    """
    out = [[] for _ in unit]
    for book in range(TABLES):
        left, right = _codes(unit.shape[1], words, seed + book)
        for held, a, b in zip(out, unit[:, :left.shape[1]] @ left.T, unit[:, left.shape[1]:] @ right.T, strict=True):
            order = np.argsort(-b)
            falling = -b[order]
            able = np.flatnonzero(a - falling[0] >= height)
            reach = np.searchsorted(falling, a[able] - height, side="right")
            partner = order[np.concatenate([np.arange(r) for r in reach])] if len(able) else np.zeros(0, np.int64)
            held.append(np.sort((book * words + np.repeat(able, reach)) * words + partner))
    return [np.concatenate(held) for held in out]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def linked(one: np.ndarray, other: np.ndarray, cosine: float) -> np.ndarray:
    """Which vectors of both tables have at least this cosine, in double precision."""
    norms = np.sqrt((one * one).sum(axis=1))[:, None] * np.sqrt((other * other).sum(axis=1))[None, :]
    return one @ other.T / norms >= cosine


def _decode(classes: DataFrame, height: float, words: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                dims = part.column("embedding").value_lengths().to_numpy()
                for dim in np.unique(dims):
                    some = part.filter(pa.array(dims == dim))
                    x = _vectors(some.column("embedding"))
                    caps = caps_of(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), height, words, seed)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(caps, pa.list_(pa.int64()))], [*some.schema.names, "caps"])

    return classes.mapInArrow(run, StructType([*classes.schema.fields, StructField("caps", ArrayType(LongType()))]))


def _cell(cap: int, caps: list[np.ndarray], node: np.ndarray, copies: np.ndarray, x: np.ndarray, side: np.ndarray, crossed: bool, cosine: float) -> tuple[np.ndarray, ...]:
    """(node, links, root) of the members of one cap that are linked there. A pair counts in the first cap it shares only."""
    near = linked(x, x, cosine)
    np.fill_diagonal(near, False)
    if crossed:
        near &= side[:, None] != side[None, :]
    sizes = [np.searchsorted(c, cap) for c in caps]
    flat = np.concatenate([c[:n] for c, n in zip(caps, sizes, strict=True)])
    owner = np.repeat(np.arange(len(caps)), sizes)
    _, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times > 1
    column = np.cumsum(common) - 1
    kept = common[where]
    earlier = np.zeros((len(caps), int(common.sum())), np.float32)
    earlier[owner[kept], column[where[kept]]] = 1
    links = (near & (earlier @ earlier.T == 0)) @ copies
    root = node.copy()
    while True:
        lower = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == root).all():
            break
        root = lower
    some = near.any(axis=1)
    return node[some], links[some], root[some]


def _links(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root) from rows (dim, cap, low, high, side, node, copies, embedding, caps); one pair of chunks of a cap at a time."""
    keys = ["dim", "cap", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            node, copies, side = (np.concatenate([h[k].to_numpy(zero_copy_only=False) for h in held]) for k in range(3))
            if len(node) > 1:
                x, caps = np.concatenate([_vectors(h[3]) for h in held]), [np.asarray(c) for h in held for c in h[4].to_pylist()]
                found = _cell(waiting[1], caps, node, copies, x, side, waiting[2] != waiting[3], cosine)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)) for f in found], ["node", "links", "root"])

        for batch in batches:
            at = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
            heads = np.flatnonzero(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(axis=0)])) if batch.num_rows else []
            for a, b in zip(heads, [*heads[1:], batch.num_rows], strict=True):
                if waiting is not None and (at[:, a] != waiting).any():
                    yield from flush()
                    held = []
                waiting = at[:, a]
                held.append(tuple(batch.column(k).slice(a, b - a) for k in ("node", "copies", "side", "embedding", "caps")))
        if held:
            yield from flush()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node bigint, links bigint, root bigint")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, shared: float = SHARED, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: how many other rows have at least this cosine, the smallest id reachable by such
    links, and whether it is the row's own.

    Equal vectors are one class and are not expanded. Each class is decoded to all caps it lies in; classes meet in caps, a
    cap of many members in pairs of chunks, and are compared in double precision. A pair is counted in the first cap
    it shares, so nothing is emitted per pair: a cap gives each linked member its count and the smallest node of its group. Pairs at
    the threshold share ``shared`` caps on average (the recall is measured in the tests); none below it is linked. The number
    and height of the caps follow from the number of vectors.

    Null vectors, empty and zero ones, and those with null or non-finite components link with nothing and are kept. Vectors of
    different lengths do not link. Repeated rows and ids are rows of their own, null ids too. An empty table gives an empty result.
    """
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), v.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_vector", F.when(sound, F.col("embedding"))).drop("embedding")
    classes = rows.filter("_vector IS NOT NULL").groupBy(F.col("_vector").alias("embedding")).agg(F.min("_id").alias("first"), F.count("*").alias("copies"))
    classes = checkpoint(classes).withColumn("node", F.monotonically_increasing_id())
    height, words = cap_plan(classes.count(), cosine, shared)
    decoded = checkpoint(_decode(classes.select("node", "copies", "embedding"), height, words, seed))
    placed = decoded.withColumn("dim", F.size("embedding")).withColumn("cap", F.explode("caps"))
    shared_caps = placed.groupBy("dim", "cap").agg(F.count("*").alias("_members")).filter("_members > 1")
    chunks = F.ceil(F.col("_members") / CHUNK).cast("int")
    cells = placed.join(shared_caps, ["dim", "cap"]).withColumn("_chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    cells = cells.withColumn("_with", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("low", F.least("_chunk", "_with")).withColumn("high", F.greatest("_chunk", "_with"))
    links = checkpoint(_links(cells.withColumn("side", F.col("_chunk") == F.col("low")).select("dim", "cap", "low", "high", "side", "node", "copies", "embedding", "caps"), cosine))
    comps = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(counted, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    roots = named.groupBy("comp").agg(F.min("first").alias("root"))
    named = named.join(roots, "comp").select(F.col("embedding").alias("_class"), "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    out = rows.join(named, F.col("_vector") == F.col("_class"), "left")
    component = F.when(F.col("_class").isNull(), F.col("_id")).otherwise(F.col("root"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
