"""Ranked lexical search of a set of items in all documents by two trees of coordinate maxima."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.prefix import range_ordered, running_sums
from tidewright.llm.textarrays import TERM, raw, slices, word_hashes, words
from tidewright.session import checkpoint

BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 17  # items searched together: at most so many, and so many bytes of text (or one item)
SEEDS = 4096  # documents, drawn by hash, whose scores give the first limits; they decide nothing but how early pairs are pruned
LEAF, FAN = 16, 16  # documents in a leaf, leaves in a node
ITEM_LEAF = 8  # items in a leaf
CELLS = 1 << 22  # coordinates of the leaves of one batch of documents
_FILTER = 1 << 20
_LAST = np.iinfo(np.int64).max


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and the terms before each text."""
    low, starts, stops, counted = words(*raw(column), member=TERM)
    return word_hashes(low, starts, stops), counted


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def term_vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(id, n, terms, tfs) of every row of ``docs`` (id, text): its terms, and those of them that the sorted ``vocabulary`` holds."""
    held = np.zeros(_FILTER, bool)
    held[(vocabulary % np.uint64(_FILTER)).astype(np.int64)] = True
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, counted = terms_of(part.column("text"))
            at = np.flatnonzero(held[(hashes % np.uint64(_FILTER)).astype(np.int64)])
            place = np.minimum(np.searchsorted(vocabulary, hashes[at]), size - 1) if size else at
            known = vocabulary[place] == hashes[at] if size else np.zeros(len(at), bool)
            row = np.searchsorted(counted, at[known], side="right") - 1
            keys, times = _counts(row * max(size, 1) + place[known])
            ends = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) * max(size, 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % max(size, 1), times)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(counted)), *lists], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


class ItemTree:
    """Items as vectors of term counts; leaves of items with a common heaviest term hold the largest count of each term."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, times: np.ndarray, count: int, weights: np.ndarray):
        # sums of up to 2^53 are exact in doubles, longer items are summed as integers
        total = np.zeros(count, np.float64)
        np.add.at(total, rows, times * weights[terms].astype(np.float64) * 1e6)
        self.kind = np.float64 if total.max(initial=0) < 2 ** 52 else np.int64
        self.vectors = np.zeros((count, len(weights)), self.kind)
        self.vectors[rows, terms] = times
        heaviest = (self.vectors * weights).argmax(axis=1) if len(weights) else np.zeros(count, np.int64)
        order = np.argsort(heaviest, kind="stable")
        self.leaf_of = np.empty(count, np.int64)
        self.leaf_of[order] = np.arange(count) // ITEM_LEAF
        self.order, self.heads = order, np.arange(0, count, ITEM_LEAF)
        self.leaves = np.maximum.reduceat(self.vectors[order], self.heads)
        self.root = self.leaves.max(axis=0, keepdims=True)


class Best:
    """The best (score, id) of each item so far, and its limit: what ranks behind it cannot be among the first ``k``."""

    def __init__(self, limits: np.ndarray, ids: np.ndarray, k: int):
        self.score, self.id, self.k = limits.copy(), ids.copy(), k
        self.held: list[list[tuple[int, int, bool]]] = [[] for _ in limits]

    def weakest(self, tree: ItemTree) -> tuple[np.ndarray, np.ndarray]:
        """The limit of each leaf's weakest item: lowest score, then largest id."""
        score, ident = self.score[tree.order], self.id[tree.order]
        low = np.minimum.reduceat(score, tree.heads)
        lowest = score == np.repeat(low, np.diff(np.append(tree.heads, len(score))))
        return low, np.maximum.reduceat(np.where(lowest, ident, -_LAST), tree.heads)

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        held = self.held[item] + list(zip((-scores).tolist(), ids.tolist(), nulls.tolist(), strict=True))
        held.sort()
        self.held[item] = held = held[:self.k]
        if len(held) == self.k and (-held[-1][0], -held[-1][1]) > (self.score[item], -self.id[item]):
            self.score[item], self.id[item] = -held[-1][0], held[-1][1]


def able(bounds: np.ndarray, lowest: np.ndarray, score: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """Pairs whose bound, for the lowest document id, does not rank behind the limit."""
    return (bounds > 0) & ((bounds > score[:, None]) | (bounds == score[:, None]) & (lowest[None, :] <= ident[:, None]))


def search_batch(items: ItemTree, best: Best, ids: np.ndarray, nulls: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
    """Offers to ``best`` all documents of a batch that may be among an item's first ones.

    Documents stand in order of their two heaviest terms, in leaves and nodes that hold the largest value of each term. The dot product
    of two nodes' maxima bounds the score of each pair below them; a pair of nodes goes when that bound ranks behind the limit of the
    weakest item under it, so whole batches go at once and no document of the result can.
    """
    count, size = len(ids), items.vectors.shape[1]
    heavy = np.lexsort((-values, rows))
    first = np.searchsorted(rows[heavy], np.arange(count))
    second = np.minimum(first + 1, len(heavy) - 1)
    other = np.where(rows[heavy][second] == np.arange(count), terms[heavy][second], -1)
    order = np.lexsort((ids, other, terms[heavy][first]))
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    at, ids, nulls = place[rows], ids[order], nulls[order]
    leaves = np.zeros(((count - 1) // LEAF + 1, size), items.kind)
    np.maximum.at(leaves.reshape(-1), at // LEAF * size + terms, values)
    heads = np.arange(0, len(leaves), FAN)
    nodes = np.maximum.reduceat(leaves, heads)
    leaf_id = np.minimum.reduceat(ids, np.arange(0, count, LEAF))
    node_id = np.minimum.reduceat(leaf_id, heads)
    by_place = np.argsort(at, kind="stable")
    at, terms, values = at[by_place], terms[by_place], values[by_place]
    top = items.root @ nodes.T
    for node in np.argsort(-top[0], kind="stable"):
        score, ident = best.weakest(items)
        if not able(items.leaves @ nodes[node][:, None], node_id[node:node + 1], score, ident).any():
            continue
        here = np.arange(node * FAN, min((node + 1) * FAN, len(leaves)))
        pairs = able(items.leaves @ leaves[here].T, leaf_id[here], score, ident)
        some = np.flatnonzero(pairs[items.leaf_of].any(axis=1))
        if not len(some):
            continue
        single = pairs[items.leaf_of[some]] & able(items.vectors[some] @ leaves[here].T, leaf_id[here], best.score[some], best.id[some])
        some, here = some[single.any(axis=1)], here[single.any(axis=0)]
        if not len(some):
            continue
        docs = (here[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < count]
        begin, end = np.searchsorted(at, docs), np.searchsorted(at, docs, side="right")
        owner = np.repeat(np.arange(len(docs)), end - begin)
        entry = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
        dense = np.zeros((len(docs), size), items.kind)
        dense[owner, terms[entry]] = values[entry]
        exact = items.vectors[some] @ dense.T
        near = able(exact, np.zeros(1, np.int64) - _LAST, best.score[some], best.id[some])
        near &= (exact > best.score[some][:, None]) | (ids[docs][None, :] <= best.id[some][:, None])
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            hit = docs[near[i]]
            best.offer(int(some[i]), exact[i, near[i]].astype(np.int64), ids[hit], nulls[hit])


def _search(vectors: DataFrame, items: tuple, weights: np.ndarray, totals: tuple[int, int], limits: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(item, id, score): each task's best ``k`` documents of every item that its limit allows."""
    count, texts, length = len(limits[0]), *totals
    size = int(min(4096, max(LEAF * FAN, CELLS // max(1, len(weights)) * LEAF)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, best = ItemTree(*items, count, weights), Best(*limits, k)
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                n = part.column("n").to_numpy()
                ids, nulls = pc.fill_null(part.column("id"), _LAST).to_numpy(), part.column("id").is_null().to_numpy(zero_copy_only=False)
                terms, tfs = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                rows = np.repeat(np.arange(part.num_rows), part.column("terms").value_lengths().to_numpy())
                m = 75 + 25 * n * texts // length
                values = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m[rows]))
                search_batch(tree, best, ids, nulls, rows, terms, values)
        found = [(item, None if null else ident, -score) for item, held in enumerate(best.held) for score, ident, null in held]
        if found:
            item, ident, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ident, pa.int64()), pa.array(score, pa.int64())], ["item", "id", "score"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, "item int, id bigint, score bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """(item, id, score, rank) of one block of items."""
    spark = docs.sparkSession
    hashes, counted = terms_of(pa.array(texts, pa.string()))
    vocabulary = np.unique(hashes)
    keys, times = _counts(np.repeat(np.arange(len(texts)), np.diff(counted)) * max(1, len(vocabulary)) + np.searchsorted(vocabulary, hashes))
    items = (keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), times)
    vectors = checkpoint(term_vectors(docs, vocabulary))
    texts_n, length = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not len(vocabulary) or not length:
        return spark.createDataFrame([], "item int, id bigint, score bigint, rank int")
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the block at most
    held = np.zeros(len(vocabulary), np.int64)
    held[df["term"].to_numpy()] = df["count"].to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * texts_n + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
    none = np.zeros(len(texts), np.int64), np.full(len(texts), _LAST)
    drawn = F.pmod(F.xxhash64("id", "n"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SEEDS / texts_n))
    seeds = _first(_search(vectors.filter(drawn), items, weights, (texts_n, length), none, k), k).filter(F.col("rank") == k)
    score, ident = none
    for item, i, s in seeds.select("item", "id", "score").collect():  # one row an item at most
        score[item], ident[item] = s, _LAST if i is None else i
    return _first(_search(vectors, items, weights, (texts_n, length), (score, ident), k), k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item id, rank, id, score) of the ``k`` highest-scoring rows of ``docs`` for each row of ``items``; ids of documents are bigints.

    Terms are runs of ASCII letters, digits and all that is not ASCII, A-Z in lower case. With N texts that have a term, L terms
    in all, n terms in a document, tf occurrences of a term there, and df texts that hold it, a term weighs
    ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and a document has ``m = 75 + 25 n N div L``; its score is the sum of
    ``w * (10^9 tf div (1000 tf + 12 m))`` over the item's terms, repeats included. Equal scores rank by ascending id, null ids last;
    documents without a common term of positive weight are not returned.

    Items are taken in blocks of bounded size. For a block every document is reduced once to its counts of the block's terms, which
    are stored; document frequencies are counted from them, and both trees search them. Terms are told apart by 64-bit hashes.

    Null and empty items have no rows; repeated items and documents are rows of their own; other columns are not carried; empty tables
    give an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).filter(F.length("text") > 0)
    asked = asked.withColumn("_bytes", F.octet_length("text").cast("bigint")).withColumn("_one", F.lit(1).cast("bigint")).withColumn("_hash", F.xxhash64("text"))
    order = [F.col("_hash"), F.col("_row")]
    dealt = range_ordered(asked, F.col("_hash")).withColumn("_row", F.monotonically_increasing_id())
    placed = running_sums(dealt, order, {"_end": "_bytes", "_number": "_one"})
    blocks = checkpoint(placed.select("item_id", "text", "_number", F.expr(f"(_end - _bytes) div {BLOCK_BYTES}").alias("_by"), F.expr(f"(_number - 1) div {BLOCK_ROWS}").alias("_at")))
    found = []
    for by, at in sorted(map(tuple, blocks.select("_by", "_at").distinct().collect())):
        block = blocks.filter((F.col("_by") == by) & (F.col("_at") == at)).orderBy("_number")
        held = block.select("_number", "text").collect()
        ranked = _search_block(rows, [r["text"] for r in held], k)
        numbers = F.array(*(F.lit(r["_number"]) for r in held))
        found.append(checkpoint(ranked.select(F.get(numbers, F.col("item")).alias("_n"), "rank", F.col("id").alias("_doc"), "score")))
    if not found:
        return blocks.select(F.col("item_id").alias(item_col), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias(id_col), F.lit(0).cast("bigint").alias("score")).limit(0)
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    named = whole.join(blocks.select("item_id", "_number"), F.col("_n") == F.col("_number"))
    return named.select(F.col("item_id").alias(item_col), "rank", F.col("_doc").alias(id_col), "score")
