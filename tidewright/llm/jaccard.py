"""Similarity join on word shingles over an R-tree of group counts."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.components import connected_components
from tidewright.llm.countvectors import CountTree, counts, enough, pack, unpack
from tidewright.llm.textarrays import U, mix, raw, shingles, slices, word_hashes, words
from tidewright.session import checkpoint, release

# Tokens per subspace in turn: a set that the first split cannot serve takes part in the next one too, the last takes any set.
SPLITS = (5.0, 2.5, 1.25, 0.0)
CHUNK = 2048  # members of a subspace cell that meet in one step
FILTER_BITS = 1 << 27  # size of the filter of wanted sets, whatever their number
SEEN = 1 << 16
LEAF = 24  # members of a cell that need no tree
NEAR = 3  # likest partners of a member, in a block of the tree's answers, that a forest is made from
HUB = 512  # members that stand behind one copy of their hub's text


def token_sets(part: pa.RecordBatch, text: str, width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each row's text, sorted."""
    low, starts, stops, counted = words(*raw(part.column(text)))
    hashed = word_hashes(low, starts, stops)
    for a, b in zip(counted, counted[1:], strict=False):
        yield np.unique(shingles(hashed[a:b], width))


def set_class(tokens: np.ndarray) -> int:
    """A 64-bit digest that equal sets share; with the set's size it stands for the set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def subspace_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the set's points in subspaces: linked sets share at least one.

    The tokens' space is cut into subspaces by hash, so many that one holds ``split`` tokens of a set of this size class on
    average at most. In a subspace a set is the point of its group counts, with groups so fine that each token has its own; a key is
    one such point. A set of n tokens differs from a linked one in at most n * (100 - percent) / percent tokens (the most, with
    the largest partner), hence in at most as many subspaces. Points have one common order: those of more tokens first, then by
    hash. Before the first point that two linked sets share, each has only points the other lacks, so it is among either one's
    first ``differ + 1``, and a set gives no more than these. A set with fewer points gives them all and takes part in the next,
    finer split too; in the last one each token is a subspace, and every set has enough. A set near the upper end of its size
    class also takes part in the class above, where a larger partner may be.
    """
    if percent < 50:
        raise ValueError("similarities below a half would need more size classes")
    n = len(tokens)
    differ = n * (100 - percent) // percent
    out = []
    level = n.bit_length() - 1
    for size_class in (level, level + 1) if 100 * n >= percent * (2 << level) - 100 else (level,):
        for number, split in enumerate(SPLITS):
            salt = mix(np.array([size_class * 16 + number + 1], U))[0]
            if split:
                spaces = max(1, int((2 << size_class) / split))
                space = ((tokens >> U(32)) * U(spaces)) >> U(32)
                heads = np.flatnonzero(np.concatenate([[True], space[1:] != space[:-1]]))
                held = np.diff(np.append(heads, n))
                with np.errstate(over="ignore"):
                    points = mix(np.add.reduceat(mix(tokens + salt), heads) + held.astype(U))
            else:
                points, held = mix(tokens + salt), np.ones(n, np.int64)
            if len(points) > differ:
                out.append(points[np.lexsort((points, -held))[:differ + 1]])
                break
            out.append(points)
    return np.concatenate(out)


def _profile(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, class, keys) of every row; a task gives the keys of a class once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text"):
            rows = []
            for tokens in token_sets(part, "text", width):
                c = set_class(tokens)
                new = len(tokens) and c not in seen
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                rows.append((len(tokens), c, subspace_keys(tokens, percent).view(np.int64) if new else np.zeros(0, np.int64)))
            ends = np.concatenate([[0], np.cumsum([len(k) for _, _, k in rows])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([k for _, _, k in rows])))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([c for _, c, _ in rows], pa.int64()), keys], ["id", "n", "class", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n bigint, class bigint, keys array<bigint>")


def _wanted(values: DataFrame) -> np.ndarray:
    """A bit filter of fixed size over a column of bigints: values that miss it are surely not among them.

    At most FILTER_BITS / 64 rows reach the driver, whatever the number of values; with very many it lets more pass.
    """
    bit = F.pmod(F.col(values.columns[0]), F.lit(FILTER_BITS))
    cells = values.groupBy((bit / 64).cast("int").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("bits"))
    found = cells.toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return out


def _hits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % FILTER_BITS
    return (bits[at >> 6] >> (at & 63) & 1).astype(bool)


def _cells(profile: DataFrame) -> DataFrame:
    """(key, class, hub) of the keys that more than one class gives; the hub is the smallest of them.

    The keys' extremes are folded before they are shuffled. Of the keys that only one class gives, a bit filter drops most before the join.
    """
    points = profile.select(F.explode("keys").alias("key"), "class")
    shared = checkpoint(points.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("_last")).filter("hub < _last").select("key", "hub"))
    held = profile.sparkSession.sparkContext.broadcast(_wanted(shared.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            values = keys.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(batch.column("class").to_numpy(), keys.value_lengths().to_numpy())
            kept = _hits(held.value, values)
            yield pa.RecordBatch.from_arrays([pa.array(values[kept]), pa.array(owner[kept])], ["key", "class"])

    cells = checkpoint(profile.select("class", "keys").mapInArrow(run, "key bigint, class bigint").join(shared, "key").dropDuplicates(["key", "class"]))
    held.destroy()  # the cells are stored, nothing reads the filter again
    return cells


def _texts_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(class, n, counts, text) once for each wanted class: whole texts, the group counts packed."""
    held = docs.sparkSession.sparkContext.broadcast(_wanted(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for part in slices(batches, "text"):
            rows = []
            for i, tokens in enumerate(token_sets(part, "text", width)):
                c = set_class(tokens)
                if len(tokens) and c not in seen and _hits(bits, np.array([c]))[0]:
                    rows.append((i, c, len(tokens), pack(counts(tokens))))
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
            if rows:
                where, c, n, points = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(points, pa.binary()), part.column("text").take(pa.array(where))], ["class", "n", "counts", "text"])

    found = docs.select("text").mapInArrow(run, "class bigint, n bigint, counts binary, text string")
    texts = checkpoint(found.join(classes.distinct(), "class", "left_semi").dropDuplicates(["class", "n"]))
    held.destroy()
    return texts


def _bounded(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose summed minima allow the similarity; no text is moved for it."""
    side = lambda k: texts.select(F.col("class").alias(k), F.col("counts").alias(f"points_{k}"), F.col("n").alias(f"n_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "points_a", "points_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = np.minimum(unpack(batch.column("points_a").to_pylist()), unpack(batch.column("points_b").to_pylist())).sum(axis=1, dtype=np.int64)
            able = enough(shared, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[able]) for k in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, compared token by token.

    A row holds one text. The members of a hub stand behind it in one task; hubs of more than ``HUB`` members are dealt over several.
    """
    parts = F.ceil(F.count("*") / HUB).cast("int")
    dealt = pairs.join(pairs.groupBy("a").agg(parts.alias("_parts")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("salt"))
    held = texts.select("class", "n", "text")
    members = dealt.join(held, F.col("b") == F.col("class")).select("a", "salt", "b", F.lit(True).alias("member"), "n", "text")
    hubs = dealt.select("a", "salt").distinct().join(held, F.col("a") == F.col("class")).select("a", "salt", F.col("a").alias("b"), F.lit(False).alias("member"), "n", "text")
    rows = members.union(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, size = np.zeros(0, U), 0
        for part in slices(batches, "text"):
            kept = []
            for i, (own, n, member) in enumerate(zip(token_sets(part, "text", width), part.column("n").to_pylist(), part.column("member").to_pylist(), strict=True)):
                if not member:
                    tokens, size = own, n
                elif enough(len(np.intersect1d(tokens, own, assume_unique=True)), size, n, percent):
                    kept.append(i)
            if kept:
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(kept)) for k in ("a", "b")], ["a", "b"])

    return checkpoint(rows.mapInArrow(run, "a bigint, b bigint"))


def _shared(points: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of row pairs."""
    out = np.empty(len(p), np.int64)
    for at in range(0, len(p), 2048):
        out[at:at + 2048] = np.minimum(points[p[at:at + 2048]], points[q[at:at + 2048]]).sum(axis=1, dtype=np.int64)
    return out


def _forest(comp: np.ndarray, p: np.ndarray, q: np.ndarray, likeness: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of the row pairs, the likest first, join up components that none before has joined."""
    root = {c: c for c in comp.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    taken = []
    for k in np.lexsort((names[q], names[p], -likeness)).tolist():
        x, y = find(int(comp[p[k]])), find(int(comp[q[k]]))
        if x != y:
            root[x] = y
            taken.append(k)
    return np.array(taken, np.int64)


def _large_cell(own: np.ndarray, comp: np.ndarray, n: np.ndarray, points: np.ndarray, side: np.ndarray, chunks_differ: bool, percent: int, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of row pairs of one cell (or of a pair of its chunks) in different components that the R-tree lets pass.

    One of two members in different components is not in the largest one, so only members of the others are looked up. With
    ``forest`` each keeps its ``NEAR`` likest partners of a block, and of all these only those that join up components.
    """
    if chunks_differ:
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
    else:
        kinds, sizes = np.unique(comp, return_counts=True)
        left, right = np.flatnonzero(comp != kinds[sizes.argmax()]), np.arange(len(n))
    if not len(left) or not len(right):
        return
    found = []
    for query, member in CountTree(points[right], n[right]).search(points[left], n[left], percent):
        p, q = left[query], right[member]
        other = comp[p] != comp[q]
        p, q = p[other], q[other]
        if not forest:
            yield p, q
        elif len(p):
            likeness = 2 * _shared(points, p, q) / (n[p] + n[q])
            order = np.lexsort((own[q], -likeness, p))
            place = np.arange(len(order)) - np.searchsorted(p[order], p[order])
            found.append((p[order][place < NEAR], q[order][place < NEAR], likeness[order][place < NEAR]))
    if found:
        p, q, likeness = (np.concatenate(x) for x in zip(*found, strict=True))
        taken = _forest(comp, p, q, likeness, own)
        yield p[taken], q[taken]


def _small_cells(heads: np.ndarray, sizes: np.ndarray, comp: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of many small cells at once, by the sizes of their sets and their components only: one leaf each."""
    found = [(np.zeros(0, np.int64),) * 2]
    for size in np.unique(sizes):
        rows = heads[sizes == size][:, None] + np.arange(size)[None, :]
        for i in range(size):
            for j in range(i + 1, size):
                p, q = rows[:, i], rows[:, j]
                able = (comp[p] != comp[q]) & (100 * n[p] >= percent * n[q]) & (100 * n[q] >= percent * n[p])
                found.append((p[able], q[able]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cell_pairs(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) of rows (key, low, high, side, class, comp, n, counts): members of one cell in different components whose
    summed minima allow the similarity; with ``forest`` only those of the likest that join up the cell's components.

    A task holds the small cells of one Arrow batch; a cell of more than ``LEAF`` members is searched by its R-tree, one pair of chunks at
    a time, and its pairs leave the task block by block.
    """
    def named(own: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(p):
            a, b = np.unique(np.stack([np.minimum(own[p], own[q]), np.maximum(own[p], own[q])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def candidates(cells: list[np.ndarray], whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, comp, n, points, side, differ = cells
        sizes = np.diff(np.append(whole, len(own)))
        small = sizes <= LEAF
        p, q = _small_cells(whole[small], sizes[small], comp, n, percent)
        shared = _shared(points, p, q)
        able = enough(shared, n[p], n[q], percent)
        p, q, shared = p[able], q[able], shared[able]
        if forest and len(p):
            row, other = np.concatenate([p, q]), np.concatenate([q, p])
            order = np.lexsort((own[other], -np.tile(2 * shared / (n[p] + n[q]), 2), row))
            first = np.concatenate([[True], row[order][1:] != row[order][:-1]])
            p, q = row[order][first], other[order][first]
        yield from named(own, p, q)
        for at, size in zip(whole[~small], sizes[~small], strict=True):
            part = slice(at, at + size)
            if comp[part].min() != comp[part].max():
                for x, y in _large_cell(own[part], comp[part], n[part], points[part], side[part], bool(differ[at]), percent, forest):
                    yield from named(own, x + at, y + at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the cell that may go on in the next batch
        last = None

        def done(cells: list[list[np.ndarray]], whole: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from candidates([np.concatenate(x) for x in zip(*cells, strict=True)], whole)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("key", "low", "high")])
            cols = [batch.column(k).to_numpy() for k in ("class", "comp", "n")]
            cols += [unpack(batch.column("counts").to_pylist()), batch.column("side").to_numpy(zero_copy_only=False), keys[1] != keys[2]]
            heads = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            if last is not None and (keys[:, 0] != last).any():
                yield from done(held, np.zeros(1, np.int64))
                held = []
            before, last, tail = sum(len(h[0]) for h in held), keys[:, -1], heads[-1]
            if tail:  # every cell but the last has ended
                whole = np.concatenate([[0], heads[1:-1] + before]).astype(np.int64)
                yield from done([*held, [c[:tail] for c in cols]], whole)
                held = []
            held.append([c[tail:] for c in cols])
        if held:
            yield from done(held, np.zeros(1, np.int64))

    order = ["key", "low", "high"]
    dealt = rows.select(*order, "side", "class", "comp", "n", "counts").repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _open_cells(cells: DataFrame, comps: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of :func:`_cell_pairs` for all cells that hold more than one component.

    A cell of more than ``CHUNK`` members is cut into chunks that meet in pairs. Members of its largest component need not meet each
    other: they form chunks of their own that meet only those of the other members.
    """
    rows = checkpoint(cells.join(comps, cells["class"] == comps["node"], "left").select("key", "class", F.coalesce("comp", "class").alias("comp")))
    kinds = rows.groupBy("key", "comp").agg(F.count("*").alias("_n"))
    sizes = kinds.groupBy("key").agg(F.count("*").alias("_kinds"), F.sum("_n").alias("_all"), F.max(F.struct("_n", "comp")).alias("_most")).filter("_kinds > 1")
    whole = F.col("_all") <= CHUNK
    sizes = sizes.select(
        "key", F.col("_most.comp").alias("_most"), F.when(whole, 1).otherwise(F.ceil((F.col("_all") - F.col("_most._n")) / CHUNK)).cast("int").alias("_few"),
        F.when(whole, 0).otherwise(F.ceil(F.col("_most._n") / CHUNK)).cast("int").alias("_many"))
    members = rows.join(sizes, "key").join(known, F.col("class") == F.col("_class"))
    large = (F.col("_many") > 0) & (F.col("comp") == F.col("_most"))
    chunk = F.when(large, F.col("_few") + F.pmod(F.xxhash64("class"), F.greatest("_many", F.lit(1)))).otherwise(F.pmod(F.xxhash64("class"), F.col("_few"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(large, F.col("_few") - 1).otherwise(F.col("_few") + F.col("_many") - 1))
    split = members.withColumn("_chunk", chunk).withColumn("_with", F.explode(meets))
    return split.withColumn("low", F.least("_chunk", "_with")).withColumn("high", F.greatest("_chunk", "_with")).withColumn("side", F.col("_chunk") == F.col("low"))


def similar_classes(docs: DataFrame, width: int = 4, percent: int = 85, forest_rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """For rows (id, text): (id, n, class) of every row, and (node, comp) of the classes of equal sets that are linked to others.

    Sets are points of group counts. The top of the index are the cells of :func:`subspace_keys`, which bring every linked pair
    together in some task; under it each cell is a packed R-tree searched with the bound of the summed minima; pairs that pass are
    compared token by token. So that a cell of near copies need not list its pairs, members are joined up first: all with the
    cell's first one, then by forests of the likest pairs between the components of a cell (``forest_rounds`` times). The last round
    takes every pair that passes the bound and is not in one component yet: the components are exact.
    """
    profile = checkpoint(_profile(docs, width, percent))
    cells = _cells(profile)
    texts = _texts_of(docs, cells.select("class"), width)
    known = texts.select(F.col("class").alias("_class"), "n", "counts")
    tested = checkpoint(cells.filter("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct())
    links = _verified(_bounded(tested, texts, percent), texts, width, percent)
    release(docs.sparkSession)
    for turn in range(forest_rounds + 1):
        found = _cell_pairs(_open_cells(cells, connected_components(links), known), percent, forest=turn < forest_rounds)
        pairs = checkpoint(found.join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            links, tested = links.union(_verified(pairs, texts, width, percent)), tested.union(pairs)
        del found
        release(docs.sparkSession)
    return profile.select("id", "n", "class"), connected_components(links)


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    A row's set are the distinct runs of ``width`` words of its whole text (words are runs of anything but ASCII white space, A-Z in
    lower case); fewer words are one run. Rows link when 100 * intersection >= ``percent`` * union; ``component_id`` is the
    smallest id reachable by links, the row's own included. Rows with equal sets are one class and are not expanded.

    Null, empty and blank texts have no set and link with nothing; repeated rows and ids are rows of their own; null ids never
    are a component's id unless all its ids are null. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets, comps = similar_classes(rows, width, percent)
    classes = sets.filter("n > 0").groupBy("class", "n").agg(F.min("id").alias("first")).join(comps, F.col("class") == F.col("node"), "left")
    classes = classes.withColumn("comp", F.coalesce("comp", "class"))
    roots = classes.groupBy("comp").agg(F.min("first").alias("root"))
    named = classes.join(roots, "comp").select(F.col("class").alias("_class"), F.col("n").alias("_n"), "root")
    out = sets.join(named, (F.col("class") == F.col("_class")) & (F.col("n") == F.col("_n")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
