"""Similarity operators against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm.components import connected_components
from tidewright.llm.countvectors import CountTree, counts, enough
from tidewright.llm.embeddings import TABLES, _codes, cap_plan, caps_of, near_duplicate_vectors
from tidewright.llm.jaccard import jaccard_join, subspace_keys
from tidewright.llm.textarrays import U, mix


def smallest(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def by_hand(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = smallest(range(len(rows)), near)
    groups = defaultdict(list)
    for i, c in comp.items():
        groups[c].append(rows[i][0])
    lowest = {c: min((x for x in ids if x is not None), default=None) for c, ids in groups.items()}
    return sorted(((i, len(s), lowest[comp[k]]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 900), st.integers(0, 200), st.integers(0, 200), st.sampled_from([50, 80, 85, 90, 99, 100]), st.integers(0, 1 << 30))
def test_linked_sets_share_a_subspace_key(common, left, right, percent, seed):
    rng = np.random.default_rng(seed)
    left, right = min(left, common // 5), min(right, common // 5)
    pool = np.unique(mix(rng.integers(0, 1 << 62, common + left + right).astype(U)))
    rng.shuffle(pool)
    a = np.sort(np.concatenate([pool[:common], pool[common:common + left]]))
    b = np.sort(np.concatenate([pool[:common], pool[common + left:common + left + right]]))
    shared = len(np.intersect1d(a, b))
    if enough(shared, len(a), len(b), percent):
        assert len(np.intersect1d(subspace_keys(a, percent), subspace_keys(b, percent)))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1 << 30))
def test_tree_search_equals_a_scan(n, seed):
    rng = np.random.default_rng(seed)
    base = [mix(rng.integers(0, 1 << 62, size).astype(U)) for size in (40, 45, 300)]
    sets = [np.unique(np.concatenate([rng.permutation(base[i % 3])[:-(1 + i % 9)], mix(rng.integers(0, 1 << 62, i % 7).astype(U))])) for i in range(n)]
    points, sizes = np.stack([counts(s) for s in sets]), np.array([len(s) for s in sets])
    got = {(q, m) for block in CountTree(points, sizes).search(points, sizes, 85) for q, m in zip(*block)}
    want = {(i, j) for i in range(n) for j in range(n) if 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j]) and enough(np.minimum(points[i], points[j]).sum(dtype=int), sizes[i], sizes[j], 85)}
    assert got == want
    linked = {(i, j) for i in range(min(n, 60)) for j in range(min(n, 60)) if enough(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], 85)}
    assert linked <= got


@pytest.mark.parametrize("edges", [None, 0])
def test_components_of_paths_stars_and_noise(spark, monkeypatch, edges):
    from tidewright.llm import components

    if edges is not None:
        monkeypatch.setattr(components, "TASK_EDGES", edges)
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (160, 100), (None, 3)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    sound = [(a, b) for a, b in pairs if a is not None]
    assert got == smallest({n for p in sound for n in p}, sound)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def corpus(seed, n):
    rng = random.Random(seed)
    line = [f"common{i}" for i in range(14)]
    rows, seeds = [], []
    for i in range(n):
        if seeds and rng.random() < 0.6:
            w = list(rng.choice(seeds))
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        else:
            w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 120, 300]))] + rng.choice([[], line])
            seeds.append(w)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, width, percent):
    rows = corpus(width, 250)
    got = jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), width, percent).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, width, percent)


def test_near_copies_that_are_not_all_linked(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):  # a chain: each copy edits the one before, so that far ends are not linked
        base[rng.randrange(200)] = f"e{i}"
        rows.append((500 - i, " ".join(base)))
    got = jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, 4, 85)


def test_join_edges(edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert sorted(map(tuple, jaccard_join(edges).collect()), key=str) == by_hand(rows, 4, 85)
    assert jaccard_join(nothing).collect() == []


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = rng.standard_normal(32)
        x /= np.linalg.norm(x)
        out.append(x)
        for cosine in (0.9001, 0.92, 0.97, 0.89):
            y = rng.standard_normal(32)
            y -= y @ x * x
            out.append(cosine * x + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y))
    return [x.astype(np.float32).tolist() for x in out]


def test_vector_recall_and_precision(spark):
    data = vectors(1, 400)
    got = {r["vec_id"]: r for r in near_duplicate_vectors(spark.createDataFrame(list(enumerate(data)), "vec_id bigint, embedding array<float>")).collect()}
    x = np.array(data, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i]["n_links"] for i in range(len(data))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.97 * near.sum()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"] for r in got.values())


def test_dense_group_counts_each_pair_once(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    data = [(centre + 0.02 * rng.standard_normal(16)).tolist() for _ in range(1500)] + [centre.tolist()] * 40
    got = near_duplicate_vectors(spark.createDataFrame(list(enumerate(data)), "vec_id bigint, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(1539, 0)}


def test_vector_edges(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [float("nan"), 1.0], "x"), (5, [float("inf"), 1.0], "x"),
            (6, [None, 1.0], "x"), (7, [], "x"), (8, [1.0], "x"), (9, [1.0, 0.0, 0.0], "x"), (None, [1.0, 0.001], "x"), (10, [-1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node string")
    got = sorted(map(tuple, near_duplicate_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([(0, 3, 0, True), (1, 3, 0, False), (1, 3, 0, False), (None, 3, 0, False), *alone], key=str)
    assert near_duplicate_vectors(df.filter("vec_id < 0")).collect() == []


def test_caps_are_all_that_exceed_the_height():
    rng = np.random.default_rng(3)
    height, words = cap_plan(1000, 0.9)
    x = rng.standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = [_codes(10, words, 1 + k) for k in range(TABLES)]
    for v, caps in zip(x, caps_of(x, height, words, 1)):
        inner = np.stack([(left @ v[:5])[:, None] + (right @ v[5:])[None, :] for left, right in books])
        assert caps.tolist() == np.flatnonzero(inner.ravel() >= height).tolist()


@pytest.mark.parametrize("chunk", [None, 150])
def test_many_near_copies_by_matrix(spark, monkeypatch, chunk):
    """1 200 near copies of two texts: all links against the matrix of intersections, with whole cells and with cells in chunks."""
    from tidewright.llm import jaccard

    if chunk:
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        monkeypatch.setattr(jaccard, "HUB", 7)
    rng = random.Random(11)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(2)]
    rows = []
    for i in range(1200):
        text = list(bases[i % 2])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    sets = [shingle_set(t, 4) for _, t in rows]
    index = {s: k for k, s in enumerate(set().union(*sets))}
    matrix = np.zeros((len(rows), len(index)), np.float32)
    for i, s in enumerate(sets):
        matrix[i, [index[x] for x in s]] = 1
    common, size = (matrix @ matrix.T).astype(int), matrix.sum(axis=1).astype(int)
    a, b = np.nonzero(100 * common >= 85 * (size[:, None] + size[None, :] - common))
    comp = smallest(range(len(rows)), zip(a.tolist(), b.tolist()))
    assert len(set(comp.values())) > 3
    got = jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), width=4, percent=85)
    assert sorted(map(tuple, got.collect())) == [(i, len(sets[i]), comp[i]) for i in range(len(rows))]
