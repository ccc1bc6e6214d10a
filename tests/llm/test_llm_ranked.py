"""Ranked search against a plain scan."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewright.llm import ranked
from tidewright.llm.ranked import Best, ItemTree, ranked_search, search_batch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), size in zip(counted, sizes):
            if size:
                m = 75 + 25 * size * n // length
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
                if score > 0:
                    scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def tables():
    rng = random.Random(2)
    words = [f"w{j}" for j in range(60)] + ["Été", "中文", "X9", "the", "the", "the"]
    docs = [(i, rng.choice([" ", "\n", "-", ", "]).join(rng.choice(words[rng.randrange(50):]) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(700)]
    docs += [(i + 10_000, docs[9][1]) for i in range(300)]  # copies: equal scores
    docs += [docs[3], docs[3], (None, docs[4][1]), (None, None), (5, ""), (6, "?!")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 60])))) for i in range(40)] + [(0, docs[3][1]), (1, None), (2, ""), (3, "unknown"), (None, "w1 w2")]
    items += [items[4], (77, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("setting", [{}, {"BLOCK_ROWS": 7, "SEEDS": 50, "LEAF": 2, "FAN": 3, "ITEM_LEAF": 3, "CELLS": 1}])
def test_ranked_search_by_plain_scan(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(ranked, name, value)
    docs, items = tables()
    got = ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string"), k=20)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 20)


def test_long_items_are_summed_as_integers():
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 30_000, 50)
    rows, terms_, times = np.repeat(np.arange(6), 10), np.tile(np.arange(10), 6) + np.repeat(np.arange(6), 10), np.full(60, 10**8)
    tree = ItemTree(rows, terms_, times, 6, weights)
    assert tree.kind is np.int64
    best = Best(np.zeros(6, np.int64), np.full(6, 2**63 - 1), 3)
    owner, term = np.repeat(np.arange(100), 5), rng.integers(0, 50, 500)
    pairs = np.unique(owner * 50 + term)
    owner, term = pairs // 50, pairs % 50
    value = rng.integers(1, 10**6, len(pairs))
    search_batch(tree, best, np.arange(100), np.zeros(100, bool), owner, term, value)
    dense = np.zeros((100, 50), np.int64)
    dense[owner, term] = value
    for item in range(6):
        scores = tree.vectors[item] @ dense.T
        want = sorted((-int(s), i) for i, s in enumerate(scores) if s > 0)[:3]
        assert [(s, i) for s, i, _ in best.held[item]] == want


def test_edge_rows(spark, edges, nothing):
    items = spark.createDataFrame([(1, "alpha one"), (2, None)], "item_id bigint, text string")
    assert {(r.item_id, r.rank) for r in ranked_search(edges, items).collect()} == {(1, n) for n in range(1, 7)}
    assert ranked_search(nothing, items).count() == 0
    assert ranked_search(edges, items.filter("item_id > 9")).count() == 0
    assert ranked_search(edges.filter("doc_id in (3, 4, 5)"), items).count() == 0
