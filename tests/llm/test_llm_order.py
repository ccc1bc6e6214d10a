"""Sharding and mixing against their definitions."""

import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm.mixing import mix_sources, source_targets
from tidewright.llm.prefix import range_ordered, running_sums
from tidewright.llm.sharding import shard_by_bytes


def _shards(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out


def test_shards_are_balanced_gapless_and_keep_small_runs(spark):
    texts = [("x" * (7 * i % 90)) + str(i // 3) for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = shard_by_bytes(docs, shards=12).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(900))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for part in _shards(rows).values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 12) <= 2 * largest
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    homes = defaultdict(set)
    for r in rows:
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(h) == 1 for t, h in homes.items() if texts.count(t) * (len(t) + 8) <= largest)


def test_a_hot_text_is_split(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(500)] + [(500 + i, f"other {i}") for i in range(300)], "doc_id bigint, text string")
    sizes = Counter()
    for r in shard_by_bytes(docs, shards=8).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 4 * 22


def test_sharding_edges(edges, nothing):
    rows = shard_by_bytes(edges, shards=4).collect()
    assert len(rows) == 12 and sorted((r["slot"] for r in rows if r["shard"] == rows[0]["shard"])) == list(range(sum(r["shard"] == rows[0]["shard"] for r in rows)))
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {8} and {r["text_crc32"] for r in rows if r["doc_id"] == 3} == {0}
    assert shard_by_bytes(nothing).collect() == []


def test_running_sums_follow_the_order(spark):
    values = [(i * 37 % 101, i % 3, i) for i in range(400)]
    df = spark.createDataFrame(values, "k int, g int, v bigint")
    order = [F.col("k"), F.col("v")]
    got = running_sums(range_ordered(df, *order), order, {"run": "v"}).select("k", "v", "run").collect()
    total, want = 0, []
    for k, _, v in sorted(values, key=lambda r: (r[0], r[2])):
        total += v
        want.append((k, v, total))
    assert sorted(map(tuple, got)) == sorted(want)


def _targets(sizes, weights=(3.0, 1.0, 2.0)):
    """Shares by weight; what is above a limit is shared again among the rest until none is."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "é", "z", None]), st.integers(0, 1000), min_size=1))
def test_targets_are_reshared(spark, sizes):
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    want = _targets(sizes)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in rows)


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 17 + 1)), ["hot", "hot", "x", None, "y"][i % 5]) for i in range(2000)], "doc_id bigint, text string, source string")
    rows = mix_sources(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - target[s]) <= 17 for s in target)


def test_mixing_edges(edges, nothing):
    rows = mix_sources(edges, carry=("lang",)).collect()
    assert len(rows) == 12 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mix_sources(nothing).collect() == []
    assert [r["taken"] for r in mix_sources(edges.filter("doc_id in (3, 4)")).collect()] == [0, 0]
