import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import grouping as G


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def make_sets(seed, n, hot=True):
    rng = random.Random(seed)
    base = [frozenset(rng.sample(range(30), rng.randint(1, 8))) for _ in range(6)]
    out = []
    for i in range(n):
        s = set(rng.choice(base))
        if rng.random() < 0.5:
            s ^= {rng.randrange(30)}
        if hot and rng.random() < 0.6:
            s.add(99)  # a token most sets hold
        out.append((i, sorted(s)))
    return out + [(n, [])]


def test_similar_pairs_are_exact(spark):
    rows = make_sets(1, 60)
    for threshold, common in ((0.7, 1), (0.4, 2), (0.05, 3)):
        df = spark.createDataFrame([(i, s) for i, s in rows if s], "id int, items array<int>")
        got = {(r["a"], r["b"]) for r in G.similar_pairs(G._ranked_sets(df, []), [], threshold, common).collect()}
        first = {}
        for i, s in rows:
            first.setdefault(frozenset(s), i)
        reps = {i: s for s, i in first.items() if s}
        want = {
            (i, j) for i in reps for j in reps if i < j and jaccard(reps[i], reps[j]) >= threshold - 1e-9 and len(reps[i] & reps[j]) >= common
        }
        assert got == want


def test_pairwise_overlap_is_the_exact_top(spark):
    for seed in (2,):
        rows = make_sets(seed, 50)
        df = spark.createDataFrame(rows, "id int, items array<int>")
        got = [(r["a"], r["b"], r["common"], round(r["similarity"], 9)) for r in G.pairwise_overlap(df, 3, 20).collect()]
        sets = {i: frozenset(s) for i, s in rows}
        every = [
            (i, j, len(sets[i] & sets[j]), round(jaccard(sets[i], sets[j]), 9)) for i in sets for j in sets
            if i < j and len(sets[i] & sets[j]) >= 3
        ]
        every.sort(key=lambda r: (-r[3], r[0], r[1]))
        assert got == every[:20]


def test_pairs_far_from_alike_are_counted_once(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, sorted(rng.sample(range(200), 40))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[7][1]), (None, rows[5][1][:20] + [None])]
    floors, joined = [], G.similar_pairs
    monkeypatch.setattr(G, "similar_pairs", lambda ranked, keys, floor, *rest: (floors.append(floor), joined(ranked, keys, floor, *rest))[1])
    monkeypatch.setattr(G, "POSTINGS", 4, raising=False)
    df = spark.createDataFrame(rows, "id int, items array<int>")
    got = [(r["a"], r["b"], r["common"], round(r["similarity"], 9)) for r in G.pairwise_overlap(df, 3, 20).collect()]
    sets = {i: frozenset(s) for i, s in rows if i is not None}
    every = [(i, j, len(sets[i] & sets[j]), round(jaccard(sets[i], sets[j]), 9)) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 3]
    assert got == sorted(every, key=lambda r: (-r[3], r[0], r[1]))[:20]
    # at a low floor nearly all pairs would be fetched whole to be verified
    assert all(floor >= 0.5 for floor in floors)


def greedy(rows, threshold=0.7):
    leaders, out = [], {}
    for i, s in rows:
        for lead, t in leaders:
            if jaccard(frozenset(s), t) >= threshold:
                out[i] = lead
                break
        else:
            leaders.append((i, frozenset(s)))
            out[i] = i
    return out


def test_group_similar_equals_greedy_leaders(spark):
    for seed in (4, 5):
        rows = make_sets(seed, 70)
        df = spark.createDataFrame([(i, "query", s) for i, s in rows], "id int, kind string, items array<int>")
        got = {r["id"]: r["leader"] for r in G.group_similar(df).collect()}
        assert got == greedy(rows)


def test_closure_is_cycle_safe_and_reports_missing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "ghost"), ("x", "x")], "src string, dst string")
    names = spark.createDataFrame([(n,) for n in "abcx"], "node string")
    reach = G.reference_closure(edges, names)
    got = {(r["root"], r["node"]) for r in reach.collect()}
    assert got == {(r, n) for r in "abc" for n in ("a", "b", "c", "ghost")} | {("x", "x")}
    assert {r["root"] for r in G.missing_references(reach, names).collect()} == {"a", "b", "c"}


def test_variants_enumerate_every_combination_once(spark):
    ops = spark.createDataFrame([(1, "...${on ? 'A' : 'B'} ${mode}"), (2, "plain")], "id int, content string")
    sw = spark.createDataFrame(
        [(1, 1, "on", ["true", "false"]), (1, 2, "mode", ["x", "y", "z"]), (1, 3, "none", [])],
        "id int, seq int, variable string, choices array<string>",
    )
    got = {(r["condition"], r["content"]) for r in G.expand_variants(ops, sw).collect()}
    assert got == {(f"on={o}, mode={m}", f"...{'A' if o == 'true' else 'B'} {m}") for o in ("true", "false") for m in "xyz"}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.integers(0, 8), max_size=5), min_size=1, max_size=15))
def test_groups_partition_the_operations(spark, sets):
    rows = [(i, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame([(i, "query", s) for i, s in rows], "id int, kind string, items array<int>")
    got = {r["id"]: r["leader"] for r in G.group_similar(df).collect()}
    assert got == greedy(rows)


def test_inlining_keeps_cycles_and_moves_directives(spark):
    ops = spark.createDataFrame([(1, "{ a { ...A @include(if: $v) } }"), (2, "{ ...C ...A }")], "id int, content string")
    fragments = spark.createDataFrame([(1, "A", "T", "x ...B", ""), (2, "B", "U", "y(k: $k) ...A", ""), (3, "C", "V", "z ...C", "")], "seq int, name string, type_name string, body string, content string")
    got = {r["id"]: r["content"] for r in G.inline_references(ops, fragments, mode="inline").collect()}
    assert got[1] == "{ a { ... on T @include(if: $v) { x ... on U { y(k: $k) ...A } } } }"
    assert got[2] == "{ ... on V { z ...C } ... on T { x ... on U { y(k: $k) ...A } } }"


def test_closure_follows_any_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0)], "src int, dst int")
    reach = G.reference_closure(edges, spark.createDataFrame([(0,)], "node int"))
    assert reach.count() == 13


def test_many_switches_expand_to_all_combinations(spark):
    ops = spark.createDataFrame([(1, "x")], "id int, content string")
    switches = spark.createDataFrame([(1, i, f"v{i}", ["true", "false"]) for i in range(13)], "id int, seq int, variable string, choices array<string>")
    rows = G.expand_variants(ops, switches)
    assert rows.count() == 1 << 13 and rows.select("condition").distinct().count() == 1 << 13


def test_a_closure_round_moves_only_what_it_found(spark):
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 64)] + [(None, 1), (3, None)], "src int, dst int")
    reach = G.reference_closure(edges, spark.createDataFrame([(i,) for i in range(64)] + [(None,), (5,)], "node int"))
    want = {(None, None)}
    for root in range(64):
        todo = [root]
        while todo:
            node = todo.pop()
            if (root, node) not in want:
                want.add((root, node))
                todo += [] if node is None or not node else [node // 2] + [None] * (node == 3)
    rows = [(r["root"], r["node"]) for r in reach.collect()]
    assert set(rows) == want and len(rows) == len(want)
    # finds lie by node, so that neither their edges nor a comparison with earlier finds shuffle them again
    at = reach.select("node", (F.spark_partition_id() % 8).alias("part")).distinct()
    assert at.count() == at.select("node").distinct().count() and reach.rdd.getNumPartitions() % 8 == 0
