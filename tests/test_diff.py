import json

import pytest
from pyspark.sql import functions as F

from tidewright.functions import comparators, json_trees
from tidewright.operators import diff as D
from tidewright.operators import repairs as R


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else json.dumps(v)) for i, v in rows], "id int, data string")


def diffs(spark, base, cand, cfg=None):
    pairs = D.pair_snapshots(frame(spark, [(1, base)]), frame(spark, [(1, cand)]))
    out = D.diff_rows(D.compare_pairs(pairs, cfg)).collect()
    return sorted((r["path"], r["type"], r["severity"], r["fixable"]) for r in out)


CASES = [
    ({"a": 1}, {"a": 1.0}, []),
    ({"a": 1, "gone": {"x": 1, "y": 2}}, {"a": 1}, [("data.gone", "missing-field", "critical", False)]),
    ({"a": 1}, {"a": 1, "more": [1]}, [("data.more", "extra-field", "low", True)]),
    ({"a": 1}, {"a": "1"}, [("data.a", "type-mismatch", "critical", False)]),
    ({"a": True}, {"a": 1}, [("data.a", "type-mismatch", "critical", False)]),
    ({"a": {"b": 1}}, {"a": [1]}, [("data.a", "type-mismatch", "critical", False)]),
    ({"a": {"b": 1}}, {"a": None}, [("data.a", "null-mismatch", "low", True)]),
    ({"userId": "x"}, {"userId": "y"}, [("data.userId", "value-change", "medium", False)]),
    ({"note": "x"}, {"note": "y"}, [("data.note", "value-change", "low", False)]),
    ({"l": [1, 2, 3]}, {"l": [3, 1, 2]}, [("data.l", "array-order", "low", True)]),
    ({"l": [1, 2]}, {"l": [1, 3, 4]}, [("data.l", "array-length", "low", False), ("data.l[1]", "value-change", "low", False)]),
    ({"l": [{"k": [1, 2]}]}, {"l": [{"k": [2, 1]}]}, [("data.l[0].k", "array-order", "low", True)]),
    ({"l": [[1, 2], [3]]}, {"l": [[3], [1, 2]]}, [("data.l", "array-order", "low", True)]),
    ({"l": [{"v": 1}, {"v": 2}]}, {"l": [{"v": 1}, {"v": 5}]}, [("data.l[1].v", "value-change", "low", False)]),
    ({"é": "ü"}, {"é": "u"}, [("data.é", "value-change", "low", False)]),
]


def test_golden_differences(spark):
    left = frame(spark, [(i, c[0]) for i, c in enumerate(CASES)])
    right = frame(spark, [(i, c[1]) for i, c in enumerate(CASES)])
    found = D.diff_rows(D.compare_pairs(D.pair_snapshots(left, right))).collect()
    for i, (_, _, want) in enumerate(CASES):
        assert sorted((r["path"], r["type"], r["severity"], r["fixable"]) for r in found if r["id"] == i) == sorted(want), CASES[i]


def test_strict_mode_reports_positions(spark):
    got = diffs(spark, {"l": [1, 2]}, {"l": [2, 1]}, D.CompareConfig(strict=True))
    assert [g[:2] for g in got] == [("data.l[0]", "value-change"), ("data.l[1]", "value-change")]


def test_ignored_subtree_is_silent_but_its_missing_children_are_tagged(spark):
    cfg = D.CompareConfig(ignore=[D.IgnorePattern("data.meta", "volatile"), D.IgnorePattern("data.tmp*", "temp")])
    base, cand = {"meta": {"a": 1}, "tmp1": 1, "x": 1}, {"meta": {"a": 2, "b": 1}, "x": 2}
    pairs = D.pair_snapshots(frame(spark, [(1, base)]), frame(spark, [(1, cand)]))
    rows = {r["path"]: r["ignored"] for r in D.diff_rows(D.compare_pairs(pairs, cfg)).collect()}
    assert rows == {"data.tmp1": "temp", "data.x": None}


def test_custom_comparator_stops_descent(spark):
    cfg = D.CompareConfig(comparators={"data.t": ("date-tolerance", {}), "data.tags": ("array-unordered", {})})
    base = {"t": "2024-01-01T00:00:00Z", "tags": ["b", "a"], "n": 1}
    cand = {"t": "2024-01-01T00:00:30Z", "tags": ["a", "b"], "n": 1}
    assert diffs(spark, base, cand, cfg) == []
    far = dict(cand, t="2024-01-01T00:05:00Z", tags=["a", "c"])
    assert [d[:2] for d in diffs(spark, base, far, cfg)] == [("data.t", "value-change"), ("data.tags", "value-change")]


def test_expected_difference_is_dropped(spark):
    cfg = D.CompareConfig(expected=[D.Expected("data.a", "type-mismatch")])
    assert diffs(spark, {"a": 1, "b": 1}, {"a": "1", "b": 2}, cfg) == [("data.b", "value-change", "low", False)]


def test_missing_side_is_unsafe(spark):
    pairs = D.pair_snapshots(frame(spark, [(1, {"a": 1}), (2, {"a": 1})]), frame(spark, [(2, {"a": 1}), (3, {})]))
    rows = {r["id"]: r for r in D.compare_pairs(pairs).collect()}
    assert [rows[i]["verdict"] for i in (1, 2, 3)] == ["unsafe", "safe", "unsafe"]
    assert rows[1]["similarity"] == 0.0 and rows[2]["identical"]


def test_swapping_sides_swaps_missing_and_extra(spark):
    swap = {"missing-field": "extra-field", "extra-field": "missing-field"}
    left = frame(spark, [(i, c[0]) for i, c in enumerate(CASES)])
    right = frame(spark, [(i, c[1]) for i, c in enumerate(CASES)])
    run = lambda a, b: D.diff_rows(D.compare_pairs(D.pair_snapshots(a, b))).collect()
    there = sorted((r["id"], r["path"], swap.get(r["type"], r["type"])) for r in run(left, right))
    assert there and there == sorted((r["id"], r["path"], r["type"]) for r in run(right, left))


def test_repairs_leave_no_fixable_difference(spark):
    rows = [(i, b) for i, (b, _, _) in enumerate(CASES)]
    others = [(i, c) for i, (_, c, _) in enumerate(CASES)]
    again = R.verify_repairs(D.pair_snapshots(frame(spark, rows), frame(spark, others)))
    assert D.diff_rows(again).filter("fixable").count() == 0


def test_dice_matches_brute_force(spark):
    pairs = [("night", "nacht"), ("a b c", "abc"), ("a", "b"), ("aaaa", "aa"), ("", "xy")]

    def brute(x, y):
        x, y = x.replace(" ", ""), y.replace(" ", "")
        if x == y:
            return 1.0
        if len(x) < 2 or len(y) < 2:
            return 0.0
        p, q = [x[i:i + 2] for i in range(len(x) - 1)], [y[i:i + 2] for i in range(len(y) - 1)]
        hit = 0
        for g in p:
            if g in q:
                q.remove(g)
                hit += 1
        return 2 * hit / (len(x) + len(y) - 2)

    got = spark.createDataFrame(pairs, "a string, b string").select(json_trees.dice(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([brute(*p) for p in pairs])


TRUTH = [
    ("date-tolerance", {}, (None, "null"), (None, "null"), True),
    ("date-tolerance", {}, ("2024-01-01 00:00:00", "string"), (None, "null"), False),
    ("date-tolerance", {}, ("2024-01-01 00:00:00", "string"), ("2024-01-01 00:01:00", "string"), True),
    ("date-tolerance", {"ms": 1000}, ("2024-01-01 00:00:00", "string"), ("2024-01-01 00:00:02", "string"), False),
    ("date-tolerance", {}, ("soon", "string"), ("soon", "string"), True),
    ("case-insensitive", {}, ("AbC", "string"), ("aBc", "string"), True),
    ("case-insensitive", {}, ("1", "string"), ("1", "number"), False),
    ("numeric-tolerance", {}, ("1.0", "number"), ("1.005", "number"), True),
    ("numeric-tolerance", {}, ("1", "number"), ("1.5", "string"), False),
    ("numeric-tolerance", {"tolerance": 0.1, "relative": True}, ("100", "number"), ("109", "number"), True),
    ("numeric-tolerance", {"relative": True}, ("0", "number"), ("0", "number"), True),
    ("numeric-tolerance", {}, ("x", "string"), ("x", "string"), True),
    ("array-unordered", {}, ("[1,2]", "array"), ("[2,1]", "array"), True),
    ("array-unordered", {}, ("[1,2]", "array"), ("[2,1,1]", "array"), False),
    ("ignore-whitespace", {}, (" a  b", "string"), ("a b ", "string"), True),
    ("type-coercion", {}, ("5", "string"), ("5.0", "number"), True),
    ("type-coercion", {}, ("true", "boolean"), ("true", "string"), True),
    ("type-coercion", {}, ("true", "boolean"), ("1", "number"), False),
    ("type-coercion", {}, (None, "null"), ("1", "number"), False),
    ("deep-partial", {}, ('{"a":1,"b":2}', "object"), ('{"b":2}', "object"), True),
    ("deep-partial", {}, ('{"a":1}', "object"), ('{"b":2}', "object"), False),
    ("deep-partial", {}, ("[1,2,3]", "array"), ("[1,2]", "array"), True),
]


def test_comparator_truth_tables(spark):
    row = spark.range(1)
    cols = []
    for i, (name, opts, (a, ta), (b, tb), _) in enumerate(TRUTH):
        lits = [F.lit(v).cast("string") for v in (a, b)]
        cols.append(comparators.build(name, **opts)(*lits, F.lit(ta), F.lit(tb)).alias(f"c{i}"))
    got = row.select(*cols).first()
    for i, case in enumerate(TRUTH):
        assert bool(got[i]) is case[-1], case


def test_comparator_registry_rejects_unknown_and_duplicate():
    with pytest.raises(KeyError):
        comparators.build("nope")
    with pytest.raises(ValueError):
        comparators.register("case-insensitive", comparators.case_insensitive)


def test_word_diff_rebuilds_the_new_text(spark):
    rows = [(1, "{ a b c }", "{ a x c d }"), (2, "same text", "same text"), (3, "", "new words here"), (4, "a b a b", "b a b a")]
    df = spark.createDataFrame(rows, "id int, o string, n string")
    out = R.word_diff(df, "id", "o", "n").collect()
    import re

    from tidewright.functions.text import TOKEN_PATTERN

    for i, old, new in rows:
        toks = [m.group(0) for m in re.finditer(TOKEN_PATTERN, old)]
        for r in sorted((r for r in out if r["id"] == i), key=lambda r: -r["token_no"]):
            gone = [m.group(0) for m in re.finditer(TOKEN_PATTERN, r["old_text"] or "")]
            assert toks[r["token_no"]:r["token_no"] + len(gone)] == gone
            toks[r["token_no"]:r["token_no"] + len(gone)] = [r["new_text"]] if r["new_text"] else []
        assert "".join(toks) == new
    assert not [r for r in out if r["id"] == 2]


def test_missing_data_on_one_side_fails_the_gate(spark):
    from tidewright.operators import diff as D

    base = spark.createDataFrame([(1, '{"a":1}'), (2, None), (3, None), (4, "null"), (5, '{"a":1}')], "id int, data string")
    cand = spark.createDataFrame([(1, None), (2, '{"a":1}'), (3, None), (4, None), (5, "null")], "id int, data string")
    got = {r["id"]: r for r in D.compare_pairs(D.pair_snapshots(base, cand)).collect()}
    assert {i for i, r in got.items() if r["identical"]} == {3, 4}
    assert all([(d["path"], d["type"]) for d in got[i]["diffs"]] == [("data", "null-mismatch")] for i in (1, 2, 5))


def test_nulls_are_stripped_at_any_depth(spark):
    from pyspark.sql import functions as F

    from tidewright.operators import diff as D

    cases = [
        ('{"k":1,"t":null,"other":{"z":2}}', '{"k":1,"other":{"z":2}}'), ('{"a":null}', "{}"), ('{"a":null,"b":null,"c":[null,{"d":null}]}', '{"c":[null,{}]}'),
        ('{"a":"x\\": null, y","b":null}', '{"a":"x\\": null, y"}'), ('{"a":nullable}', '{"a":nullable}'),
    ]
    rows = spark.createDataFrame(cases, "j string, want string").withColumn("got", D.strip_nulls(F.col("j"))).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_comparators_see_types_and_nesting(spark):
    from pyspark.sql import functions as F

    from tidewright.functions import comparators

    cases = [
        ("array-unordered", "[1,2]", "[2,1]", "array", True), ("array-unordered", "[1]", '["1"]', "array", False),
        ("deep-partial", '{"a":{"x":1,"y":2}}', '{"a":{"x":1}}', "object", True), ("deep-partial", '[{"x":1,"y":2},3]', '[{"x":1}]', "array", True),
        ("deep-partial", '{"a":{"x":1}}', '{"a":{"x":"1"}}', "object", False), ("deep-partial", "[]", "[1]", "array", False),
    ]
    for name, a, b, kind, want in cases:
        row = spark.range(1).select(comparators.build(name)(F.lit(a), F.lit(b), F.lit(kind), F.lit(kind)).alias("r")).first()
        assert row["r"] is want, (name, a, b)


def test_malformed_and_deep_texts(spark):
    deep = lambda n, x: "[" * n + x + "]" * n
    bad = ['{"a":1,}', "[1 2]", '{"a" 1}', '{"a":01}', '{"a":"x', '["\\x"]', "tru", "[1]]", '{"a":1}{', "{1:2}", '["a\nb"]', ""]
    base = spark.createDataFrame([(i, '{"a":1}') for i in range(len(bad))] + [(100, deep(600, "1")), (101, "9007199254740993"), (102, '{"b": 1.0}')], "id int, data string")
    cand = spark.createDataFrame(list(enumerate(bad)) + [(100, deep(600, "2")), (101, "9007199254740992"), (102, '{"b":1}')], "id int, data string")
    got = {r["id"]: r for r in D.compare_pairs(D.pair_snapshots(base, cand)).collect()}
    for i in range(len(bad)):
        assert [(d["path"], d["type"]) for d in got[i]["diffs"]] == [("data", "malformed-json")], bad[i]
        assert got[i]["verdict"] == "unsafe" and got[i]["similarity"] == 0.0
    assert [d["type"] for d in got[100]["diffs"]] == ["value-change"] and len(got[100]["diffs"][0]["segments"]) == 601
    assert [d["type"] for d in got[101]["diffs"]] == ["value-change"] and got[102]["identical"]


def test_repairs_of_odd_names_and_null_items(spark):
    base = {"o'k": [2, 1], "a.b": {"[0]": 5, "q\"": "x\\y"}, "l": [3, {"k": 4}], "e": 1, "z\u0001": 1}
    cand = {"x1": 1, "o'k": [1, 2], "a.b": {"[0]": None, "q\"": None}, "l": [None, {"k": None}], "e": None, "more": {"d": [1]}, "z\u0001": None, "x2": 2}
    again = R.apply_repairs(D.pair_snapshots(frame(spark, [(1, base)]), frame(spark, [(1, cand)]))).first()
    assert json.loads(again["cand_data"]) == base


def test_edits_by_action(spark):
    from tidewright.functions import json_trees as T

    text = '{"a": [1, 2, 3], "b": {}, "c": {"d": 1, "e": 2}}'
    cases = [
        ([(["r", "a"], "adjust-array", "5")], {"a": [1, 2, 3, None, None], "b": {}, "c": {"d": 1, "e": 2}}),
        ([(["r", "a"], "adjust-array", "1")], {"a": [1], "b": {}, "c": {"d": 1, "e": 2}}), ([(["r", "a"], "adjust-array", "0")], {"a": [], "b": {}, "c": {"d": 1, "e": 2}}),
        ([(["r", "b", "n"], "add-field", '"v"'), (["r", "c", "d"], "remove-field", None)], {"a": [1, 2, 3], "b": {"n": "v"}, "c": {"e": 2}}),
        ([(["r", "c", "d"], "remove-field", None), (["r", "c", "e"], "remove-field", None)], {"a": [1, 2, 3], "b": {}, "c": {}}),
        ([(["r", "a", "#1"], "map-value", "9"), (["r", "a"], "reorder-array", "[7]")], {"a": [7], "b": {}, "c": {"d": 1, "e": 2}}),
        ([(["r", "q", "z"], "map-value", "9"), (["r", "c", "e"], "convert-type", '"2"')], {"a": [1, 2, 3], "b": {}, "c": {"d": 1, "e": "2"}}),
    ]
    df = spark.createDataFrame([(i, text, c[0]) for i, c in enumerate(cases)], "i int, t string, r array<struct<segments: array<string>, action: string, value: string>>")
    got = T.with_tree(df, "t", "tree", "r").select("i", T.edit(F.col("tree"), F.col("r")).alias("out")).collect()
    assert [json.loads(r["out"]) for r in sorted(got)] == [c[1] for c in cases]


def test_a_long_string_does_not_stop_null_stripping(spark):
    text = json.dumps({"a": "x\\\"y" * 200_000, "b": None})
    got = spark.createDataFrame([(text,)], "j string").select(D.strip_nulls(F.col("j")).alias("r")).first()["r"]
    assert json.loads(got) == {"a": "x\\\"y" * 200_000}


def test_comparison_has_no_python_node(spark):
    pairs = D.pair_snapshots(frame(spark, [(1, {"a": 1})]), frame(spark, [(1, {"a": 2})]))
    plan = R.verify_repairs(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trees_against_a_parser(spark):
    import random

    from tidewright.functions import json_trees as T

    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind < 6:
            return [None, True, False, rng.randrange(-5, 10**17), round(rng.random() * 100, 3), rng.choice(["", "a\"b", "x\\", "é\n", "{[,:"])][kind]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 6 else {rng.choice("abcdefgh\"\\") + str(i): value(depth - 1) for i in range(rng.randrange(4))}

    def walk(v, path="$", parent=None, depth=0):
        kind = {dict: "object", list: "array", str: "string", type(None): "null", bool: "boolean"}.get(type(v), "number")
        yield (path, parent, depth, kind, None if kind in ("object", "array", "null") else v if kind == "string" else json.dumps(v))
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from walk(x, f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]", path, depth + 1)

    values = [value(4) for _ in range(150)]
    rows = [(i, json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)]
    flat = D.flatten_json(spark.createDataFrame(rows, "id int, j string"), "id", "j").orderBy("id", "ordinal").collect()
    assert [tuple(r)[:6] for r in flat] == [(i, *n) for i, v in enumerate(values) for n in walk(v)]


def test_few_steps_are_a_longest_common_subsequence():
    import random
    import time

    import numpy as np

    rng = random.Random(8)
    for _ in range(500):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        got = R.few_steps(np.array(x, np.int64), np.array(y, np.int64))
        assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        if len(x) + len(y) - 2 * len(got) > 3:
            assert R.few_steps(np.array(x, np.int64), np.array(y, np.int64), 3) is None
    old = np.array([rng.randrange(1000) for _ in range(100_000)], np.int64)
    new = np.delete(old, [rng.randrange(100_000) for _ in range(5)])
    new[[10, 50_000, 90_000]] = 5000
    start = time.time()
    assert len(R.few_steps(old, new)) == len(new) - 3
    assert time.time() - start < 10


def test_texts_far_apart_are_told_by_their_tokens_and_dealt_over_tasks(spark):
    import random
    import time

    import numpy as np

    rng = random.Random(3)
    x, y = (np.array([rng.randrange(k, 4000, 2) for _ in range(3000)], np.int64) for k in (0, 1))
    start = time.time()
    assert all(R.few_steps(x, y) is None for _ in range(20))
    assert time.time() - start < 1
    for n, m in ((0, 5), (7, 0), (30, 64), (200, 5000)):
        a, b = (np.array([rng.randrange(6) for _ in range(k)], np.int64) for k in (n, m))
        row = [0] * (m + 1)
        for t in a.tolist():
            last = 0
            for j, u in enumerate(b.tolist(), 1):
                last, row[j] = row[j], last + 1 if t == u else max(row[j], row[j - 1])
        assert R._lengths(a, b).tolist() == row
    one = spark.createDataFrame([(i, "a b", "b c") for i in range(100)], "id int, o string, n string").coalesce(1)
    assert R.word_diff(one, "id", "o", "n").rdd.getNumPartitions() > 1


def test_a_step_of_the_fold_looks_its_act_up_once():
    folded = json_trees._parts("t", "$", False, "k", "f")[1]
    assert folded.count("s.want * 11") == 1


def test_equal_members_are_left_out_and_change_no_result(spark):
    from pyspark.sql import functions as F

    from tidewright.functions import json_trees as T

    cases = [
        ('{"a":1,"b":[1,{"c":"x, }"}],"d":2.50}', '{"a":1,"b":[1,{"c":"x, }"}],"d":2}', '{"d":2.50}', '{"d":2}'),
        ('{"w":{"v":{"a":1,"b":{}},"k":0},"n":1}', '{"w":{"v":{"a":1,"b":{}},"k":1},"n":1}', '{"w":{"k":0}}', '{"w":{"k":1}}'),
        ('{"w":{"v":1},"n":[1,2]}', '{"n":[2,1]}', '{"w":{"v":1},"n":[1,2]}', '{"n":[2,1]}'), ('[1,2]', '[2,1]', '[1,2]', '[2,1]'),
        ('{"a":1,"b":' + "[" * 9 + "]" * 9 + '}', '{"a":1}', '{"a":1,"b":' + "[" * 9 + "]" * 9 + '}', '{"a":1}'), ('{"a":{}}', '{}', '{"a":{}}', '{}'),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in cases], "a string, b string").withColumn("k", F.expr(T._unlike("a", "b", T.WRAPPED)))
    assert [(r["k"]["a"], r["k"]["b"]) for r in df.collect()] == [c[2:] for c in cases]
    bad = ["[1]]", "1,2", "1],[2", '1},{"x":1', '1,"x":2', '{"a":1,"a":2}', "", "01", '{"a":1}{']
    good = ["1", ' {"a" : [1, {"b": "\\u00e9"}]}\n', "[]", '"x"']
    held = spark.createDataFrame([(t,) for t in bad + good], "t string").select(F.expr(T._sound("t")).alias("s")).collect()
    assert [r["s"] for r in held] == [False] * len(bad) + [True] * len(good)
    # a malformed part that both texts have in common is told, and a stop sees whole texts
    assert [d[1] for d in _raw(spark, '{"a":01,"b":1}', '{"a":01,"b":2}')] == ["malformed-json"]
    cfg = D.CompareConfig(comparators={"data.m": ("deep-partial", {})})
    assert _raw(spark, '{"m":{"x":1,"y":2}}', '{"m":{"x":1}}', cfg) == [] and len(_raw(spark, '{"m":{"x":1}}', '{"m":{"x":1,"y":2}}', cfg)) == 1
    long = json.dumps({f"k{i}": "v" * 20 for i in range(20_000)})
    assert [d[0] for d in _raw(spark, long, long.replace('"k7": "v', '"k7": "w'))] == ["data.k7"]


def _raw(spark, base, cand, cfg=None):
    side = lambda t: spark.createDataFrame([(1, t)], "id int, data string")
    return [(r["path"], r["type"]) for r in D.diff_rows(D.compare_pairs(D.pair_snapshots(side(base), side(cand)), cfg)).collect()]


def test_a_filter_on_repaired_texts_stays_above_their_making(spark):
    one = frame(spark, [(1, {"a": 1})])
    fixed = R.apply_repairs(D.pair_snapshots(one, frame(spark, [(1, {"a": None})])))
    plan = fixed.filter("cand_data = base_data")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 300_000 and plan.index("Filter") < plan.index("Generate")


def test_texts_compared_part_by_part_give_what_reading_them_whole_gives(spark, monkeypatch):
    import random

    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(9 if depth else 7)
        if kind < 7:
            return [None, True, False, rng.randrange(-2, 3), rng.choice([1.0, -0.0, 2.5, 1e3]), rng.choice(["", "a\"b", "x\\", "é\n", "{[,:", "1"]), "t"][kind]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 7 else {rng.choice("abcd\"\\,:") + str(i): value(depth - 1) for i in range(rng.randrange(4))}

    def edited(v):
        if rng.random() < 0.2:
            return value(1)
        if isinstance(v, list):
            items = [edited(x) for x in v]
            return rng.sample(items, len(items)) if rng.random() < 0.4 else items[:rng.randrange(1, 4)]
        return {k: edited(x) for k, x in v.items() if rng.random() < 0.8} if isinstance(v, dict) else v

    texts = [(i, json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5), json.dumps(edited(v))) for i, v in enumerate(
        {"a0": value(3), "b1": {"c0": value(1), "d": 1}, "l": [value(2) for _ in range(rng.randrange(5))]} for _ in range(300))]
    texts += [(900, '{"a":1.0,"b":[1,1.0]}', '{"b":[1.0,1],"a":1}'), (901, '{"a":1,"a":2}', '{"a":2}'), (902, "[1]]", "[1]"), (903, '{"\\u0061":1}', '{"a":2}')]
    base, cand = (spark.createDataFrame([(t[0], t[k]) for t in texts], "id int, data string") for k in (1, 2))
    cfg = D.CompareConfig(comparators={"data.a0": ("deep-partial", {}), "data.b1.c0": ("type-coercion", {})})

    def found(c):
        rows = D.compare_pairs(D.pair_snapshots(base, cand), c, keep=True).collect()
        fixed = {r["id"]: r["cand_data"] for r in R.apply_repairs(D.pair_snapshots(base, cand), c).collect()}
        return [r["id"] for r in rows if r["_p"]["parted"]], {r["id"]: (sorted(map(str, r["diffs"])), r["similarity"], r["verdict"], fixed[r["id"]]) for r in rows}

    parted, quick = found(cfg)
    assert len(parted) > 200 and not {901, 902} & set(parted)
    monkeypatch.setattr(json_trees, "_sound", lambda text: "false")
    monkeypatch.setattr(json_trees, "_parted", lambda text: "CAST(NULL AS ARRAY<STRING>)")
    none, whole = found(cfg)
    assert not none and {i: (quick[i], w) for i, w in whole.items() if quick[i] != w} == {}
