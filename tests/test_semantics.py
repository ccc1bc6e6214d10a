"""Semantic check of two operation texts."""

from tidewright.operators import rewrite as W

BASE = 'query Q($id: ID!, $n: Int) { user(id: $id) @include(if: $n) { name profile { bio } friends { edges { node { name } } } } }'
CASES = [
    (BASE, []),
    (BASE.replace("{ name profile", "{ fullName profile"), [("warning", "field-rename", "user.name > user.fullName")]),
    (BASE.replace("bio", "about"), [("error", "missing-field", "user.profile.bio"), ("warning", "added", "user.profile.about")]),
    (BASE.replace("profile", "userProfile"), [("warning", "field-rename", "user.profile > user.userProfile"), ("warning", "field-rename", "user.profile.bio > user.userProfile.bio")]),
    (BASE.replace(", $n: Int", "").replace("@include(if: $n) ", ""), [("error", "missing-variable", "n"), ("warning", "missing-directive", "include")]),
    (BASE.replace("friends { edges { node { name } } }", "friends { nodes { name } }"), [
        ("error", "missing-field", "user.friends.edges"), ("error", "missing-field", "user.friends.edges.node"), ("error", "missing-field", "user.friends.edges.node.name"),
        ("warning", "added", "user.friends.nodes"), ("warning", "added", "user.friends.nodes.name"),
        ("incompatible", "shallower", ""), ("warning", "connection removed", ""), ("warning", "nodes added", "")]),
    (BASE.replace("query Q", "mutation Q"), [("error", "kind changed", "")]),
    (None, [("error", "missing-field", p) for p in ("user", "user.name", "user.profile", "user.profile.bio", "user.friends", "user.friends.edges", "user.friends.edges.node", "user.friends.edges.node.name")]),
]


def test_findings_of_two_texts(spark):
    rows = [(i, BASE, after) for i, (after, _) in enumerate(CASES)]
    got = W.semantic_check_texts(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").collect()
    for i, (_, want) in enumerate(CASES):
        found = sorted((r["level"], r["what"], r["field"]) for r in got if r["id"] == i)
        assert [f for f in found if i != 7 or f[1] == "missing-field"] == sorted(want), i


def test_known_renames_and_a_long_string(spark):
    long = '"' + 'x\\"' * 50_000 + '"'
    rows = [(1, "{ a { owner(t: " + long + ") } }", "{ a { holder } }")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    plain = {(r["what"], r["field"]) for r in W.semantic_check_texts(df, "id", "a", "b").collect()}
    told = {(r["what"], r["field"]) for r in W.semantic_check_texts(df, "id", "a", "b", known=(("owner", "holder"),)).collect()}
    assert plain == {("missing-field", "a.owner"), ("added", "a.holder")} and told == {("field-rename", "a.owner > a.holder")}
