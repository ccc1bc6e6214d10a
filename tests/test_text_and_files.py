import json
import time

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import catalog as C
from tidewright.operators import extraction as X
from tidewright.operators import rewrite as W
from tidewright.plans import flows
from tidewright.operators.strategies import regex_strategy
from tidewright.sinks import tables as S
from tidewright.sources import files

CONTRACT = """# head
type User {
  old: String @deprecated(reason: "Use `name`")
  nick(first: Int): String @deprecated(reason: "Please switch to using handle for this")
  logo: Url @deprecated(reason: "moved to profile.logoUrl now")
  junk: Int @deprecated(reason: "do not touch")
  fine: Int
}
  stray: Int @deprecated(reason: "Use `x`")
input I { a: Int @deprecated(reason: "Use `b`") }
interface Node { id: ID @deprecated(reason: "Use key instead") }
type Open {
  z: Int @deprecated(reason: "Use a.b")"""


def test_mine_rules_golden(spark):
    df = spark.createDataFrame([("f", CONTRACT)], "file string, content string")
    got = {(r["object_type"], r["field_name"]): (r["replacement"], r["action"]) for r in C.mine_rules(C.read_lines(df, "file", "content")).collect()}
    assert got == {
        ("User", "old"): ("name", "replace"), ("User", "nick"): ("handle", "replace"), ("User", "logo"): ("profile.logoUrl", "replace"),
        ("User", "junk"): (None, "comment-out"), ("Node", "id"): ("key", "replace"), ("Open", "z"): ("a.b", "replace"),
    }


def one(spark, col, **lits):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in lits.items()]).select(col).first()[0]


def test_normalise_is_idempotent(spark):
    text = "query A { # note\n  b ${x.y}\n\t c }\n"
    once = one(spark, T.normalize_text(F.col("t")), t=text)
    assert once == "query A { b ${...} c }"
    assert one(spark, T.normalize_text(F.col("t")), t=once) == once


@pytest.mark.parametrize("name,pascal,camel", [
    ("getUserName", "GetUserName", "getUserName"), ("get_user-name", "GetUserName", "getUserName"), ("HTTPCall", "Httpcall", "httpcall"), ("", "", ""),
])
def test_case_conventions(spark, name, pascal, camel):
    assert one(spark, T.normalize_name(F.col("n")), n=name) == pascal
    assert one(spark, T.normalize_name(F.col("n"), "camel"), n=name) == camel


def test_rename_only_before_an_argument_list(spark):
    col = T.rename_in_content(F.col("c"), F.col("o"), F.col("n"))
    assert one(spark, col, c="query a.b($x) { a.b } query a.b {", o="a.b", n="C") == "query C($x) { a.b } query a.b {"


def test_infer_name_cascade(spark):
    def infer(**kw):
        args = dict(name="", content="{ a }", path="src/userCard.js", kind="query") | kw
        extra = {k: F.lit(args.pop(k)) for k in ("function", "component", "export") if k in args}
        return one(spark, T.infer_name(*[F.col(c) for c in ("name", "content", "path", "kind")], **extra), **args)

    assert infer(name="Own") == "Own"
    assert infer(name="$x", content="query Inner { a }") == "Inner"
    assert infer(function="useCart") == "UseCartQuery"
    assert infer(component="cartView") == "CartViewQuery"
    assert infer(export="ALL_CAPS") == "ALL_CAPS"
    assert infer() == "UserCardQuery"
    assert infer(path="src/index.js") == ""


def test_mine_access_methods(spark):
    code = "const { a, b: c } = cart; if (cart.type === 'basket' && x?.y.z) {} entityPick(cart, ['p.q', \"r\"]); console.log(1); profile.request.query.page = 1"
    rows = X.mine_access(spark.createDataFrame([(1, code)], "id int, code string"), "id", "code").collect()
    got = sorted((r["field"], r["entity_type"], r["access_method"]) for r in rows)
    assert got == sorted([
        ("a", "basket", "destructuring"), ("b", "basket", "destructuring"), ("type", "basket", "direct"), ("p.q", "basket", "pick"),
        ("r", "basket", "pick"), ("request.query.page", "profile", "direct"), ("z", "unknown", "direct"),
    ])


def test_resolve_templates_reaches_the_fixpoint(spark):
    ops = spark.createDataFrame([(1, "q ${a} ...${on ? 'F1' : 'F2'} ${nope}"), (2, "plain")], "id int, content string")
    bodies = spark.createDataFrame([("a", "A ${b}"), ("b", "B ${c}"), ("c", "C"), ("F2", "x")], "name string, text string")
    got = {r["id"]: r["content"] for r in X.resolve_templates(ops, "id", "content", bodies).collect()}
    assert got == {1: "q A B C ...F2 ${nope}", 2: "plain"}


def test_rewrite_flags_ambiguous_fields(spark):
    ops = spark.createDataFrame([(1, "{\n  alias: old\n  keep\n}"), (2, "{\n  old\n  gone\n}")], "id int, content string")
    ch = spark.createDataFrame(
        [(1, 0, "field-rename", "old", "new", "r"), (2, 0, "field-rename", "old", "new", "r"), (2, 1, "comment-out", "gone", None, "bye")],
        "id int, pos int, type string, old string, new string, reason string",
    )
    got = {r["id"]: r for r in W.rewrite(ops, ch).collect()}
    assert got[1]["needs_review"] and got[1]["transformed"] == got[1]["original"]
    assert got[2]["transformed"] == "# DEPRECATED: gone - bye\n{\n  new\n}"


def test_migrate_flow(spark):
    ops = spark.createDataFrame([(1, "src/a.js", "query A {\n  user {\n    logoUrl\n    nick\n  }\n}")], "id int, file_path string, content string")
    usages = spark.createDataFrame([(1, "User", "logoUrl", 1, "user.logoUrl", False), (1, "User", "nick", 2, "user.nick", False)],
                                   "id int, type_name string, field_name string, pos int, path string, is_root boolean")
    rules = spark.createDataFrame([("CurrentUser", "logoUrl", "Use profile.logoUrl", "profile.logoUrl", False, "replace"), ("User", "nick", "Use name", "name", False, "replace")],
                                  "object_type string, field_name string, reason string, replacement string, is_vague boolean, action string")
    row = flows.migrate(ops, usages, rules, aliases=[("CurrentUser", "User")]).first()
    assert row["transformed"] == "query A {\n  user {\n    profile { logoUrl }\n    name\n  }\n}"
    assert row["pattern"] == "structure-change" and row["gate"] == "manual"


def test_corpus_scan_quarantines_bad_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.js").write_text("gql`query A { x }`")
    (tmp_path / "src" / "b.ts").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "node_modules" / "c.js").write_text("gql`query C { x }`")
    good, bad = files.scan_corpus(spark, str(tmp_path), include=["*.js", "*.[jt]s"], on_error="quarantine")
    assert [r["path"].rsplit("/", 1)[1] for r in good.collect()] == ["a.js"]
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["b.ts"]
    ops = flows.extract_operations(good, [regex_strategy("tagged", r"\.[jt]s$", r"gql`([^`]*)`")])
    assert [(r["query_name"], r["type"]) for r in ops.collect()] == [("A", "query")]


def test_operation_set_shapes(spark, tmp_path):
    op = {"id": "1", "name": "A", "type": "query", "content": "{ a }", "filePath": "f.js", "fragments": ["F"]}
    for i, doc in enumerate(([op], {"queries": [op]}, {"extractedQueries": [op]})):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps(doc))
        assert files.read_operation_set(spark, str(p)).first()["name"] == "A"
    p = tmp_path / "bad.json"
    p.write_text("{}")
    with pytest.raises(Exception, match="Unknown query file format"):
        files.read_operation_set(spark, str(p)).collect()


def test_other_sources(spark, tmp_path):
    snap = tmp_path / "s.json"
    cap = {"response": {"data": {"a": 1}}, "metadata": {"duration": 5, "size": 9}}
    snap.write_text(json.dumps({"q1": {"baseline": cap, "transformed": cap}, "q2": {"baseline": cap}}))
    rows = files.snapshot_fields(files.read_snapshots(spark, str(snap)))
    assert rows.count() == 3 and rows.first()["data"] == '{"a":1}' and rows.first()["duration"] == 5.0
    rules = tmp_path / "r.json"
    rules.write_text(json.dumps({"Query": [{"name": "a", "deprecationReason": "Use `b`"}], "T": [{"name": "c", "deprecationReason": "gone"}]}))
    assert [tuple(r) for r in files.read_rules(spark, str(rules)).collect()] == [("field-rename", "a", "b", None)]
    names = tmp_path / "n.js"
    names.write_text("export const n = {\n byIdV1: 'getUser',\n other: \"listV2\" };")
    got = {r["key"]: (r["name"], r["version"], r["replacement"]) for r in files.read_name_map(spark, str(names)).collect()}
    assert got == {"byIdV1": ("getUser", "V1", "getUserV2"), "other": ("listV2", "V2", None)}
    conf = tmp_path / "c.json"
    conf.write_text(json.dumps({"schemas": {"x": {"path": "p", "endpoint": "e", "description": "d"}, "y": {"path": "q"}}, "defaultSchema": "y"}))
    assert {r["catalog"]: r["is_default"] for r in files.read_catalogs(spark, str(conf)).collect()} == {"x": False, "y": True}
    assert files.read_catalogs(spark, str(tmp_path / "none.json")).count() == 1
    doc = tmp_path / "d.md"
    doc.write_text("# title\n## one\ntext\n```javascript\nlet a\n```\n## two\nno code\n## three\n```javascript\nb\n```\n")
    assert [(r["name"], r["body"]) for r in files.read_sections(spark, str(doc)).collect()] == [("one", "let a"), ("three", "b")]
    csv = tmp_path / "u.csv"
    csv.write_text('Field,Users\n"a","x, y"\n')
    assert files.read_usage_csv(spark, str(csv), ["Users"]).first()["Users"] == ["x", "y"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "query", "a b", ["x", "y"]), (2, "mutation", 'q"uote', [])], "id int, kind string, name string, tags array<string>")
    S.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    S.write_by_kind(df, str(tmp_path / "k"))
    assert {p.name for p in (tmp_path / "k" / "section=queries").iterdir()} == {"kind=query", "kind=mutation"}
    S.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "c"))
    assert {(r["name"], r["tags"]) for r in back.collect()} == {("a b", "x, y"), ('q"uote', "" if back.filter("tags is null").count() == 0 else None)}
    diffs = spark.createDataFrame([(1, 0, "-", "a"), (1, 0, "+", "b")], "id int, line_no int, op string, text string")
    S.write_text_diffs(diffs, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2


def test_snapshot_store_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "query_id int, version string, ts timestamp, payload string"
    for day, text in ((1, "old"), (3, "new"), (2, "mid")):
        rows = spark.createDataFrame([(1, "baseline", None, text)], schema).withColumn("ts", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp"))
        S.append_snapshots(rows, path)
    assert S.read_store(spark, path).first()["payload"] == "new"
    kept, dropped = S.apply_retention(spark.read.parquet(path), F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert kept.count() == 2 and dropped.first()[0] == 1


def test_file_queries_write_more_files_not_larger_ones(spark, tmp_path, monkeypatch):
    from tidewright.catalogue import QUERIES, file_queries as Q

    monkeypatch.setattr(Q, "FILE_ROWS", 50, raising=False)
    monkeypatch.setattr(Q, "FILE_BYTES", 2000, raising=False)
    sf = str(tmp_path)
    spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 10).alias("text")).write.parquet(f"{sf}/documents.parquet")
    # one user has all events
    spark.range(2000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.lit('{"k":3}').alias("props")).write.parquet(f"{sf}/events.parquet")
    written = []
    make = Q.folder
    monkeypatch.setattr(Q, "folder", lambda *a: written.append(make(*a)) or written[-1])
    lines = {r["part"]: r["lines"] for r in QUERIES["scan_corpus"].run(spark, sf).collect()}
    assert lines == {p: 250 for p in range(16) if p != 3}
    status = sorted((r["part"], r["status"]) for r in QUERIES["scan_corpus_globs"].run(spark, sf).collect())
    assert status == [(p, "bad" if p == 5 else "good") for p in range(16)]
    assert QUERIES["read_snapshot_files"].run(spark, sf).count() == 2000 + 667
    for path, most in zip(written, (8000, 8000, 10_000), strict=True):
        sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()
        assert max(r["length"] for r in sizes) <= most


def test_access_patterns_try_each_word_once_and_match_the_same(spark):
    """The quick patterns against the plain ones they stand for, and their time on long words."""
    texts = [
        "a.b??c.d) a.??b e.f ?? g.h.i!=1 x.y\n&& z?.q||k.l  )m.n>o.p<q", "ab.type === 'x' é.type===\"y\" c.d.type\n=== `z`", "a.b?.c? d.e.=f..g=", "aé.b= _x9.y9=1 ?a.b?? ??", "", "....===",
        "entityPick(a, ['x', \"y\"\n]) entityPick ( b ,[ ] ] ) ) entityPick(c, ['z'] ]x)",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    plain_type = r"""(\w+)\.type\s*===\s*['"`](\w+)['"`]"""
    plain_pick = r"entityPick\s*\(\s*(\w+)\s*,\s*\[([\s\S]*?)\]\s*\)"
    for quick, plain in ((X.DIRECT_ONCE, X.DIRECT), (X.ANY_TYPE, plain_type), (X.PICK, plain_pick)):
        for group in (0, 1, 2):
            both = df.select(X.all_matches(F.col("t"), quick, group).alias("a"), X.all_matches(F.col("t"), plain, group).alias("b")).collect()
            assert all(r["a"] == r["b"] for r in both) and any(r["a"] for r in both)
    long = spark.createDataFrame([(1, "w" * 300_000 + " a.type === 'x' a.b=")], "id int, code string")
    start = time.time()
    assert {r["field"] for r in X.mine_access(long, "id", "code").collect()} == {"type", "b"}
    assert time.time() - start < 10
