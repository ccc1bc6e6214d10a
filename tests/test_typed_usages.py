"""Typed usages, names and plans."""

import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from tidewright.functions.selections import field_arrays, read_fields
from tidewright.operators import catalog as C
from tidewright.operators import extraction as X
from tidewright.operators import usage
from tidewright.functions import text as T


def test_only_selected_fields_are_read():
    text = 'query name($name: String = "{x}") { # name\n a: user(id: {name: 1}) @include(if: $name) { name ...F ... on T { t } ... @skip(if: true) { s } } ${hole} } fragment F on U { u { v } }'
    got = [(n, alias, depth, scope, tuple(trail)) for _, n, alias, depth, scope, trail in read_fields(text)]
    assert got == [
        ("user", "a", 1, "query", ()), ("name", None, 2, "query", ("user",)), ("t", None, 3, "T", ()), ("s", None, 3, "query", ("user",)),
        ("u", None, 1, "U", ()), ("v", None, 2, "U", ("u",)),
    ]
    assert all(text[at:at + len(n)] == n for at, n, *_ in read_fields(text))


def test_main_root_field_and_pattern(spark):
    rows = spark.createDataFrame([(1, "{ me { a } product { b } }"), (2, "query Q($a: In = {x: 1}) { product { c } }"), (3, "{ a { ...OrderConnection bConnection } }"), (4, "{ me { a } }"), (5, "{ xConnection { a } }")], "id int, c string")
    got = {r["id"]: (r["root"], r["p"]) for r in rows.select("id", X.root_field(F.col("c")).alias("root"), T.query_pattern(F.col("c")).alias("p")).collect()}
    assert [got[i][0] for i in (1, 2, 4)] == ["product", "product", "me"]
    assert [got[i][1] for i in (3, 5)] == ["NESTED_QUERY", "PAGINATED_QUERY"]


def test_made_names_avoid_given_ones(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a_1", "z"), (4, "a", "x"), (5, "a", "w"), (6, "", "q")], "id int, name string, body string")
    got = {r["id"]: r["unique_name"] for r in X.uniquify_names(rows, "name", "body", "id").collect()}
    assert got[1] == got[4] == "a" and got[3] == "a_1" and got[6] == "" and len({got[1], got[2], got[3], got[5]}) == 4


def test_json_types_of_common_keys(spark):
    rows = spark.createDataFrame([(1, '{"zip":"12345","flag":"true","n":1.5,"b":true,"o":{"x":1},"l":[1]}')], "id int, p string")
    got = {r["key"]: r["types"] for r in X.common_keys(rows, "id", "p").collect()}
    assert got == {"zip": "string", "flag": "string", "n": "number", "b": "boolean", "o": "object", "l": "array"}


def test_reports_read_the_fact_once(spark, tmp_path):
    rows = [(i % 7, f"f{i % 5}", f"n{i % 3}", "e", "pick") for i in range(200)]
    spark.createDataFrame(rows, "unit int, field string, normalized string, entity_type string, access_method string").write.parquet(str(tmp_path / "fact"))
    access = spark.read.parquet(str(tmp_path / "fact"))
    for report in (usage.usage_report(access), usage.field_flags(access), usage.data_dictionary(access, F.lit("c"))):
        assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString()  # every branch reads the stored fold


def test_functions_run_from_another_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1]); import os\n"
        "import __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
        "os.environ.pop('PYTHONPATH', None)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('ROWS', e.queries()['mine_usages'](spark, '/root/testdata/sf0.001').count())\n"
    )
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-800:]


def test_fields_come_as_whole_columns():
    """Same rows as the reader, a null for a null text, and no row is made in Python one by one."""
    texts = ["{ a(x: 1) { b } }", None, "", "fragment F on U { ... on (x) { c: d @e(f: $g) } h((i) { j }) k } l", '{ m(t: "(") { n } # )\n o(p: ${q(}) }']
    got = field_arrays(pa.array(texts, pa.string()))
    assert [None if g is None else [tuple(f.values()) for f in g] for g in got.to_pylist()] == [None if t is None else list(read_fields(t)) for t in texts]
    assert [[f["name"] for f in g or []] for g in got.to_pylist()] == [["a", "b"], [], [], ["x", "d", "h", "k"], ["m", "n", "o"]]


def test_texts_of_one_file_are_dealt_before_they_are_read(spark):
    """A table in one partition is read by more than one task."""
    ops = spark.range(0, 64, 1, 1).select("id", F.concat(F.lit("{ a { f"), F.col("id").cast("string"), F.lit(" } }")).alias("content"))
    catalog = spark.createDataFrame([("Query", "a", "A")], "type_name string, field_name string, field_type string")
    found = C.mine_usages(ops, catalog)
    assert found.filter("is_root").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {(r["path"], r["type_name"]) for r in found.collect()} == {("a", "Query")} | {(f"a.f{i}", "A") for i in range(64)}
