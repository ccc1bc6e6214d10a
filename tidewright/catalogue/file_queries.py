"""Files written from the given tables by the sinks and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import CATALOG, OPS, catalog, ops
from tidewright.catalogue.registry import query, table
from tidewright.operators import catalog as C
from tidewright.operators import rewrite as W
from tidewright.session import shared_folder
from tidewright.sinks import tables as S
from tidewright.sources import files


# What one file holds: a file is read back as one row, so files grow in number with the table, not in size.
FILE_ROWS, FILE_BYTES = 10_000, 8 << 20


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/files-{name}-{uuid.uuid4().hex}"


def _written(df, spark, name: str) -> str:
    """Rows (key, text) as one text file for each of many keys' groups; a text is one line of JSON or several plain lines."""
    path = folder(spark, name)
    df.select("text").write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def _group(id_col: str, groups: int):
    return F.pmod(F.xxhash64(id_col), F.lit(groups))


@query("read_operation_set", f"WITH {OPS} SELECT CAST(id AS VARCHAR) AS id, name, kind AS type, content, file_path FROM ops")
def read_operation_set(spark, sf):
    """Operations written as JSON sets, one set for at most about ``FILE_ROWS`` of them, read back row by row."""
    row = F.struct(F.col("id").cast("string").alias("id"), "name", F.col("kind").alias("type"), F.col("content").alias("source"), F.col("file_path").alias("filePath"))
    all_ops = ops(spark, sf)
    sets = all_ops.groupBy(_group("id", all_ops.count() // FILE_ROWS + 1).alias("part")).agg(F.to_json(F.struct(F.collect_list(row).alias("queries"))).alias("text"))
    path = folder(spark, "operations")
    sets.write.partitionBy("part").text(path)
    found = files.read_operation_set(spark, path)
    return found.select("id", "name", "type", "content", F.col("filePath").alias("file_path"))


@query("read_snapshot_files", """SELECT CAST(event_id AS VARCHAR) AS id, 'baseline' AS version, '{"k":' || json_extract_string(props, '$.k') || '}' AS data FROM events
 UNION ALL SELECT CAST(event_id AS VARCHAR), 'transformed', NULL FROM events WHERE event_id % 3 = 0""")
def read_snapshot_files(spark, sf):
    e = table(spark, sf, "events")
    good = F.concat(F.lit('{"response":{"data":{"k":'), F.get_json_object("props", "$.k"), F.lit("}}}"))
    pair = F.concat(F.lit('"baseline":'), good, F.when(F.col("event_id") % 3 == 0, ',"transformed":{"response":{"data":null}}').otherwise(""))
    entry = F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('":{'), pair, F.lit("}"))
    sets = e.groupBy(_group("event_id", e.count() // FILE_ROWS + 1).alias("part")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("text"))
    path = folder(spark, "snapshots")
    sets.write.partitionBy("part").text(path)
    return files.snapshot_fields(files.read_snapshots(spark, path)).select("id", "version", "data")


@query("csv_round_trip", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment || ', "' || c_nationkey || '"' AS tags, 2 AS n FROM customer""")
def csv_round_trip(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.col("c_mktsegment"), F.concat(F.lit('"'), F.col("c_nationkey").cast("string"), F.lit('"'))).alias("tags"))
    path = folder(spark, "csv")
    S.write_csv(rows, path)
    back = files.read_usage_csv(spark, path, lists=["tags"])
    return back.select("id", "name", F.array_join("tags", ", ").alias("tags"), F.size("tags").alias("n"))


@query("json_round_trip", "SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def json_round_trip(spark, sf):
    path = folder(spark, "json")
    S.write_json(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), path)
    return spark.read.schema("id bigint, status string, priority string").json(path)


@query("write_by_kind", f"WITH {OPS} SELECT id, kind, regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') AS file_name, CASE WHEN id % 4 = 0 THEN 'variants' ELSE 'queries' END AS section FROM ops")
def write_by_kind(spark, sf):
    path = folder(spark, "kinds")
    S.write_by_kind(ops(spark, sf).withColumn("is_variant", F.col("id") % 4 == 0), path)
    return spark.read.parquet(path).select("id", "kind", "file_name", "section")


@query("text_diff_buckets", """SELECT doc_id AS id, 0 AS line_no, '-' AS op, lang AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, '+', source FROM documents WHERE doc_id % 2 = 0""")
def text_diff_buckets(spark, sf):
    from tidewright.operators import diff as D

    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("old"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("lang")).alias("new"))
    path = folder(spark, "diffs")
    S.write_text_diffs(D.line_diff(d, "doc_id", "old", "new"), path)
    return spark.read.parquet(path).select("id", "line_no", "op", "text")


@query("report_store", "SELECT o_orderkey AS report_id, o_orderstatus AS kind, o_totalprice AS total FROM orders UNION ALL SELECT o_orderkey, 'again', o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def report_store(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("total"))
    path = folder(spark, "reports")
    S.write_reports(o, path)
    S.write_reports(o.filter("report_id % 2 = 0").withColumn("kind", F.lit("again")), path)
    return spark.read.parquet(path).select("report_id", "kind", "total")


@query("read_name_map", """SELECT 'k' || c_custkey AS key, 'get' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN 'V2' ELSE '' END AS name FROM customer""")
def read_name_map(spark, sf):
    c = table(spark, sf, "customer")
    name = F.concat(F.lit("get"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "V2").otherwise(""))
    line = F.concat(F.lit("  k"), F.col("c_custkey").cast("string"), F.lit(": '"), name, F.lit("',"))
    path = _written(c.select(line.alias("text")), spark, "names")
    return files.read_name_map(spark, path).select("key", "name")


def _corpus(spark, sf, broken: int = -1) -> str:
    """Documents as text files of about ``FILE_BYTES``, at least one per part; the files of part ``broken`` are not valid UTF-8."""
    path = folder(spark, "corpus")
    line = F.regexp_replace("text", r"[\r\n]", " ")
    odd = F.concat(F.unhex(F.lit("FF")), line.cast("binary")).cast("string")
    docs = table(spark, sf, "documents")
    groups = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (16 * FILE_BYTES) + 1
    rows = docs.select(_group("doc_id", groups).alias("group"), (F.col("doc_id") % 16).alias("part"), F.when(F.col("doc_id") % 16 == broken, odd).otherwise(line).alias("value"))
    rows.repartition("part", "group").write.partitionBy("part", "group").text(path)
    return path


def _lines(found):
    part = F.regexp_extract("path", r"/part=(\d+)/", 1).cast("bigint")
    lines = found.select(part.alias("part"), F.regexp_count("content", F.lit("\n")).cast("bigint").alias("lines"))
    return lines.filter("part IS NOT NULL AND lines > 0").groupBy("part").agg(F.sum("lines").alias("lines"))


@query("scan_corpus", "SELECT doc_id % 16 AS part, count(*) AS lines FROM documents WHERE doc_id % 16 <> 3 GROUP BY 1")
def scan_corpus(spark, sf):
    """The scan skips an ignored folder and reads every other file."""
    return _lines(files.scan_corpus(spark, _corpus(spark, sf), ignore=(r"/part=3/", r"/_", r"\.crc$")))


@query("scan_corpus_globs", "SELECT doc_id % 16 AS part, CASE WHEN doc_id % 16 = 5 THEN 'bad' ELSE 'good' END AS status FROM documents GROUP BY 1, 2")
def scan_corpus_globs(spark, sf):
    """Two globs that both match give each file once; a file that is not valid UTF-8 goes apart."""
    good, bad = files.scan_corpus(spark, _corpus(spark, sf, broken=5), include=["part-*", "*.txt"], ignore=(r"/_", r"\.crc$"), on_error="quarantine")
    part = F.regexp_extract("path", r"/part=(\d+)/", 1).cast("bigint").alias("part")
    return good.filter("size > 0").select(part, F.lit("good").alias("status")).unionByName(bad.select(part, F.lit("bad").alias("status"))).distinct()


# Typed usages: one field name under two types, in the operation's name, as a variable and as an argument.
_TYPED = r"""t AS (SELECT o_orderkey AS id, 'f' || (o_custkey % 5) AS f FROM orders)"""


def typed_ops(spark, sf):
    f = F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string"))
    text = F.concat(
        F.lit("query "), f, F.lit("($"), f, F.lit(": String) {\n  user {\n    "), f, F.lit("\n    profile {\n      "), f, F.lit("\n    }\n  }\n  product("), f, F.lit(": $"), f,
        F.lit(') {\n    other: '), f, F.lit('\n    ... on User { '), f, F.lit(" }\n  }\n}"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("content"))


def typed_catalog(spark):
    rows = [("Query", "user", "User"), ("Query", "product", "Product"), ("User", "profile", "Profile")]
    rows += [(t, f"f{i}", "String") for i in range(4) for t in ("User", "Product", "Profile")]
    return spark.createDataFrame(rows, "type_name string, field_name string, field_type string")


@query("mine_usages", f"""WITH {_TYPED}, u(pos, path, type_name, own, is_root) AS (VALUES (0, 'user', 'Query', 'user', true), (1, 'user.F', 'User', 'F', false), (2, 'user.profile', 'User', 'profile', false),
 (3, 'user.profile.F', 'Profile', 'F', false), (4, 'product', 'Query', 'product', true), (5, 'product.F', 'Product', 'F', false), (6, 'F', 'User', 'F', true))
 SELECT id, pos, replace(path, 'F', f) AS path, type_name, CASE WHEN own = 'F' THEN f ELSE own END AS field_name, is_root FROM t, u""")
def mine_usages(spark, sf):
    return C.mine_usages(typed_ops(spark, sf), typed_catalog(spark)).select("id", "pos", "path", "type_name", "field_name", "is_root")


@query("rewrite_typed", f"""WITH {_TYPED}, o AS (SELECT *, CASE f WHEN 'f0' THEN 'first' WHEN 'f1' THEN 'second' ELSE f END AS r FROM t)
 SELECT id, 'query ' || f || '($' || f || ': String) {{' || chr(10) || '  user {{' || chr(10) || '    ' || r || chr(10) || '    profile {{' || chr(10) || '      ' || f || chr(10) || '    }}' || chr(10) || '  }}' || chr(10)
 || '  product(' || f || ': $' || f || ') {{' || chr(10) || '    other: ' || f || chr(10) || '    ... on User {{ ' || r || ' }}' || chr(10) || '  }}' || chr(10) || '}}' AS transformed, CASE WHEN r <> f THEN 2 ELSE 0 END AS applied FROM o""")
def rewrite_typed(spark, sf):
    """Two reasons for one field count once, the later one; only fields of the ruled type change."""
    rules = spark.createDataFrame(
        [("User", "f0", "Use `wrong`", "wrong", False, "a", 1), ("User", "f0", "Use `first`", "first", False, "a", 2), ("User", "f1", "Use `second`", "second", False, "a", 3)],
        "object_type string, field_name string, reason string, replacement string, is_vague boolean, file string, line_no int")
    texts = typed_ops(spark, sf)
    ruled = C.apply_rule_lookup(C.mine_usages(texts, typed_catalog(spark)), rules)
    return W.rewrite_at(texts, W.change_rows(ruled)).select("id", "transformed", "applied")


@query("mine_rules_from_files", f"WITH {CATALOG} SELECT object_type, field_name, reason, replacement FROM rules")
def mine_rules_from_files(spark, sf):
    """Contract files, one per part type, written and read as files."""
    c = catalog(spark, sf)
    line = F.concat(F.lit("  "), "field_name", F.lit("(first: Int): String"), F.when(F.col("is_deprecated"), F.concat(F.lit(' @deprecated(reason: "'), "reason", F.lit('")'))).otherwise(""))
    body = c.groupBy("type_name").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(F.lit("type "), F.initcap(F.lower("type_name")), F.lit(" {\n"), "body", F.lit("\n}"))
    path = folder(spark, "contracts")
    body.select("type_name", text.alias("text")).repartition("type_name").write.partitionBy("type_name").text(path)
    return C.mine_rules(files.read_contract_lines(spark, path)).select("object_type", "field_name", "reason", "replacement")
