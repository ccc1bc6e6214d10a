"""File sources. Every reader takes a path, a folder or a list of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import catalog as C
from tidewright.operators import extraction as X

# Paths a corpus scan skips unless told otherwise.
IGNORED_PATHS = (r"/node_modules/", r"/__generated__/", r"/generated/", r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$", r"/dist/")
OPERATION = (
    "struct<id:string,name:string,type:string,content:string,source:string,filePath:string,"
    "line:int,fragments:array<string>,contentFingerprint:string>"
)


def _whole(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("content")
    )


def scan_corpus(
    spark: SparkSession, path: str | Sequence[str], include: str | Sequence[str] = "*",
    ignore: Sequence[str] = IGNORED_PATHS, on_error: str = "fail",
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Files as ``path, content, mtime, size``; several globs are united once.

    With ``on_error="quarantine"`` the result is (good, bad): a file that is not
    valid UTF-8 becomes an error row and the scan goes on.
    """
    paths = [path] if isinstance(path, str) else list(path)
    globs = [include] if isinstance(include, str) else list(include)
    out = None
    for glob in globs:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
        out = files if out is None else out.unionByName(files)
    for pattern in ignore:
        out = out.filter(~F.col("path").rlike(pattern))
    if len(globs) > 1:
        out = out.dropDuplicates(["path"])
    rows = out.select(
        "path", F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")
    )
    valid = F.is_valid_utf8(F.col("content"))
    if on_error == "quarantine":
        bad = rows.filter(~valid).select("path", "mtime", "size", F.lit("EXTRACTION").alias("category"), F.lit("not valid UTF-8").alias("error"))
        return rows.filter(valid), bad
    if on_error != "fail":
        raise ValueError(f"unknown on_error {on_error}")
    return rows.withColumn("content", F.when(valid, F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("not valid UTF-8: "), "path"))
    ))


def read_operation_set(spark: SparkSession, path: str) -> DataFrame:
    """A bare array, or the array under ``queries`` or ``extractedQueries``."""
    rows = _whole(spark, path)
    text = F.trim("content")
    bare = F.when(text.startswith("["), F.from_json(text, f"array<{OPERATION}>"))
    boxed = F.from_json(text, f"struct<queries:array<{OPERATION}>,extractedQueries:array<{OPERATION}>>")
    found = F.coalesce(bare, boxed["queries"], boxed["extractedQueries"], F.raise_error(F.lit("Unknown query file format")))
    ops = rows.select(F.inline(found))
    return ops.withColumn("content", F.coalesce("source", "content")).drop("source")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``id -> {baseline, transformed}`` files as ``id, version, payload`` rows."""
    entries = _whole(spark, path).select(F.explode(F.from_json("content", "map<string,map<string,string>>")).alias("id", "v"))
    return entries.select("id", F.explode("v").alias("version", "payload")).filter(
        F.col("version").isin("baseline", "transformed") & F.col("payload").isNotNull()
    )


def snapshot_fields(snapshots: DataFrame) -> DataFrame:
    """Payload columns the comparison uses."""
    p = F.col("payload")
    return snapshots.select(
        "id", "version", F.get_json_object(p, "$.response.data").alias("data"), F.get_json_object(p, "$.response.errors").alias("errors"),
        F.get_json_object(p, "$.metadata.duration").cast("double").alias("duration"), F.get_json_object(p, "$.metadata.size").cast("double").alias("size"),
    )


def read_contract_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return C.read_lines(_whole(spark, path), "path", "content")


def parse_rules(df: DataFrame, content: str, root: str = "Query") -> DataFrame:
    """``type -> [{name, deprecationReason}]`` JSON as rename rules; root has no parent."""
    fields = df.select(F.explode(F.from_json(content, "map<string,array<struct<name:string,deprecationReason:string>>>")).alias("t", "fs"))
    rows = fields.select("t", F.inline("fs"))
    target = F.regexp_extract("deprecationReason", C.REASON_EXACT, 1)
    return rows.select(
        F.lit("field-rename").alias("type"), F.col("name").alias("old"), target.alias("new"), F.when(F.col("t") != root, F.col("t")).alias("parent")
    ).filter("new <> ''")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_rules(_whole(spark, path), "content")


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """``key: 'name'`` pairs with version and replacement."""
    pair = r"""(\w+)\s*:\s*['"`]([^'"`]+)['"`]"""
    c = F.col("content")
    pairs = F.arrays_zip(X.all_matches(c, pair, 1).alias("key"), X.all_matches(c, pair, 2).alias("name"))
    rows = _whole(spark, path).select(F.inline(pairs))
    return rows.select("key", "name", T.detect_version(F.col("name")).alias("version"), T.suggest_replacement(F.col("name")).alias("replacement"))


def read_catalogs(spark: SparkSession, path: str | None, default: Sequence[tuple[str, str]] = (("customer", "schema.graphql"),)) -> DataFrame:
    """``catalog, path, endpoint, description, is_default``; a missing file gives the default."""
    schema = "catalog string, path string, endpoint string, description string, is_default boolean"
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([(n, p, None, None, i == 0) for i, (n, p) in enumerate(default)], schema)
    conf = F.from_json("content", "struct<schemas:map<string,struct<path:string,endpoint:string,description:string>>,defaultSchema:string>")
    rows = _whole(spark, path).select(conf.alias("c")).select(F.explode("c.schemas").alias("catalog", "s"), F.col("c.defaultSchema").alias("d"))
    return rows.select("catalog", "s.path", "s.endpoint", "s.description", (F.col("catalog") == F.col("d")).alias("is_default"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_sections(spark: SparkSession, path: str, fence: str = "javascript") -> DataFrame:
    """Sections after each ``## ``: first line is the name, the fenced block the body."""
    parts = _whole(spark, path).select("path", F.posexplode(F.split("content", "## ")).alias("section_no", "section"))
    body = F.regexp_extract("section", rf"```{fence}([\s\S]*?)```", 1)
    return parts.filter("section_no > 0").select(
        "path", "section_no", F.trim(F.regexp_extract("section", r"\A\s*([^\n]*)", 1)).alias("name"),
        F.regexp_replace(body, r"\A\s+|\s+\z", "").alias("body"),
    ).filter(F.col("body") != "")


def read_usage_csv(spark: SparkSession, path: str, lists: Sequence[str] = ()) -> DataFrame:
    """Audit tables: quoted cells, list cells split on ``, ``. No type inference."""
    df = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    return df.withColumns({c: F.split(c, ", ") for c in lists}) if lists else df
