"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.bpe import encode_texts
from tidewright.llm.jaccard import jaccard_join
from tidewright.llm.language import UNDETERMINED, identify_languages
from tidewright.llm.mixing import mix_sources
from tidewright.llm.pii import replace_entities
from tidewright.session import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, a missing ``lang`` filled with it; null texts and texts without letters are rejected.

    Cosines fall with the length of a text, so none is too small. Where no language is learned, because no text is labelled, none is
    told: then all texts with a letter stay, as they are.
    """
    told = F.when(F.col("lang_pred") != UNDETERMINED, F.col("lang_pred"))
    kept = identify_languages(docs).filter(told.isNotNull() | F.regexp_like("text", F.lit(r"\p{L}")))
    return kept.withColumn("lang", F.coalesce("lang", told)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays, null ids last; ties go by the text's hash.

    Documents without words are in no group and stay. Of rows with equal id and text one stays. Rows are told apart by id and
    text, so repeated and null ids lose and keep nothing they should not.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    groups = jaccard_join(docs.select(key.alias("doc_id"), "text"), width=5, percent=80)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("times"))
    first = first.select(F.struct("doc_id", "times").alias("found"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    kept = held.join(first, F.col("key") == F.col("found.doc_id"))
    once, again = kept.filter("found.times = 1"), kept.filter("found.times > 1").dropDuplicates(["key"])
    return once.select("row").union(again.select("row")).select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and credentials in their texts replaced by surrogates; ``n_chars`` counts the new text."""
    return replace_entities(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows of equal id, source and text are taken as often as the mix takes them together."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    mixed = mix_sources(held.select("doc_id", "text", "source", "hash"), carry=("hash",))
    key = F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("\x00")), F.col("hash").cast("string"))
    copies = mixed.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies")).filter(F.get("copies", F.lit(0)) > 0)
    placed = held.select("row", key.alias("key")).join(copies, "key")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1
    taken = placed.withColumn("n", F.get("copies", turn)).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: (doc_id, lang, source, n_tokens, ids as little-endian unsigned 32-bit integers)."""
    encoded = encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("byte_bpe", byte_bpe),
]
ORACLE_SQL = None  # no stage's method can be written in SQL; the tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
