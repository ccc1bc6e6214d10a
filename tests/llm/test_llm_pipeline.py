"""The pipeline's stages and the registered queries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, edges):
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars")
    near = corpus_pipeline.near_duplicates(spark, docs, "")
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 8, 9, 10]
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}.isdisjoint({3, 4, 5, 9})
    mail = docs.withColumn("text", F.when(F.col("doc_id") == 6, "to a@b.org").otherwise(F.col("text")))
    told = {r["doc_id"]: r for r in corpus_pipeline.pii(spark, mail, "").collect()}
    assert told[6]["text"].startswith("to ") and "a@b.org" not in told[6]["text"] and told[6]["n_chars"] == len(told[6]["text"])
    mixed = corpus_pipeline.mixing(spark, docs, "").groupBy("doc_id").count().collect()
    assert mixed and all(r["count"] <= (4 if r["doc_id"] == 2 else 2) for r in mixed)
    last = corpus_pipeline.byte_bpe(spark, docs, "").collect()
    assert len(last) == 12 and all(len(np.frombuffer(r["ids"], "<u4")) == r["n_tokens"] for r in last)


def test_short_clean_texts_of_learned_languages_stay(spark):
    import zlib

    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 4 == 2]
    taught = {"en": "the house of the river was there and people were walking to it", "fr": "les maisons du village sont belles quand il pleut sur la route", "zh": "我们在学校里学习中文和数学"}
    short = [("Avec.", "fr"), ("A.", "en"), ("Edrere.", "en"), ("Osrañ.", "es"), ("好", "zh"), ("Oui", "fr")]
    rows = [(i, f"{t} {t[:i]}", lang) for k, (lang, t) in enumerate(taught.items()) for i in range(40 * k, 40 * k + 40)]
    rows += [(i, t, lang) for i, (t, lang) in zip(held, short, strict=False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r["text"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert {t for t, _ in short} <= kept


def test_stages_take_empty_tables(spark, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_the_smallest_tables(spark, name):
    from compare import connect, rows_of

    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        cur = connect(SF).execute(ORACLES[name])
        names, want = [c[0] for c in cur.description], cur.fetchall()
        assert rows_of(df.columns, rows) == rows_of(names, want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_repeated_and_null_ids_in_near_duplicates(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (2, text), (2, text), (None, text), (None, text), (2, "another text"), (None, "and a third one"), (None, "and a third one"), (3, None), (3, "")]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id bigint, text string, _key string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert {(r[0], r[1]) for r in got if r[0] != 3} == {(1, text), (2, "another text"), (None, "and a third one")}
    assert {r[2] for r in got} == {"kept"} and len(got) == 4


def test_languages_are_filled_and_unlabelled_corpora_stay(spark):
    texts = ["the house of the river was there", "people were walking to it", "123 !!!", None]
    plain = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, plain, "").collect()} == {0, 1}
    taught = [(i, f"the house of the river was there {i} people walking", "en") for i in range(100, 160)]
    mixed = spark.createDataFrame([*taught, (0, texts[0], None), (1, texts[1], "xx")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, mixed, "").collect()}
    assert got[0] == "en" and got[1] == "xx" and len(got) == 62
