"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.bpe import round_trip_digests
from tidewright.llm.embeddings import near_duplicate_vectors
from tidewright.llm.fingerprints import edited_fingerprints
from tidewright.llm.jaccard import jaccard_join
from tidewright.llm.language import held_out, identify_languages
from tidewright.llm.mixing import mix_sources
from tidewright.llm.pii import replace_entities
from tidewright.llm.quality import score_quality
from tidewright.llm.ranked import ranked_search
from tidewright.llm.registry import ORACLES, QUERIES, query, table
from tidewright.llm.repetition import MAX_COVERED, MAX_REPEAT, MIN_REPEAT, base_failed, repeats_too_much, repetition
from tidewright.llm.runs import word_runs
from tidewright.llm.sharding import shard_by_bytes
from tidewright.llm.toxicity import learn_toxicity, score_toxicity

__all__ = ["ORACLES", "QUERIES"]


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs, keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


@query("op3_ngram_jaccard", r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
   ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w WHERE w IS NOT NULL),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
 r AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL""")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


@query("op6_embedding_dedup", """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.9),
 r AS (SELECT vec_id AS a, vec_id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
 c AS (SELECT a, min(root) AS component_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
 SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM e JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id""")
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out("doc_id", 5, 0)
    weights = learn_toxicity(docs, table(spark, sf_dir, "labels"), ~out)
    scored = score_toxicity(docs, weights, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_mixing", r"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
 w AS (SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
 o AS (SELECT *, cap / weight AS ratio FROM w),
 l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
    - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
 f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
 t AS (SELECT source, source_size, rank, least(cap, weight * coalesce((SELECT level FROM f), 0)) AS target FROM o),
 c AS (SELECT d.doc_id, d.size, d.k, t.*, sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.k, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 q AS (SELECT *, CASE WHEN target > 0 THEN CAST(turn * source_size + cum AS BIGINT)::DOUBLE / target END AS finish FROM c, (SELECT unnest([0, 1]) AS turn)),
 e AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, rank, turn, k, size, doc_id ROWS UNBOUNDED PRECEDING) AS fill FROM q)
 SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(sum(CASE WHEN fill - size < (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AND finish IS NOT NULL THEN size ELSE 0 END) AS BIGINT) AS taken
 FROM e GROUP BY ALL""")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def repeat_from(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where every tenth document, by the checksum of its id, repeats a stretch of its words to its end. Null ids repeat nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    sized = words.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    placed = placed.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    again = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)")
    edited = F.array_join(F.concat(F.expr("slice(w, 1, a)"), again), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(repeat_from(table(spark, sf_dir, "documents")), least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_repetition", rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
 i AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
 g AS (SELECT doc_id, i, k, hash(list_slice(w, i, i + k - 1)) AS h FROM i, (SELECT unnest([3, {MIN_REPEAT}, {MAX_REPEAT + 1}]) AS k) WHERE i + k - 1 <= len(w)),
 m AS (SELECT doc_id, k, h FROM g GROUP BY ALL HAVING count(*) > 1),
 c AS (SELECT doc_id, k, count(DISTINCT i + j) AS covered FROM g JOIN m USING (doc_id, k, h), (SELECT unnest(range(0, {MAX_REPEAT + 1})) AS j) WHERE j < k GROUP BY 1, 2),
 l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
 s AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM l GROUP BY 1),
 b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
   CAST(coalesce(x.covered, 0) AS BIGINT) AS n_repeat_words, coalesce(y.covered, 0) AS covered, z.covered IS NOT NULL AS long
  FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c x ON x.doc_id = w.doc_id AND x.k = 3 LEFT JOIN c y ON y.doc_id = w.doc_id AND y.k = {MIN_REPEAT} LEFT JOIN c z ON z.doc_id = w.doc_id AND z.k = {MAX_REPEAT + 1}),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT long AND 100 * covered <= {MAX_COVERED} * n_words AS kept FROM f""")
def op13_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition(table(spark, sf_dir, "documents")).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & ~repeats_too_much()
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


@query("op12_ranked_search", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
 m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n, g),
 f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM b) GROUP BY 1, 2),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, docs),
 s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM b JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
