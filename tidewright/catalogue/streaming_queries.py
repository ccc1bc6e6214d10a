"""The event table replayed as a stream; results are read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import CALLS
from tidewright.catalogue.registry import query, table
from tidewright.operators.experiments import assign_arm
from tidewright.streaming import jobs as J

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def replay(spark, sf):
    """The events file as a stream of calls, one file per trigger."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(sf)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"), (k % 10 != 0).alias("ok"),
        F.round(F.col("value") * 100).cast("bigint").alias("latency"), F.col("user_id"), k.alias("k"),
    )


@query("stream_health", f"""WITH {CALLS}, m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM calls), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, op, count(*) AS total, count_if(NOT ok) AS errors, CAST(quantile_disc(latency, 0.99) AS BIGINT) AS p99, max(ts) FILTER (WHERE NOT ok) AS bad FROM calls GROUP BY 1, 2)
 SELECT epoch_ms(s) // 1000 AS window_start, op, total, errors, p99, CASE WHEN total < 100 THEN 'healthy' WHEN errors::DOUBLE / total > 0.01 THEN 'unhealthy' WHEN p99 > 2000 THEN 'degraded' ELSE 'healthy' END AS status FROM w, m WHERE s + INTERVAL 1 HOUR <= wm""")
def stream_health(spark, sf):
    out = J.run_to_table(J.health_windows(replay(spark, sf), "1 hour"), "health")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "op", "total", "errors", F.col("p99").cast("bigint").alias("p99"), "status")


@query("stream_arm_windows", f"""WITH {CALLS}, h AS (SELECT *, list_reduce(list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296, 0::BIGINT) AS u FROM calls),
 a AS (SELECT *, CASE WHEN abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 100 < 30 THEN 'variant' ELSE 'control' END AS arm FROM h), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM calls),
 w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * o AS s, op AS experiment, arm, ok, latency FROM a, (VALUES (0), (1)) t(o))
 SELECT epoch_ms(s) // 1000 AS window_start, experiment, count_if(arm = 'variant') AS variant_requests, count_if(arm = 'variant' AND NOT ok) AS variant_errors,
  coalesce(count_if(arm = 'variant' AND NOT ok)::DOUBLE / nullif(count_if(arm = 'variant'), 0), 0) > 0.05 OR coalesce(avg(latency) FILTER (WHERE arm = 'variant') / avg(latency) FILTER (WHERE arm = 'control') > 2.0, false) AS roll_back FROM w, m WHERE s + INTERVAL 2 HOUR <= wm GROUP BY 1, 2""")
def stream_arm_windows(spark, sf):
    calls = replay(spark, sf).withColumn("experiment", F.col("op")).withColumn("arm", assign_arm(F.col("event_id").cast("string"), F.lit(30)))
    out = J.run_to_table(J.arm_windows(calls, "2 hours", "1 hour"), "arms")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "experiment", "variant_requests", "variant_errors", "roll_back")


@query("stream_last_samples", f"""WITH {CALLS}, l AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ts DESC, event_id DESC) AS r FROM calls)
 SELECT op, count(*) AS seen, count_if(r <= 1000) AS kept, CAST(sum(latency) FILTER (WHERE r <= 1000) AS BIGINT) AS total FROM l GROUP BY 1""")
def stream_last_samples(spark, sf):
    out = J.run_to_table(J.last_samples(replay(spark, sf)), "samples", mode="update")
    newest = out.groupBy("op").agg(F.max_by(F.struct("seen", "kept", "total"), "batch").alias("r"))
    return newest.select("op", "r.seen", "r.kept", "r.total")


@query("stream_deduplicated", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_deduplicated(spark, sf):
    once = replay(spark, sf)
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = J.run_to_table(J.deduplicated(twice).select("event_id"), "dedup")
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("stream_rollout_controller")
def stream_rollout_controller(spark, sf):
    return J.run_to_table(J.rollout_controller(replay(spark, sf), sample=50, limit=0.2), "rollout")


@query("stream_alerts", f"""WITH {CALLS} SELECT event_id, 'duration' AS type, CASE WHEN latency * 4 > 5000 THEN 'error' ELSE 'warn' END AS level FROM calls WHERE k % 5 = 0 AND latency * 4 > 1000
 UNION ALL SELECT event_id, 'memory', CASE WHEN k * 12 > 500 THEN 'error' ELSE 'warn' END FROM calls WHERE k % 5 = 0 AND k * 12 > 100""")
def stream_alerts(spark, sf):
    k = F.col("k")
    done = replay(spark, sf).select(
        "event_id", F.when(k % 5 == 0, "extraction_job").otherwise("other").alias("op"), (F.col("latency") * 4).alias("duration"), (k * 12 * 1048576).alias("memory")
    )
    folder = J.work_folder(spark, "alerts")
    q = J.alert_stream(done, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/ckpt")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "type", "level")


@query("incremental_corpus", """SELECT doc_id, 'changed' AS status FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 3 UNION ALL SELECT doc_id, 'kept' FROM documents WHERE NOT (doc_id % 7 = 0 OR doc_id % 11 = 3)""")
def incremental_corpus(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.col("text").alias("content"))
    old = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    manifest = d.filter("doc_id % 11 <> 3").select("path", "doc_id", F.sha2(old, 256).alias("sha"))
    changed, kept = J.incremental_corpus(d, manifest)
    return changed.select("doc_id", F.lit("changed").alias("status")).unionByName(kept.select("doc_id", F.lit("kept").alias("status")))


@query("stream_corpus", """SELECT doc_id, 'added' AS status, 0 AS version FROM documents WHERE doc_id % 5 > 0 AND text IS NOT NULL
 UNION ALL SELECT doc_id, 'added', 1 FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL
 UNION ALL SELECT doc_id, 'changed', 1 FROM documents WHERE doc_id % 5 > 0 AND doc_id % 7 = 0 AND text IS NOT NULL
 UNION ALL SELECT doc_id, 'deleted', 2 FROM documents WHERE doc_id % 11 = 3 AND text IS NOT NULL
 UNION ALL SELECT doc_id, 'changed', 2 FROM documents WHERE doc_id % 11 <> 3 AND doc_id % 5 > 0 AND doc_id % 7 = 0 AND doc_id % 2 = 0 AND text IS NOT NULL""")
def stream_corpus(spark, sf):
    """Three rounds of the documents as files: all but some; the rest and changes; deletions and changes taken back."""
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    i, changed = F.col("doc_id"), F.concat("text", F.lit("!"))
    rounds = [
        d.filter(i % 5 > 0).withColumn("content", F.col("text")),
        d.withColumn("content", F.when((i % 5 > 0) & (i % 7 == 0), changed).otherwise(F.col("text"))),
        d.filter((i % 2 == 0) | (i % 11 == 3)).withColumn("content", F.when(i % 11 == 3, None).otherwise(F.col("text"))),
    ]
    source, folder = J.work_folder(spark, "corpus-files"), J.work_folder(spark, "corpus")
    schema = "path string, content string, seq int"
    for n, rows in enumerate(rounds):  # the files of a round come before the next round is merged
        rows.select("path", "content", F.lit(n).alias("seq")).write.mode("append").parquet(source)
        live = spark.readStream.schema(schema).parquet(source)
        J.corpus_stream(live, f"{folder}/manifest", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return J.manifest_versions(spark, f"{folder}/manifest").select(F.col("path").cast("bigint").alias("doc_id"), "status", "version")


@query("stream_rollbacks", f"""WITH {CALLS} SELECT op, epoch_us(min(ts)) AS first_us, 1 AS calls FROM calls WHERE NOT ok GROUP BY op""")
def stream_rollbacks(spark, sf):
    """Failed calls as rollback decisions; the handler's own table tells how often each operation was handed over."""
    folder = J.work_folder(spark, "rollbacks")
    decisions = replay(spark, sf).select("op", "ts", F.when(F.col("ok"), "increase").otherwise("rollback").alias("action"))
    q = J.rollback_stream(decisions, lambda df, n: df.write.mode("append").parquet(f"{folder}/handled"), f"{folder}/ledger", f"{folder}/ckpt")
    q.trigger(availableNow=True).start().awaitTermination()
    handled = spark.read.parquet(f"{folder}/handled")
    return handled.groupBy("op").agg(F.unix_micros(F.min("ts")).alias("first_us"), F.count(F.lit(1)).cast("int").alias("calls"))
