"""Snapshot store, retention, rule parsing and corpus scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.registry import query, table
from tidewright.sinks import tables as S
from tidewright.sources import files


def captures(spark, sf):
    """Captures in time order: users are queries, sign-ups baseline, the rest candidate."""
    return table(spark, sf, "events").filter("event_type IN ('signup', 'purchase', 'view')").select(
        F.col("user_id").alias("query_id"), F.when(F.col("event_type") == "signup", "baseline").otherwise("transformed").alias("version"),
        "ts", "event_id", F.col("props").alias("payload"),
    )


_STORE = """cap AS (SELECT user_id AS query_id, CASE WHEN event_type = 'signup' THEN 'baseline' ELSE 'transformed' END AS version, ts, event_id, props AS payload FROM events WHERE event_type IN ('signup', 'purchase', 'view')),
 store AS (SELECT query_id, version, max_by(payload, ts) AS payload, max_by(event_id, ts) AS event_id FROM cap GROUP BY 1, 2)"""


@query("upsert_snapshots", f"WITH {_STORE} SELECT query_id, version, event_id, payload FROM store")
def upsert_snapshots(spark, sf):
    return S.latest_per_key(captures(spark, sf), ["query_id", "version"], ["ts", "event_id"]).select("query_id", "version", "event_id", "payload")


@query("stored_snapshot_pairs", f"WITH {_STORE} SELECT query_id, max(CASE WHEN version = 'baseline' THEN payload END) AS baseline, max(CASE WHEN version = 'transformed' THEN payload END) AS transformed FROM store GROUP BY 1")
def stored_snapshot_pairs(spark, sf):
    return S.snapshot_pairs(S.latest_per_key(captures(spark, sf), ["query_id", "version"], ["ts", "event_id"]))


@query("export_pairs", f"""WITH {_STORE}, p AS (SELECT query_id, max(CASE WHEN version = 'baseline' THEN payload END) AS b, max(CASE WHEN version = 'transformed' THEN payload END) AS t FROM store GROUP BY 1)
 SELECT query_id, '{{' || array_to_string(list_filter([CASE WHEN b IS NOT NULL THEN '"baseline":"' || replace(b, '"', '\\"') || '"' END, CASE WHEN t IS NOT NULL THEN '"transformed":"' || replace(t, '"', '\\"') || '"' END], lambda x: x IS NOT NULL), ',') || '}}' AS pair FROM p""")
def export_pairs(spark, sf):
    return S.export_pairs(S.latest_per_key(captures(spark, sf), ["query_id", "version"], ["ts", "event_id"]))


@query("stored_ids", f"WITH {_STORE} SELECT DISTINCT query_id FROM store")
def stored_ids(spark, sf):
    return S.stored_ids(captures(spark, sf))


@query("retention_kept", f"WITH {_STORE} SELECT event_id FROM cap WHERE ts >= TIMESTAMP '2024-01-23 00:00:00'")
def retention_kept(spark, sf):
    return S.apply_retention(captures(spark, sf), F.lit("2024-01-23 00:00:00").cast("timestamp_ntz"))[0].select("event_id")


@query("retention_dropped", f"WITH {_STORE} SELECT count_if(ts < TIMESTAMP '2024-01-23 00:00:00') AS dropped FROM cap")
def retention_dropped(spark, sf):
    return S.apply_retention(captures(spark, sf), F.lit("2024-01-23 00:00:00").cast("timestamp_ntz"))[1]


@query("read_rules", """SELECT DISTINCT 'field-rename' AS type, p_name AS old, 'f' || p_size AS new, CASE WHEN p_type <> 'PROMO' THEN p_type END AS parent FROM part WHERE p_size % 3 = 0""")
def read_rules(spark, sf):
    reason = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Use `f"), F.col("p_size").cast("string"), F.lit("` instead"))).otherwise("no longer needed")
    p = table(spark, sf, "part")
    docs = p.select("p_type", F.to_json(F.create_map("p_type", F.array(F.struct(F.col("p_name").alias("name"), reason.alias("deprecationReason"))))).alias("content"))
    return files.parse_rules(docs, "content", root="PROMO").distinct()
