"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.operators import analytics as an
from vistagrid.operators import lifecycle as lc
from vistagrid.plans.registry import oracle, query
from vistagrid.plans.analytics_plans import CALIBRATION_ORACLE, ROLLUP_ORACLE, rated
from vistagrid.plans.option_plans import LATEST
from vistagrid.sources.fixtures import domain
from vistagrid.streaming import keyed
from vistagrid.streaming import streams as st

NOW = "(SELECT max(submitted_us) FROM jobs)"


@query("first_events", oracle(["traffic"], "SELECT event_id, cell, ts_us FROM traffic"))
def first_events(spark, sf):
    t = domain(spark, sf, "traffic").select("event_id", "cell", "ts_us")
    return st.dedup_events_batch(t.unionByName(t.withColumn("ts_us", F.col("ts_us") + 5)))


@query("debounced_tiles", oracle(["traffic"], """SELECT cell, min(ts_us) AS first_us, max(ts_us) + 7200000000 AS due_us, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY ts_us, event_id) AS burst FROM (
    SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY cell ORDER BY ts_us, event_id) < 7200000000 THEN 0 ELSE 1 END AS new FROM traffic)) GROUP BY cell, burst"""))
def debounced_tiles(spark, sf):
    return st.debounce_tiles(domain(spark, sf, "traffic").withColumn("at", F.timestamp_micros("ts_us")), 7200)


@query("changed_tiles", oracle(["tiles"], """SELECT cell, CASE WHEN tile_key % 7 <> 0 THEN scenic_score END AS old_score, CASE WHEN tile_key % 11 <> 0 THEN CASE WHEN tile_key % 3 = 0 THEN scenic_score / 2 ELSE scenic_score END END AS new_score FROM tiles
    WHERE (CASE WHEN tile_key % 7 <> 0 THEN scenic_score END) IS DISTINCT FROM (CASE WHEN tile_key % 11 <> 0 THEN CASE WHEN tile_key % 3 = 0 THEN scenic_score / 2 ELSE scenic_score END END)""", "old_score new_score"))
def changed_tiles(spark, sf):
    t = domain(spark, sf, "tiles").select("cell", "tile_key", "scenic_score")
    after = t.where("tile_key % 11 <> 0").withColumn("scenic_score", F.when(F.col("tile_key") % 3 == 0, F.col("scenic_score") / 2).otherwise(F.col("scenic_score")))
    return st.changed_tiles(t.where("tile_key % 7 <> 0"), after)


@query("latest_lifecycle", oracle(["lifecycle"], f"SELECT job_id, state_rev, option_rev, status FROM ({LATEST})"))
def latest_lifecycle(spark, sf):
    return st.latest_lifecycle(domain(spark, sf, "lifecycle"))


@query("rollup_by_day", ROLLUP_ORACLE)
def rollup_by_day(spark, sf):
    return an.daily_rollup(domain(spark, sf, "analytics_events"))


NOW_US = 820454400000000 + 86400_000_000 * 400


@query("expired_jobs", oracle(["jobs"], f"SELECT job_id, status FROM jobs WHERE status IN ('QUEUED', 'PROCESSING', 'PRIMARY_READY') AND (lease_us < {NOW_US} OR (lease_us IS NULL AND started_us < {NOW_US} - 600000000))"))
def expired_jobs(spark, sf):
    return st.expired_jobs(domain(spark, sf, "jobs"), NOW_US, NOW_US - 600_000_000).select("job_id", "status")


@query("due_dispatches", oracle(["jobs"], f"SELECT job_id, least(60000, 500 * 2 ** greatest(0, attempts - 1))::BIGINT AS delay_ms FROM jobs WHERE sent_us IS NULL AND available_us <= {NOW_US} AND status IN ('QUEUED', 'PRIMARY_READY') AND (dispatch_lease_us IS NULL OR dispatch_lease_us <= {NOW_US}) ORDER BY submitted_us, job_id LIMIT 200"))
def due_dispatches(spark, sf):
    return st.due_dispatches(domain(spark, sf, "jobs"), NOW_US, 200).select("job_id", st.retry_delay("attempts").alias("delay_ms"))


@query("queue_latency", oracle(["jobs"], " UNION ALL ".join(f"SELECT '{n}' AS stage, count(*) AS n, avg(ms) AS mean_ms, quantile_cont(ms, 0.95) AS p95_ms FROM (SELECT greatest(0e0, ({a} - {b}) / 1000e0) AS ms FROM jobs WHERE {a} IS NOT NULL)"
    for n, a, b in (("submit_to_start", "started_us", "submitted_us"), ("start_to_primary", "primary_us", "started_us"), ("start_to_complete", "completed_us", "started_us"))), "mean_ms p95_ms"))
def queue_latency(spark, sf):
    return st.queue_latency(domain(spark, sf, "jobs"))


@query("malformed_events", oracle(["requests"], """SELECT request_id, CASE WHEN json_valid(preferences_json) THEN 'missing Water' ELSE 'not json' END AS reason FROM requests WHERE preferences_json IS NOT NULL AND (NOT json_valid(preferences_json) OR json_extract(preferences_json, '$.Water') IS NULL)"""))
def malformed_events(spark, sf):
    r = domain(spark, sf, "requests").where("preferences_json IS NOT NULL").select("request_id", F.col("preferences_json").alias("value"))
    parsed = r.withColumn("e", F.from_json("value", "Water double")).select("request_id", "value", "e.*")
    return st.split_malformed(parsed, ["Water"], carry=["request_id"])[1].select("request_id", "reason")


_ACT = """CASE WHEN kind = 'claim' AND status = 'QUEUED' THEN 'start' WHEN kind = 'claim' AND status = 'PRIMARY_READY' AND NOT leased THEN 'lease'
    WHEN NOT leased OR status NOT IN ('PROCESSING', 'PRIMARY_READY') THEN 'none' WHEN kind = 'primary' AND status = 'PROCESSING' THEN 'ready'
    WHEN kind = 'release' AND status = 'PRIMARY_READY' THEN 'free' WHEN kind = 'complete' AND has_primary THEN 'done'
    WHEN kind = 'permanent_failure' OR (kind IN ('transient_failure', 'expire') AND retries >= most) THEN CASE WHEN has_primary THEN 'done' ELSE 'fail' END
    WHEN kind IN ('transient_failure', 'expire') THEN CASE WHEN has_primary THEN 'again' ELSE 'requeue' END ELSE 'none' END"""
_FOLD = f"""ordered AS (SELECT e.job_id, lower(trim(kind)) AS kind, row_number() OVER (PARTITION BY e.job_id ORDER BY at_us, event_id) AS pos
    FROM job_events e JOIN job_limits USING (job_id) WHERE lower(trim(kind)) IN ({', '.join(repr(k) for k in lc.KINDS)})),
  fold AS (SELECT job_id, 0::BIGINT AS pos, 'QUEUED' AS status, false AS leased, false AS has_primary, 0::BIGINT AS retries, 0::BIGINT AS state_rev, 0::BIGINT AS applied,
      greatest(0, least(3, coalesce(max_retries, 0))) AS most FROM job_limits
    UNION ALL SELECT job_id, pos, CASE act WHEN 'start' THEN 'PROCESSING' WHEN 'ready' THEN 'PRIMARY_READY' WHEN 'done' THEN 'COMPLETED' WHEN 'fail' THEN 'FAILED' WHEN 'requeue' THEN 'QUEUED' ELSE status END,
      CASE WHEN act IN ('start', 'lease') THEN true WHEN act IN ('free', 'done', 'fail', 'again', 'requeue') THEN false ELSE leased END, has_primary OR act = 'ready',
      retries + CASE WHEN act IN ('again', 'requeue') THEN 1 ELSE 0 END, state_rev + CASE WHEN act IN ('none', 'lease', 'free') THEN 0 ELSE 1 END, applied + CASE WHEN act = 'none' THEN 0 ELSE 1 END, most
    FROM (SELECT f.job_id, o.pos, f.status, f.leased, f.has_primary, f.retries, f.state_rev, f.applied, f.most, {_ACT} AS act
      FROM fold f JOIN ordered o ON o.job_id = f.job_id AND o.pos = f.pos + 1) s)"""


@query("folded_lifecycle", oracle(["job_events", "job_limits"], """SELECT job_id, arg_max(status, pos) AS status, arg_max(leased, pos) AS leased, arg_max(has_primary, pos) AS has_primary,
    arg_max(retries, pos) AS retries, max(state_rev) AS state_rev, max(applied) AS applied, max(pos) AS events FROM fold GROUP BY 1""", extra=_FOLD, recursive=True))
def folded_lifecycle(spark, sf):
    events = domain(spark, sf, "job_events")
    return lc.fold_lifecycle(events.unionByName(events.where("event_id % 5 = 0").withColumn("at_us", F.col("at_us") + 9)), domain(spark, sf, "job_limits"))


@query("bucketed_calibration", CALIBRATION_ORACLE)
def bucketed_calibration(spark, sf):
    return keyed.calibration_from_buckets(keyed.calibration_buckets(rated(spark, sf).withColumn("at", F.timestamp_micros("rated_us"))))
