"""Structured Streaming forms of the event operators; each has a batch twin with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vistagrid.operators import analytics as an


def read_topic(spark: SparkSession, schema: StructType | str, path: str | None = None, kafka: dict[str, str] | None = None) -> DataFrame:
    """JSON events from a folder of text files, or from Kafka when options are given; columns value and the parsed fields."""
    if kafka is not None:
        raw = spark.readStream.format("kafka").options(**kafka).load().selectExpr("CAST(value AS STRING) AS value")
    else:
        raw = spark.readStream.text(path)
    return raw.withColumn("e", F.from_json("value", schema)).select("value", "e.*")


def write_topic(events: DataFrame, checkpoint: str, key: str | None = None, path: str | None = None, kafka: dict[str, str] | None = None) -> StreamingQuery:
    """Events as JSON text to a folder of text files, or to Kafka when options are given; all rows that are there, then it stops."""
    rows = events.select(*([F.col(key).cast("string").alias("key")] if key and kafka is not None else []), F.to_json(F.struct("*")).alias("value"))
    out = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if kafka is not None:
        return out.format("kafka").options(**kafka).start()
    return out.format("text").option("path", path).start()


def split_malformed(events: DataFrame, required: list[str], carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good events, and dead letters (value, reason and the columns `carry`): text that does not parse or lacks a required field."""
    absent = F.lit(None).cast("string")
    for name in reversed(required):
        absent = F.when(F.col(name).isNull(), F.lit(f"missing {name}")).otherwise(absent)
    reason = F.when(F.try_parse_json("value").isNull(), "not json").otherwise(absent)
    tagged = events.withColumn("reason", reason)
    carry = carry or []
    return tagged.where("reason IS NULL").drop("reason", "value"), tagged.where("reason IS NOT NULL").select(*carry, "value", "reason")


def dedup_events(events: DataFrame, delay: str, at: str = "at") -> DataFrame:
    """First copy of each event id; ids are remembered for `delay`, which has no default. `dedup_against_ledger` never forgets."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["event_id"])


def dedup_against_ledger(events: DataFrame, ledger: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """First copy of each event id ever: every micro-batch is compared with the ids of earlier ones, kept as a Parquet ledger.

    A batch's ids are written under its own number before the sink runs, and a replayed batch leaves out its own ids, so
    a replay after a failure hands over the same events again.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = dedup_events_batch(batch)
        first.select("event_id").write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        earlier = spark.read.schema("event_id bigint, batch bigint").option("basePath", ledger).parquet(ledger).where(F.col("batch") < number)
        sink(first.join(earlier.select("event_id"), "event_id", "left_anti"), number)

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_events_batch(events: DataFrame) -> DataFrame:
    rest = [c for c in events.columns if c != "event_id"]
    return events.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct("ts_us")).alias("r")).select("event_id", "r.*")


def debounce_tiles(events: DataFrame, seconds: int, at: str = "at", delay: str | None = None) -> DataFrame:
    """One row per burst of a cell: it is due once no event arrived for `seconds`. Works on streams and on tables.

    On a stream `delay` says how late an event may come and still join its burst; later ones are lost, so it has no
    default there. Without late-data rule use `debounce_by_clock`.
    """
    if events.isStreaming and delay is None:
        raise ValueError("a stream needs a delay")
    src = events.withWatermark(at, delay) if events.isStreaming else events
    w = F.session_window(at, f"{seconds} seconds")
    return src.groupBy("cell", w).agg(F.count("*").alias("events")).select(
        "cell", F.unix_micros("session_window.start").alias("first_us"), F.unix_micros("session_window.end").alias("due_us"), "events")


def debounce_by_clock(pending: DataFrame, now_us: int, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(ready, waiting) rows of a pending table (cell, ts_us): a cell is ready once its newest event is `seconds` old by the clock.

    No event is ever late: what comes after a release simply starts the cell's next burst.
    """
    newest = pending.groupBy("cell").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("events"))
    due = newest.withColumn("due_us", F.col("last_us") + seconds * 1_000_000)
    ready = due.where(F.col("due_us") <= now_us).select("cell", "first_us", "due_us", "events")
    return ready, pending.join(due.where(F.col("due_us") > now_us).select("cell"), "cell", "left_semi")


def latest_lifecycle(events: DataFrame) -> DataFrame:
    """Highest revision per job; stale and repeated revisions change nothing. Update mode on streams."""
    order = F.struct("state_rev", "option_rev", (-F.col("event_id")).alias("neg"))
    return events.groupBy("job_id").agg(F.max_by(F.struct("state_rev", "option_rev", "status"), order).alias("s")).select("job_id", "s.*")


def rollup_stream(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Daily roll-up rows of each micro-batch, handed to `sink` for an additive merge; replays carry the same batch id."""
    return events.writeStream.foreachBatch(lambda df, batch: sink(an.daily_rollup(df), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_tiles(ready: DataFrame, recompute: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Recomputes the ready cells of each micro-batch; a failure leaves the batch to be replayed."""
    return ready.writeStream.foreachBatch(lambda df, batch: sink(recompute(df.select("cell").distinct()), batch)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_tiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change feed of scores: inserted, updated and removed tiles."""
    a, b = before.select("cell", F.col("scenic_score").alias("old_score")), after.select("cell", F.col("scenic_score").alias("new_score"))
    return a.join(b, "cell", "full").where(~F.col("old_score").eqNullSafe(F.col("new_score")))


def expired_jobs(jobs: DataFrame, now_us: int, cutoff_us: int) -> DataFrame:
    """Active jobs whose lease is over; jobs without a lease count by their start, against the earlier `cutoff_us`."""
    active = F.col("status").isin("QUEUED", "PROCESSING", "PRIMARY_READY")
    return jobs.where(active & ((F.col("lease_us") < now_us) | (F.col("lease_us").isNull() & (F.col("started_us") < cutoff_us))))


def due_dispatches(jobs: DataFrame, now_us: int, limit: int) -> DataFrame:
    """Unsent dispatches that are due, unleased and of a queued or primary-ready job, oldest first."""
    free = F.col("dispatch_lease_us").isNull() | (F.col("dispatch_lease_us") <= now_us)
    due = jobs.where(F.col("sent_us").isNull() & (F.col("available_us") <= now_us) & F.col("status").isin("QUEUED", "PRIMARY_READY") & free)
    return due.orderBy("submitted_us", "job_id").limit(limit)


def retry_delay(attempts, base_ms: int = 500, max_ms: int = 60000) -> Column:
    return F.least(F.lit(max_ms), F.lit(base_ms) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(F.lit(30), F.col(attempts) - 1)))).cast("bigint")


def queue_latency(jobs: DataFrame) -> DataFrame:
    """Milliseconds from submission to start and from start to the first route and to completion."""
    def ms(a, b):
        return F.greatest(F.lit(0.0), (F.col(a) - F.col(b)) / 1000.0)

    long = jobs.select("job_id", ms("started_us", "submitted_us").alias("submit_to_start"), F.when(F.col("primary_us").isNotNull(), ms("primary_us", "started_us")).alias("start_to_primary"),
                       F.when(F.col("completed_us").isNotNull(), ms("completed_us", "started_us")).alias("start_to_complete"))
    long = long.unpivot(["job_id"], ["submit_to_start", "start_to_primary", "start_to_complete"], "stage", "ms").where("ms IS NOT NULL")
    return long.groupBy("stage").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms")).join(an.exact_percentile(long, ["stage"], "ms", 0.95, "p95_ms"), "stage")
