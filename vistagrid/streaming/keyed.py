"""Streaming folds with keyed state and event-time timers; each equals its batch form for any split into micro-batches.

Events wait in the state of their key until the watermark has passed them, so they are applied in the order of their time
whatever the order of arrival; what is kept afterwards is a few numbers. Events that come after the watermark has passed
their time are dropped, so `delay` says how late an event may be and has no default. The state store must be RocksDB, see
`STATE_STORE`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vistagrid.functions import catalog
from vistagrid.operators import analytics as an
from vistagrid.operators.lifecycle import KINDS, Table, kind_code

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
JOB_STATES = "job_id bigint, status string, leased boolean, has_primary boolean, retries bigint, state_rev bigint, applied bigint, events bigint"
COMPONENTS = list(catalog.COMPONENTS)


class JobFold(StatefulProcessor):
    """One job: its state number and counters, and the events that the watermark has not passed yet, by event id."""

    def __init__(self, attempts: int):
        self.table = Table(attempts - 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states, self.moves = self.table.states, self.table.moves
        self.now = handle.getValueState("now", "start int, state int, rev bigint, applied bigint, n bigint")
        self.waiting = handle.getMapState("waiting", "event_id bigint", "at_us bigint, code int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            if not self.now.exists():
                most = batch["max_retries"].iloc[0]
                start = 0 if pd.isna(most) else int(max(0, min(self.table.budget, most)))
                self.now.update((start, start, 0, 0, 0))
            for event, at, code in zip(batch["event_id"], batch["at_us"], batch["code"]):
                # A replay of an event that still waits changes nothing; one that was applied is behind the watermark.
                if at // 1000 > passed and not (self.waiting.containsKey((int(event),)) and self.waiting.getValue((int(event),))[0] <= at):
                    self.waiting.updateValue((int(event),), (int(at), int(code)))
                    self.handle.registerTimer(int(at // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((at, event[0], code) for event, (at, code) in self.waiting.iterator() if at // 1000 <= passed)
        if not due:
            return
        start, state, rev, applied, n = self.now.get()
        for _, event, code in due:
            to, added = self.moves[code][state]
            rev, applied, n, state = rev + added, applied + int(to != state or added > 0), n + 1, to
            self.waiting.removeKey((event,))
        self.now.update((start, state, rev, applied, n))
        s = self.states[state]
        yield pd.DataFrame({"job_id": [key[0]], "status": [s.status], "leased": [s.leased], "has_primary": [s.primary], "retries": [start - s.left], "state_rev": [rev], "applied": [applied], "events": [n]})

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, jobs: DataFrame, delay: str, attempts: int = 4) -> DataFrame:
    """New state of a job whenever the watermark passes events of it; update mode. `events` as in `fold_lifecycle`, `jobs` a table."""
    timed = events.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", delay)
    known = timed.join(jobs.select("job_id", "max_retries"), "job_id").withColumn("code", kind_code()).where("code IS NOT NULL")
    return known.select("job_id", "max_retries", "event_id", "at_us", F.col("code").cast("int").alias("code"), "at").groupBy("job_id").transformWithStateInPandas(
        JobFold(attempts), JOB_STATES, outputMode="Update", timeMode="EventTime")


class Chain(StatefulProcessor):
    """One vibe: the clamped shifts of all its closed buckets, composed, per component (a, lo, hi), and the ratings behind them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint, " + ", ".join(f"{k}_{f} double" for k in COMPONENTS for f in ("a", "lo", "hi")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = list(self.total.get()) if self.total.exists() else [0, *[0.0, float("-inf"), float("inf")] * len(COMPONENTS)]
        # Buckets close in the order of time, so those of a micro-batch follow those of all earlier ones.
        for row in pd.concat(list(rows)).sort_values("bucket_us").itertuples():
            total[0] += int(row.n)
            for i, k in enumerate(COMPONENTS):
                a, lo, hi = (getattr(row, f"{k}_{f}") for f in ("a", "lo", "hi"))
                x, low, high = total[1 + 3 * i:4 + 3 * i]
                total[1 + 3 * i:4 + 3 * i] = [x + a, min(hi, max(lo, low + a)), min(hi, max(lo, high + a))]
        self.total.update(tuple(total))
        made = {f"m_{k}": [min(total[3 + 3 * i], max(total[2 + 3 * i], total[1 + 3 * i] + 1.0))] for i, k in enumerate(COMPONENTS)}
        yield pd.DataFrame({"vibe": [key[0]], **made, "samples": [total[0]]})

    def close(self) -> None:
        pass


def calibration_buckets(deltas: DataFrame, seconds: int = 3600) -> DataFrame:
    """Composed shifts per (vibe, time bucket): n and (a, lo, hi) of every component. Works on streams and on tables.

    Ratings of a vibe are dealt over its buckets, so a vibe with most ratings is folded in as many places as it has hours.
    """
    maps = [F.struct(F.col(f"d_{k}").alias("a"), F.lit(an.LOW).alias("lo"), F.lit(an.HIGH).alias("hi")).alias(k) for k in COMPONENTS]
    grouped = deltas.groupBy("vibe", F.window("at", f"{seconds} seconds").alias("w")).agg(F.sort_array(F.collect_list(F.struct("rated_us", "rating_id", *maps))).alias("items"))
    composed = grouped.select("vibe", F.unix_micros("w.start").alias("bucket_us"), F.size("items").cast("bigint").alias("n"), *[an.compose_shifts(F.col("items"), k).alias(k) for k in COMPONENTS])
    return composed.select("vibe", "bucket_us", "n", *[F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in COMPONENTS for f in ("a", "lo", "hi")])


def calibration_stream(ratings: DataFrame, delay: str, seconds: int = 3600) -> DataFrame:
    """Multipliers of a vibe whenever the watermark closes buckets of it; append mode, the newest row of a vibe counts.

    `ratings` as for `weight_calibration`, with one row per rating id; replayed ids within `delay` are dropped.
    """
    deltas = an.calibration_deltas(ratings).withColumn("at", F.timestamp_micros("rated_us")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["rating_id"])
    schema = "vibe string, " + ", ".join(f"m_{k} double" for k in COMPONENTS) + ", samples bigint"
    return calibration_buckets(deltas, seconds).groupBy("vibe").transformWithStateInPandas(Chain(), schema, outputMode="Append", timeMode="None")


def calibration_from_buckets(buckets: DataFrame) -> DataFrame:
    """Batch form of `Chain` over a bucket table: a vibe has one row per bucket of time, however many ratings it has."""
    one = lambda k: F.struct(*[F.col(f"{k}_{f}").alias(f) for f in ("a", "lo", "hi")]).alias(k)
    items = buckets.groupBy("vibe").agg(F.sort_array(F.collect_list(F.struct("bucket_us", *map(one, COMPONENTS)))).alias("items"), F.sum("n").alias("samples"))
    whole = items.select("vibe", *[an.compose_shifts(F.col("items"), k).alias(k) for k in COMPONENTS], "samples")
    return whole.select("vibe", *[F.least(F.col(f"{k}.hi"), F.greatest(F.col(f"{k}.lo"), F.col(f"{k}.a") + 1.0)).alias(f"m_{k}") for k in COMPONENTS], "samples")


def latest_multipliers(rows: DataFrame) -> DataFrame:
    """Newest row of each vibe: the one with the most samples."""
    return rows.groupBy("vibe").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "vibe"]), "samples").alias("r")).select("vibe", "r.*")
