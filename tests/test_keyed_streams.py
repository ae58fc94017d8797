"""Keyed streaming folds against their batch forms: any split, replays, late events."""

import random

import pytest
from pyspark.sql import functions as F

from vistagrid.functions import catalog
from vistagrid.operators import analytics as an
from vistagrid.operators.lifecycle import KINDS, State, Table, after, fold_lifecycle
from vistagrid.streaming import keyed

EVENTS = "job_id bigint, event_id bigint, at_us bigint, kind string"
START = 1_700_000_000_000_000
# A last event far ahead moves the watermark past everything else; its own job is left out of the comparison.
END = START + 10**12


@pytest.fixture
def rocks(spark):
    for k, v in keyed.STATE_STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k in keyed.STATE_STORE:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def streamed(spark, tmp_path, batches, schema, build, mode):
    """Runs `build` over a stream that reads one batch at a time and returns all rows it gave."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = []
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        query = build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def log(seed, jobs=3, n=12):
    rng = random.Random(seed)
    kinds = [*KINDS, "claim", "claim", "primary", "release", "noise"]
    return [(rng.randrange(jobs), k, START + k * 1_000_000 + rng.randrange(900_000), rng.choice(kinds)) for k in range(jobs * n)]


def test_state_table_is_closed():
    table = Table(3)
    assert len(table.states) == len(set(table.states)) and State(left=3) in table.states
    assert all(after(s, k)[0] in table.states for s in table.states for k in KINDS)


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_do_not_matter(spark, seed):
    events = spark.createDataFrame(log(seed, n=30), EVENTS)
    jobs = spark.createDataFrame([(0, 3), (1, None), (2, 9), (7, 1)], "job_id bigint, max_retries int")
    whole = sorted(map(tuple, fold_lifecycle(events, jobs).collect()))
    assert whole == sorted(map(tuple, fold_lifecycle(events, jobs, span=3, levels=4).collect()))
    assert whole[-1] == (7, "QUEUED", False, False, 0, 0, 0, 0)
    # The plain walk over the log of each job.
    for job, limit in ((0, 3), (1, 0), (2, 3)):
        state, rev = State(left=limit), 0
        for _, _, _, kind in sorted((r for r in log(seed, n=30) if r[0] == job), key=lambda r: (r[2], r[1])):
            if kind in KINDS:
                state, added = after(state, kind)
                rev += added
        row = next(r for r in whole if r[0] == job)
        assert row[1:6] == (state.status, state.leased, state.primary, limit - state.left, rev)


def test_lifecycle_stream_equals_batch(rocks, tmp_path):
    rows = log(5)
    jobs = rocks.createDataFrame([(0, 3), (1, 1), (2, 2), (9, 0)], "job_id bigint, max_retries int")
    # Neighbours swap places between batches, and some events come twice.
    mixed = sorted(rows, key=lambda r: r[1] ^ 3)
    batches = [mixed[:14], mixed[14:25] + mixed[5:9], mixed[25:] + mixed[20:22], [(9, 10**6, END, "claim")], [(9, 10**6 + 1, END + 1, "claim")]]
    out = streamed(rocks, tmp_path, batches, EVENTS, lambda s: keyed.lifecycle_stream(s, jobs, "20 seconds"), "update")
    last = {}
    for r in out:
        last[r.job_id] = tuple(r)
    want = {r.job_id: tuple(r) for r in fold_lifecycle(rocks.createDataFrame(rows, EVENTS), jobs).collect() if r.job_id != 9}
    assert {k: v for k, v in last.items() if k != 9} == want


def test_late_events_are_dropped(rocks, tmp_path):
    jobs = rocks.createDataFrame([(1, 2), (9, 0)], "job_id bigint, max_retries int")
    batches = [[(1, 1, START, "claim"), (1, 2, START + 1000, "primary")], [(9, 3, START + 10**9, "claim")], [(9, 4, START + 2 * 10**9, "claim")],
               [(1, 5, START + 500, "permanent_failure")], [(9, 6, END, "claim")]]
    out = streamed(rocks, tmp_path, batches, EVENTS, lambda s: keyed.lifecycle_stream(s, jobs, "1 second"), "update")
    assert [r.status for r in out if r.job_id == 1][-1] == "PRIMARY_READY"


@pytest.mark.parametrize("cuts", [(40,), (11, 12, 30)])
def test_calibration_stream_equals_batch(rocks, tmp_path, cuts):
    rng = random.Random(3)
    names = list(catalog.COMPONENTS)
    schema = "rating_id bigint, rated_us bigint, rating int, vibe string, tags array<string>, " + ", ".join(f"{k} double" for k in names)
    rows = [(k, START + k * 600_000_000, rng.randint(1, 5), rng.choice(["coastal", "quiet"]), ["loved_water"] if k % 3 == 0 else None, *[rng.random() for _ in names]) for k in range(60)]
    last = (10**6, END, 3, "end", None, *[0.0] * len(names))
    mixed = sorted(rows, key=lambda r: r[0] ^ 1)
    batches = [mixed[a:b] for a, b in zip((0, *cuts), (*cuts, 60))] + [[mixed[-1], last], [(10**6 + 1, END + 10**10, 3, "end", None, *[0.0] * len(names))]]
    out = streamed(rocks, tmp_path, batches, schema, lambda s: keyed.calibration_stream(s, "3 hours"), "append")
    got = {r.vibe: r for r in keyed.latest_multipliers(rocks.createDataFrame(out)).collect() if r.vibe != "end"}
    want = an.weight_calibration(an.calibration_deltas(rocks.createDataFrame(rows, schema))).collect()
    assert {r.vibe for r in want} == set(got)
    for r in want:
        assert got[r.vibe].samples == r.samples
        assert all(abs(got[r.vibe][f"m_{k}"] - r[f"m_{k}"]) < 1e-9 for k in names)


def test_buckets_do_not_matter(spark):
    names = list(catalog.COMPONENTS)
    schema = "rating_id bigint, rated_us bigint, rating int, vibe string, tags array<string>, " + ", ".join(f"{k} double" for k in names)
    rng = random.Random(9)
    rows = spark.createDataFrame([(k, START + rng.randrange(10**11), rng.randint(1, 5), "coastal", None, *[rng.random() for _ in names]) for k in range(80)], schema)
    deltas = an.calibration_deltas(rows).withColumn("at", F.timestamp_micros("rated_us"))
    want = an.weight_calibration(deltas).first()
    for seconds in (60, 7200, 10**7):
        got = keyed.calibration_from_buckets(keyed.calibration_buckets(deltas, seconds)).first()
        assert got.samples == 80 and all(abs(got[f"m_{k}"] - want[f"m_{k}"]) < 1e-9 for k in names)
