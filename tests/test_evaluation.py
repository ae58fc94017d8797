"""Evaluation: the sink, long geometries, rule order."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vistagrid.operators import evaluation as ev
from vistagrid.plans import evaluation_plans as plans
from vistagrid.sources.eval_sink import write_eval

SF = "/root/testdata/sf0.001"
SCENARIO, OPTION = ["scenario_id", "status", "budget", "flags"], ["profile", "duration_minutes", "final_score", "failed_flags"]


def test_sink_round_trip(spark, tmp_path):
    evaluated = plans.evaluated(spark, SF).repartition(4)
    for _ in range(2):
        write_eval(evaluated, str(tmp_path / "out"), SCENARIO, OPTION)
    rows = {r.scenario_id: r for r in evaluated.collect()}
    back = {r.scenario_id: r for r in spark.read.json(str(tmp_path / "out" / "scenarios")).collect()}
    assert set(back) == set(rows) and all((back[k].flags or []) == rows[k].flags and len(back[k].o) == len(rows[k].o) for k in rows)
    flat = spark.read.option("header", True).csv(str(tmp_path / "out" / "options"))
    got = sorted((int(r.scenario_id), r.option_profile, r.option_final_score and round(float(r.option_final_score), 9), r.flags or "") for r in flat.collect())
    want = sorted((r.scenario_id, o.profile, o.final_score and round(o.final_score, 9), "+".join(r.flags)) for r in rows.values() for o in r.o)
    assert got == want
    assert sorted(p.name for p in Path(tmp_path / "out").iterdir()) == ["options", "scenarios"]


def test_failed_task_leaves_nothing(spark, tmp_path):
    broken = plans.evaluated(spark, SF).repartition(3).withColumn("status", F.when(F.col("scenario_id") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        write_eval(broken, str(tmp_path / "out"), SCENARIO, OPTION)
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_documents_are_json(spark, tmp_path):
    write_eval(plans.evaluated(spark, SF).where("scenario_id = 1"), str(tmp_path / "one"), SCENARIO, OPTION)
    text = "".join(p.read_text() for p in (tmp_path / "one" / "scenarios").iterdir())
    assert json.loads(text)["scenario_id"] == 1


def test_long_paths_are_sampled(spark):
    points = [(43.0 + k * 1e-4, -79.0) for k in range(200)]
    row = spark.createDataFrame([(points,)], "p array<struct<lat:double,lon:double>>").select(ev.sampled_points(F.col("p")).alias("s")).first()
    assert len(row.s) == 60 and row.s[0].lat == points[0][0] and row.s[-1].lat == points[-1][0]
    assert [round((p.lat - 43.0) * 1e4) for p in row.s] == [round(i * 199 / 59) for i in range(60)]


def test_stopped_scenarios_have_one_flag(spark):
    o = plans.options(spark, SF).limit(0).withColumns({f"target_{n}": F.lit(None).cast("double") for n in ("average", "lift", "contribution")})
    s = spark.createDataFrame([(1, "FAILED", "No strong hills", 30, None, ["water"]), (2, "FAILED", "No scenic data found", 30, None, []), (3, None, None, 30, None, []), (4, "COMPLETED", None, 30, 0.1, [])],
                              "scenario_id long, status string, failure_reason string, budget int, min_separation_km double, targets array<string>")
    got = {r.scenario_id: r.flags for r in ev.scenario_flags(s, o, "x").collect()}
    assert got == {1: ["vibe_unavailable"], 2: ["scenic_data_unavailable"], 3: ["job_not_completed"], 4: ["no_route_options"]}
