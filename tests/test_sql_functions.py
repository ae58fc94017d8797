"""Every function called from SQL equals its Column, and no plan holds a UDF node."""

import re

import pytest
from pyspark.sql import functions as F

from vistagrid.functions import cells, geo, sql, text
from vistagrid.functions.cells import HexGrid

GRID = HexGrid(lon0=-80.0, lat0=43.0)
VALUES = {"DOUBLE": ["0.3D", "43.7D", "-79.4D", "181.5D", "0.62D", "1.7D", "CAST(NULL AS DOUBLE)"], "INT": ["4", "37", "-2", "CAST(NULL AS INT)"],
          "STRING": ["'3:5:7'", "' Sunday Drive '", "'Most-Scenic'", "'[\"coastal\",\"Twisty\",null,\"x\"]'", "''", "CAST(NULL AS STRING)"]}
def written():
    return {
    "k_ring": ("'3:-5:7', 2", cells.k_ring(F.lit("3:-5:7"), F.lit(2))), "cell_children": ("'3:-5:7'", cells.cell_children(F.lit("3:-5:7"))),
    "destination": ("43D, -79D, 33D, 1500D", geo.destination(F.lit(43.0), F.lit(-79.0), F.lit(33.0), F.lit(1500.0))), "bbox_exact": ("43D, -79D, 900D", geo.bbox_exact(F.lit(43.0), F.lit(-79.0), F.lit(900.0))),
    "parse_vibes": ("'[\"coastal\",\"Twisty\",null,\"x\",\"winding\"]'", text.parse_vibes(F.lit('["coastal","Twisty",null,"x","winding"]'))), "resolve_vibes": ("'oops', ' Quiet'", text.resolve_vibes(F.lit("oops"), F.lit(" Quiet"))),
    "normalize_feedback_tags": ("array('Loved-Water', 'nope', NULL, 'too urban', 'loved water')", text.normalize_feedback_tags(F.array(F.lit("Loved-Water"), F.lit("nope"), F.lit(None), F.lit("too urban"), F.lit("loved water")))),
    "display_list": ("array('coastal', 'Odd One', '')", text.display_list(F.array(F.lit("coastal"), F.lit("Odd One"), F.lit("")))), "tag_set": ("map('bridge', 'yes'), 'bridge'", text.tag_set(F.create_map(F.lit("bridge"), F.lit("yes")), "bridge"))}


@pytest.fixture(scope="module")
def registered(spark):
    return sql.register(spark, GRID)


@pytest.mark.parametrize("name", sorted(sql.columns(GRID)))
def test_rendered_functions(spark, registered, name):
    parameters, fn = sql.columns(GRID)[name]
    rows = spark.sql("SELECT " + ", ".join(f"{VALUES[t][0]} AS {n}" for n, t in parameters))
    for k in range(1, 7):
        rows = rows.unionAll(spark.sql("SELECT " + ", ".join(f"{VALUES[t][(k + i) % len(VALUES[t])]} AS {n}" for i, (n, t) in enumerate(parameters))))
    if name in ("cell_parent", "cell_resolution", "ring_distance"):
        rows = spark.sql("SELECT " + ", ".join(f"'{3 + i}:-5:7' AS {n}" for i, (n, _) in enumerate(parameters)))
    both = rows.select(fn(*[F.col(n) for n, _ in parameters]).alias("a"), F.expr(f"vg_{name}({', '.join(n for n, _ in parameters)})").alias("b"))
    assert all(r.a == r.b or (r.a != r.a and r.b != r.b) for r in both.collect())


def test_written_functions(spark, registered):
    for name, (arguments, column) in written().items():
        row = spark.range(1).select(column.alias("a"), F.expr(f"vg_{name}({arguments})").alias("b")).first()
        assert row.a == row.b, name


def test_paths(spark, registered):
    rows = spark.createDataFrame([([(0.0, 43.0), (0.01, 43.01), (0.03, 43.0)],), ([(0.0, 43.0)],), ([(0.0, 43.0), (0.0, 43.0)],)], "geom array<struct<lon:double,lat:double>>")
    for r in rows.select(geo.path_curvature("geom").alias("a"), F.expr("vg_path_curvature(geom)").alias("b")).collect():
        assert abs(r.a - r.b) < 1e-12


def test_plans_hold_no_udf(spark, registered):
    spark.range(3).selectExpr("CAST(id AS DOUBLE) AS x", "'Sunday Drive' AS v").createOrReplaceTempView("given")
    plan = spark.sql("SELECT vg_haversine_m(x, x, 43D, 7D), vg_cell_of(x, x), vg_parse_vibes(concat('[\"', v, '\"]')) FROM given WHERE vg_normalize_vibe(v) = 'countryside'")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 3 and not re.search("PythonUDF|ScalaUDF|EvalPython|InArrow|InPandas", shown)
