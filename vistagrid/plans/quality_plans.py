"""Audits, release validation and contract checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vistagrid.functions import catalog, text
from vistagrid.operators import quality as qu
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.session import checkpoint_dir
from vistagrid.sources.fixtures import domain

V37 = catalog.VERSIONS["3.7"]
SIGNALS = ["water_score", "green_score", "darkness_score", "road_stress_score", "viewpoint_score", "bridge_coastal_score"]
AUDIT = " UNION ALL ".join(f"""SELECT '{s}' AS signal, min({s}) AS min_value, avg({s}) AS avg_value, max({s}) AS max_value, stddev_pop({s}) AS stddev_value,
    avg(CASE WHEN abs({s} - 0.5) < 1e-9 THEN 1 ELSE 0 END) AS neutral_share, avg(CASE WHEN {s} > 0 THEN 1 ELSE 0 END) AS non_zero_share FROM tiles""" for s in SIGNALS)
_audit_cols = "min_value avg_value max_value stddev_value neutral_share non_zero_share"


@query("tile_audit", oracle(["tiles"], AUDIT, _audit_cols))
def tile_audit(spark, sf):
    return qu.audit_tiles(domain(spark, sf, "tiles"), SIGNALS)


@query("readiness", oracle(["tiles", "roads", "places", "water", "raster_tiles", "areas", "light_samples"], """SELECT 'darkness' AS "check", CASE WHEN stddev_pop(darkness_score) > 0.01 AND count(*) FILTER (darkness_score = 0.5) / count(*) < 0.9 THEN 'ready' ELSE 'needs data QA' END AS status FROM tiles
    UNION ALL SELECT 'road_stress_score', CASE WHEN stddev_pop(road_stress_score) > 0.01 THEN 'ready' ELSE 'needs data QA' END FROM tiles
    UNION ALL SELECT 'light_samples', CASE WHEN count(*) > 0 THEN 'present' ELSE 'missing' END FROM light_samples UNION ALL SELECT 'road_class', CASE WHEN count(*) > 0 THEN 'candidate' ELSE 'blocked' END FROM roads
    UNION ALL SELECT 'viewpoints', CASE WHEN count(*) FILTER (tags['tourism'] = 'viewpoint' OR tags['natural'] = 'peak') > 0 THEN 'candidate' ELSE 'needs data QA' END FROM places
    UNION ALL SELECT 'water_visibility', CASE WHEN count(*) > 0 THEN 'partial' ELSE 'needs data QA' END FROM water UNION ALL SELECT 'tree_canopy', CASE WHEN count(*) > 0 THEN 'partial' ELSE 'missing' END FROM raster_tiles
    UNION ALL SELECT 'parks', CASE WHEN count(*) > 0 THEN 'ready' ELSE 'missing' END FROM areas
    UNION ALL SELECT 'flat_darkness', 'needs data QA' UNION ALL SELECT 'flat_road_stress_score', 'needs data QA'"""))
def readiness(spark, sf):
    """All sources as they are, and the two tile checks once more over tiles whose signals are constant."""
    sources = [domain(spark, sf, t) for t in ("roads", "places", "water", "raster_tiles", "areas", "light_samples")]
    tiles = domain(spark, sf, "tiles")
    flat = tiles.withColumns({"darkness_score": F.lit(0.5), "road_stress_score": F.lit(0.25)})
    again = qu.readiness_checks(flat, *sources).where(F.col("check").isin("darkness", "road_stress_score"))
    return qu.readiness_checks(tiles, *sources).unionByName(again.withColumn("check", F.concat(F.lit("flat_"), "check")))


@query("road_audit", oracle(["roads"], """SELECT count(*) AS segments, count(road_type) / count(*) AS type_coverage, count(surface) / count(*) AS surface_coverage, count(speed_kmh) / count(*) AS speed_coverage,
    count(*) FILTER (elevation_change <> 0) / count(*) AS elevation_coverage, count(*) FILTER (road_type IN ('motorway', 'trunk', 'primary')) / count(*) AS major_share,
    count(*) FILTER (road_type IN ('residential', 'service', 'living_street')) / count(*) AS local_share, count(DISTINCT cell) AS tiles FROM roads""", "type_coverage surface_coverage speed_coverage elevation_coverage major_share local_share"))
def road_audit(spark, sf):
    return qu.audit_roads(domain(spark, sf, "roads"))


@query("top_road_types", oracle(["roads"], "SELECT coalesce(road_type, 'unknown') AS road_type, count(*) AS n FROM roads GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12"))
def top_road_types(spark, sf):
    return qu.top_road_types(domain(spark, sf, "roads"))


@query("tag_audit", oracle(["places", "hint_lines"], """SELECT 'viewpoint' AS feature, count(*) FILTER (tags['tourism'] = 'viewpoint') AS n FROM places UNION ALL SELECT 'peak', count(*) FILTER (tags['natural'] = 'peak') FROM places
    UNION ALL SELECT 'bridge', count(*) FILTER (tags['bridge'] NOT IN ('', 'no')) FROM hint_lines UNION ALL SELECT 'tunnel', count(*) FILTER (tags['tunnel'] NOT IN ('', 'no')) FROM hint_lines
    UNION ALL SELECT 'waterway', count(*) FILTER (tags['waterway'] IS NOT NULL) FROM hint_lines UNION ALL SELECT 'spring', count(*) FILTER (tags['natural'] = 'spring') FROM places
    UNION ALL SELECT 'tourism', count(*) FILTER (tags['tourism'] IS NOT NULL) FROM places UNION ALL SELECT 'seasonal', count(*) FILTER (tags['seasonal'] NOT IN ('', 'no') OR tags['winter_road'] IS NOT NULL) FROM hint_lines
    UNION ALL SELECT 'coastal_hint', count(*) FILTER (tags['bridge'] NOT IN ('', 'no') OR tags['waterway'] IS NOT NULL OR tags['ford'] IS NOT NULL) FROM hint_lines"""))
def tag_audit(spark, sf):
    return qu.audit_tags(domain(spark, sf, "places"), domain(spark, sf, "hint_lines"))


def broken_release(spark, sf):
    t = domain(spark, sf, "tiles").where("tile_key % 10 <> 0")
    bad = F.when(F.col("tile_key") % 101 == 1, F.lit(float("nan"))).when(F.col("tile_key") % 103 == 1, F.lit(float("inf"))).when(F.col("tile_key") % 107 == 1, 1.5).otherwise(F.col("water_score"))
    return t.withColumns({"water_score": bad, "cell": F.when(F.col("tile_key") % 97 == 1, F.concat("cell", F.lit("x"))).otherwise(F.col("cell"))})


@query("release_validation", oracle(["tiles"], f"""SELECT 'nan_values' AS "check", count(*) FILTER (k % 101 = 1) AS n FROM r UNION ALL SELECT 'infinite_values', count(*) FILTER (k % 101 <> 1 AND k % 103 = 1) FROM r
    UNION ALL SELECT 'out_of_range', count(*) FILTER (k % 101 = 1) + count(*) FILTER (k % 101 <> 1 AND (k % 103 = 1 OR k % 107 = 1)) FROM r UNION ALL SELECT 'wrong_version', count(*) FILTER (coalesce(v, '') <> '{V37}') FROM r
    UNION ALL SELECT 'repeated_keys', 0 UNION ALL SELECT 'missing_keys', (SELECT count(*) FROM tiles) - count(*) FILTER (k % 97 <> 1) FROM r UNION ALL SELECT 'extra_keys', count(*) FILTER (k % 97 = 1) FROM r""",
    extra="r AS (SELECT tile_key AS k, scoring_version AS v FROM tiles WHERE tile_key % 10 <> 0)"))
def release_validation(spark, sf):
    return qu.validate_release(broken_release(spark, sf), domain(spark, sf, "tiles"), V37, ["water_score", "green_score"])


@query("applied_release", oracle(["tiles"], f"SELECT cell, CASE WHEN tile_key % 3 = 0 THEN 0.25e0 ELSE water_score END AS water_score, CASE WHEN tile_key % 3 = 0 THEN '{V37}' ELSE scoring_version END AS scoring_version FROM tiles", "water_score"))
def applied_release(spark, sf):
    t = domain(spark, sf, "tiles")
    r = t.where("tile_key % 3 = 0").select("cell", F.lit(0.25).alias("water_score"), F.lit(None).cast("double").alias("green_score"), F.lit(V37).alias("scoring_version"))
    return qu.apply_release(t, r, ["water_score", "green_score", "scoring_version"]).select("cell", "water_score", "scoring_version")


@query("restored_release", oracle(["tiles"], "SELECT cell, water_score, scoring_version FROM tiles", "water_score"))
def restored_release(spark, sf):
    """A snapshot, a release on top of it, and the tiles after the roll-back."""
    t, columns = domain(spark, sf, "tiles"), ["water_score", "green_score", "scoring_version"]
    path = f"{checkpoint_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    qu.snapshot(t, columns, path)
    r = t.select("cell", F.lit(0.25).alias("water_score"), F.lit(0.75).alias("green_score"), F.lit(V37).alias("scoring_version"))
    return qu.restore(qu.apply_release(t, r, columns), columns, path).select("cell", "water_score", "scoring_version")


# Variants of the tile table, one per verdict: (name, SQL columns version / darkness / density / penalty, allow neutral darkness).
GATES = [("mixed", "scoring_version", "darkness_score", "building_density_score", "urban_penalty_score", False),
         ("flat", f"'{V37}'", "0.5e0", "building_density_score", "urban_penalty_score", False),
         ("neutral_allowed", f"'{V37}'", "0.5e0", "0.25e0", "CASE WHEN tile_key % 3 = 0 THEN 0.25e0 ELSE 0.75e0 END", True),
         ("equal", f"'{V37}'", "(tile_key % 7) / 8e0", "0.25e0", "0.25e0", False),
         ("mostly_equal", f"'{V37}'", "(tile_key % 7) / 8e0", "0.25e0", "CASE WHEN tile_key % 3 = 0 THEN 0.75e0 ELSE 0.25e0 END", False),
         ("fine", f"'{V37}'", "(tile_key % 7) / 8e0", "0.25e0", "CASE WHEN tile_key % 3 = 0 THEN 0.25e0 ELSE 0.75e0 END", False)]
_gate = " UNION ALL ".join(f"""SELECT '{n}' AS variant, count(*) AS tiles, CASE WHEN count(*) <= 0 THEN 'no_tiles' WHEN count(*) FILTER ({v} = '{V37}') <> count(*) THEN 'mixed_versions'
    WHEN NOT {str(ok).lower()} AND (count(*) FILTER ({d} <> 0.5) <= 0 OR coalesce(stddev_pop({d}), 0) <= 0) THEN 'flat_darkness' WHEN count(*) FILTER ({b} = {u}) >= count(*) THEN 'urban_equals_building'
    WHEN count(*) FILTER ({b} = {u}) / count(*) > 0.5 THEN 'warn' ELSE 'pass' END AS verdict FROM tiles""" for n, v, d, b, u, ok in GATES)


@query("darkness_gate", oracle(["tiles"], _gate))
def darkness_gate(spark, sf):
    out = None
    for name, version, darkness, density, penalty, ok in GATES:
        t = domain(spark, sf, "tiles").withColumns({"scoring_version": F.expr(version), "darkness_score": F.expr(darkness.replace("e0", "d")),
                                                    "building_density_score": F.expr(density.replace("e0", "d")), "urban_penalty_score": F.expr(penalty.replace("e0", "d"))})
        row = qu.gate_darkness(t, V37, ok).select(F.lit(name).alias("variant"), "tiles", "verdict")
        out = row if out is None else out.unionByName(row)
    return out


@query("budget_flags", oracle(["candidates"], "SELECT candidate_id, minutes > target_minutes + greatest(5e0, target_minutes * 0.15e0) AS over_budget, minutes < greatest(10e0, target_minutes * 0.55e0) AS under_budget FROM candidates"))
def budget_flags(spark, sf):
    return domain(spark, sf, "candidates").select("candidate_id", *[v.alias(k) for k, v in qu.budget_flags().items()])


_targets = q.values([(v, t, i) for v, p in catalog.VIBE_PROFILES.items() for i, t in enumerate(p[2])], "vibe, target, o")


@query("target_components", oracle(["candidates"], f"""SELECT candidate_id, string_agg(target, '|' ORDER BY p) AS targets FROM (SELECT candidate_id, target, min(pos * 10 + o) AS p FROM (
    SELECT candidate_id, unnest(v) AS vibe, generate_subscripts(v, 1) AS pos FROM (SELECT candidate_id, CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[]) AS v FROM candidates)) JOIN {_targets} USING (vibe) GROUP BY 1, 2) GROUP BY 1"""))
def target_components(spark, sf):
    return domain(spark, sf, "candidates").select("candidate_id", F.array_join(qu.target_components(text.parse_vibes("vibes_json")), "|").alias("targets"))


# Score breakdown of a candidate: metric -> SQL that both engines read; null means that the metric is absent.
_absent = "CASE WHEN candidate_id % {n} = 0 THEN NULL ELSE {v} END"
METRICS = {"repeated_corridor_cell_share": _absent.format(n=11, v="curve_elevation_corridor_share"), "leg_separation_score": "strategy_fit_score",
           "backtracking_penalty": "backtracking_penalty", "corridor_urban_pressure": "corridor_urban_pressure", "urban_penalty": "urban_penalty",
           "edge_urban_pressure": _absent.format(n=3, v="urban_penalty"), "start_end_penalty": _absent.format(n=5, v="strategy_mismatch_penalty"),
           "scenic_moments_score": "open_space_corridor_share", "photo_peak_score": _absent.format(n=7, v="quiet_corridor_share"),
           "water_corridor_share": _absent.format(n=4, v="mean_turn / 2"), "bridge_coastal_score": _absent.format(n=6, v="urban_penalty / 2"),
           "curve_elevation_corridor_share": "curve_elevation_corridor_share", "quiet_corridor_share": "quiet_corridor_share",
           "road_stress_score": _absent.format(n=8, v="strategy_mismatch_penalty"), "tree_canopy_score": _absent.format(n=9, v="open_space_corridor_share")}
AVERAGES = {"water": "strategy_mismatch_penalty / 2", "elevation": _absent.format(n=10, v="backtracking_penalty"), "solitude": "mean_turn / 3"}


def contract_rows(spark, sf):
    c = domain(spark, sf, "candidates").withColumn("vibes", text.parse_vibes("vibes_json"))

    def table(rules):
        entries = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).cast("double").alias("value")) for k, v in rules.items()])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    return qu.contract_flags(c.select("candidate_id", "minutes", F.expr("CASE WHEN candidate_id % 12 = 0 THEN 0 ELSE target_minutes END").alias("target_minutes"), "score", "vibes",
                                      (F.col("km") / 20).alias("closure_km"), (F.col("candidate_id") * 47 % 101 / 100).alias("unique_ratio"),
                                      table(METRICS).alias("metrics"), table(AVERAGES).alias("components")))


def _limit(key, op, limit):
    return f"coalesce({key} {op} {limit}, true)"


def _flag_sql() -> dict[str, str]:
    m, a = {k: f"({v})" for k, v in METRICS.items()}, {k: f"coalesce({v}, 0)" for k, v in AVERAGES.items()}
    share = {k: f"coalesce({v}, 0)" for k, v in m.items()}
    urban = _limit(f"coalesce({m['corridor_urban_pressure']}, {m['urban_penalty']})", "<=", 0.42)
    out = {"time_budget_fit": "candidate_id % 12 = 0 OR (minutes <= target_minutes + greatest(5e0, target_minutes * 0.15e0) AND minutes >= greatest(10e0, target_minutes * 0.55e0))",
           "loop_closure": "km / 20 <= 3", "low_repeated_road_risk": "candidate_id * 47 % 101 / 100 >= 0.72", "repeated_corridor_ok": _limit(m["repeated_corridor_cell_share"], "<=", 0.25),
           "leg_separation_ok": _limit(m["leg_separation_score"], ">=", 0.35), "backtracking_risk_ok": _limit(m["backtracking_penalty"], "<=", 0.35),
           "corridor_urban_pressure_ok": urban, "edge_urban_pressure_ok": _limit(f"coalesce({m['edge_urban_pressure']}, {m['start_end_penalty']})", "<=", 0.58), "urban_pressure_ok": urban,
           "scenic_peak_ok": f"greatest({share['scenic_moments_score']}, {share['photo_peak_score']}) >= 0.42 OR score >= 0.65"}
    own = {"water_share_ok": (["coastal", "riverside"], f"greatest({share['water_corridor_share']}, {a['water']}, {share['bridge_coastal_score']}) >= 0.28"),
           "elevation_curve_share_ok": (["mountain", "winding_roads", "adventure"], f"greatest({share['curve_elevation_corridor_share']}, {a['elevation']}) >= 0.28"),
           "quiet_share_ok": (["countryside", "open_roads", "relaxing"], f"greatest({share['quiet_corridor_share']}, {a['solitude']}) >= 0.32"),
           "road_stress_ok": (["countryside", "open_roads", "relaxing"], _limit(m["road_stress_score"], "<=", 0.48)),
           "tree_canopy_ok": (["nature_escape"], _limit(m["tree_canopy_score"], ">=", 0.26))}
    return out | {k: f"CASE WHEN list_has_any(v, {vibes}) THEN {rule} END" for k, (vibes, rule) in own.items()}


_flags = _flag_sql()
_with_vibes = "(SELECT *, CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[]) AS v FROM candidates)"


@query("contract_flags", oracle(["candidates"], "SELECT candidate_id, " + ", ".join(f"{e} AS {k}" for k, e in _flags.items()) + f" FROM {_with_vibes}"))
def contract_flags(spark, sf):
    return contract_rows(spark, sf).select("candidate_id", *_flags)


@query("contract_warnings", oracle(["candidates"], "SELECT candidate_id, concat_ws(' ', " + ", ".join(f"CASE WHEN NOT ({_flags[k]}) THEN '{m}' END" for k, m in qu.WARNINGS.items()) + f") AS warnings FROM {_with_vibes}"))
def contract_warnings(spark, sf):
    return contract_rows(spark, sf).select("candidate_id", F.array_join(qu.contract_warnings(), " ").alias("warnings"))


@query("unique_place_ratios", oracle(["route_points"], "SELECT route_id, CASE WHEN count(*) < 2 THEN 1e0 ELSE count(DISTINCT concat(round(lon, 5), ',', round(lat, 5))) / count(*) END AS unique_ratio FROM route_points GROUP BY 1", "unique_ratio"))
def unique_place_ratios(spark, sf):
    return qu.unique_ratio(domain(spark, sf, "route_points"))


# Status and reason of a candidate's job, in SQL that both engines read.
FAILED_STATUS = "CASE WHEN candidate_id % 5 = 3 THEN 'COMPLETED' ELSE 'FAILED' END"
FAILED_REASON = """CASE candidate_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Solver timed out' WHEN 3 THEN 'NO FEASIBLE route found here' ELSE 'No strong match near the start' END"""
_unmet = "(lower(reason) LIKE '%no strong %' OR lower(reason) LIKE '%no feasible route found%')"
_next = "CASE WHEN target_minutes < 60 THEN 60 WHEN target_minutes < 90 THEN 90 WHEN target_minutes < 120 THEN 120 ELSE target_minutes + 30 END"


@query("failure_guidance", oracle(["candidates"], f"""SELECT candidate_id, CASE WHEN status <> 'FAILED' THEN NULL WHEN {_unmet} THEN 'vibe_unavailable' ELSE 'route_generation_failed' END AS code,
    CASE WHEN status <> 'FAILED' THEN NULL WHEN trim(coalesce(reason, '')) = '' THEN '{qu.FAILED_TEXT}' ELSE reason END AS message,
    CASE WHEN status <> 'FAILED' THEN '' WHEN {_unmet} THEN concat_ws('|', CASE WHEN NOT list_contains(v, a) THEN a END, CASE WHEN NOT list_contains(v, b) THEN b END, CASE WHEN NOT list_contains(v, c) THEN c END)
      ELSE 'countryside|open_roads' END AS suggested_vibes,
    CASE WHEN status <> 'FAILED' THEN '' WHEN {_unmet} THEN concat('Try Country|Try Open Road|Increase time budget to ', {_next}, ' minutes|Move the start point farther from downtown')
      ELSE 'Try Country|Try Open Road|Increase time budget' END AS suggested_actions
    FROM (SELECT *, {FAILED_STATUS} AS status, {FAILED_REASON} AS reason, CASE WHEN list_contains(v, 'mountain') AND NOT list_contains(v, 'countryside') THEN 'adventure' WHEN list_contains(v, 'countryside') THEN 'open_roads' ELSE 'countryside' END AS a,
      CASE WHEN list_contains(v, 'countryside') THEN 'relaxing' WHEN list_contains(v, 'mountain') THEN 'winding_roads' ELSE 'open_roads' END AS b,
      CASE WHEN list_contains(v, 'countryside') THEN 'nature_escape' WHEN list_contains(v, 'mountain') THEN 'open_roads' ELSE 'relaxing' END AS c FROM {_with_vibes})"""))
def failure_guidance(spark, sf):
    jobs = domain(spark, sf, "candidates").select("candidate_id", "target_minutes", text.parse_vibes("vibes_json").alias("vibes"), F.expr(FAILED_STATUS).alias("status"),
                                                  F.expr(FAILED_REASON).alias("failure_reason"))
    g = qu.failure_guidance()
    return jobs.select("candidate_id", g["code"].alias("code"), g["message"].alias("message"), *[F.array_join(g[k], "|").alias(k) for k in ("suggested_vibes", "suggested_actions")])
