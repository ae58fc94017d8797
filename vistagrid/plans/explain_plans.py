"""Explanations of options: baseline averages, lifts, ranking signals, leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.functions import catalog, scoring, text
from vistagrid.operators import explain as ex
from vistagrid.operators.profiles import known_vibes
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.plans.tile_plans import SCORED
from vistagrid.sources.fixtures import GRID, domain

_OPEN = f"opened AS (SELECT *, {q.OPEN_SPACE} AS open_space FROM scored)"


def _baseline(starts: str, name: str) -> str:
    """CTEs `near_<name>` and `<name>`: every start against every tile, the nearest 1,000 within 50 km, their means."""
    d = q.hav("p.lat", "p.lon", "t.lat", "t.lon")
    means = ", ".join(f"floor({q.cl(f'avg({k})')} * 10000e0 + 0.5e0) / 10000e0 AS {k}" for k in ex.AVERAGED)
    kept = ", ".join(f"t.{k}" for k in ex.AVERAGED)
    return f"""near_{name} AS (SELECT p.request_id, {kept}, row_number() OVER (PARTITION BY p.request_id ORDER BY {d}, t.cell) AS rn
      FROM {starts} p JOIN opened t ON abs(t.lat - p.lat) < 0.5e0 AND {d} <= {ex.BASELINE_M}e0),
    {name} AS (SELECT request_id, {means}, count(*) AS baseline_tiles FROM near_{name} WHERE rn <= {ex.BASELINE_TILES} GROUP BY 1)"""


@query("baseline_averages", oracle(["trip_requests", "tiles"], "SELECT * FROM base", " ".join(ex.AVERAGED), f"{SCORED}, {_OPEN}, {_baseline('trip_requests', 'base')}"))
def baseline_averages(spark, sf):
    tiles = ex.explained_components(scoring.component_scores(domain(spark, sf, "tiles")))
    return ex.baseline_averages(domain(spark, sf, "trip_requests"), tiles, GRID)


_ROUND = "floor(greatest(0e0, least(1e0, {0})) * 10000e0 + 0.5e0) / 10000e0"
_lists = lambda index: q.values([(v, k) for v, p in catalog.VIBE_PROFILES.items() for k in p[index]], "vibe, component")
_step = "greatest(1, CAST(ceil(n_points / 160e0) AS BIGINT))"
_sampled = q.axial("lat", "lon", 7, "route_points", "route_id, lat, lon, seq, n_points")
_total = "greatest(0.0001e0, " + " + ".join(f"w_{k}" for k in catalog.COMPONENTS) + ")"


def _signal(base: str, lift_based: bool) -> str:
    flat = "CASE WHEN lift <= 0.003e0 THEN 0.40e0 ELSE 1e0 END" if lift_based else "1e0"
    other = f"CASE WHEN w >= 0.16e0 THEN 1.08e0 ELSE 1e0 END * {flat}"
    return _ROUND.format(f"{base} * CASE WHEN wished_for THEN 1.35e0 ELSE 1e0 END * CASE WHEN avoided THEN 0.45e0 ELSE 1e0 END * CASE WHEN component = 'poi' THEN CASE WHEN w >= 0.30e0 THEN 0.62e0 ELSE 0.04e0 END ELSE {other} END")


_EXPLAIN = f"""{SCORED}, {_OPEN},
  starts AS (SELECT t.request_id, p.lat, p.lon FROM (SELECT request_id, min(route_id) AS route_id FROM trips GROUP BY 1) t JOIN route_points p ON p.route_id = t.route_id AND p.seq = 0),
  {_baseline('starts', 'base')},
  seen AS (SELECT DISTINCT route_id, {q.cell_text(7)} AS cell FROM ({_sampled}) x WHERE seq % {_step} = 0 OR seq = n_points - 1),
  means AS (SELECT route_id, count(*) AS sample_tiles, {', '.join(f"{_ROUND.format(f'avg({k})')} AS {k}" for k in ex.AVERAGED)} FROM seen JOIN opened USING (cell) GROUP BY 1),
  wide AS (SELECT t.route_id, t.request_id, m.sample_tiles, b.baseline_tiles, {', '.join(f"m.{k} AS a_{k}, b.{k} AS b_{k}, t.w_{'solitude' if k == 'open_space' else k} / {_total} AS r_{k}" for k in ex.AVERAGED)}
    FROM trips t JOIN means m USING (route_id) LEFT JOIN base b ON b.request_id = t.request_id),
  long AS ({' UNION ALL '.join(f"SELECT route_id, request_id, {i} AS i, '{k}' AS component, " + (f"a_{k} AS a, coalesce(b_{k}, a_{k}) AS b, r_{k} AS w" if k in ex.AVERAGED else "0e0 AS a, 0e0 AS b, 0e0 AS w") + ", baseline_tiles, sample_tiles FROM wide" for i, k in enumerate(ex.EXPLAINED))}),
  vibes AS (SELECT DISTINCT route_id, unnest(CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[])) AS vibe FROM trips),
  wished AS (SELECT DISTINCT route_id, component FROM vibes JOIN {_lists(2)} l USING (vibe)), shunned AS (SELECT DISTINCT route_id, component FROM vibes JOIN {_lists(3)} l USING (vibe)),
  lifted AS (SELECT l.*, floor(greatest(-1e0, least(1e0, a - b)) * 10000e0 + 0.5e0) / 10000e0 AS lift, {_ROUND.format('a * w / greatest(0.0001e0, sum(a * w) OVER (PARTITION BY l.route_id))')} AS contribution,
      wi.route_id IS NOT NULL AS wished_for, sh.route_id IS NOT NULL AS avoided FROM long l LEFT JOIN wished wi ON wi.route_id = l.route_id AND wi.component = l.component LEFT JOIN shunned sh ON sh.route_id = l.route_id AND sh.component = l.component),
  weighed AS (SELECT *, {_ROUND.format('greatest(0e0, lift) * w')} AS wl FROM lifted),
  raw AS (SELECT *, max(wl) OVER (PARTITION BY route_id) > 0.003e0 AS lift_based, {_signal('wl', True)} AS s1, {_signal('contribution', False)} AS s2 FROM weighed),
  others AS (SELECT *, max(CASE WHEN component <> 'poi' THEN s1 END) OVER (PARTITION BY route_id) AS o1, max(CASE WHEN component <> 'poi' THEN s2 END) OVER (PARTITION BY route_id) AS o2 FROM raw),
  final AS (SELECT *, CASE WHEN lift_based AND o1 > 0.003e0 THEN s1 ELSE s2 END AS s, CASE WHEN lift_based AND o1 > 0.003e0 THEN o1 ELSE o2 END AS o FROM others),
  signals AS (SELECT *, CASE WHEN component = 'poi' AND w < 0.30e0 AND o > 0.003e0 THEN {_ROUND.format('least(s, o * 0.82e0)')} ELSE s END AS signal FROM final),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY signal DESC, i) AS rn FROM signals)"""
_TRIPS = ["trips", "route_points", "tiles"]


def options(spark, sf):
    trips = domain(spark, sf, "trips").withColumn("vibes", known_vibes(text.parse_vibes("vibes_json")))
    return ex.explained_options(trips, domain(spark, sf, "route_points"), domain(spark, sf, "tiles"), GRID)


@query("explained_options", oracle(_TRIPS, """SELECT route_id, component, lift, contribution, signal, CASE WHEN rn <= 3 THEN rn END AS lead, baseline_tiles, sample_tiles FROM ranked""",
                                   "lift contribution signal", _EXPLAIN))
def explained_options(spark, sf):
    rows = [F.struct(F.lit(k).alias("component"), F.col(f"lifts.{k}").alias("lift"), F.col(f"contributions.{k}").alias("contribution"), F.col(f"signals.{k}").alias("signal"),
                     F.nullif(F.array_position("leading_components", F.lit(k)), F.lit(0)).alias("lead")) for k in ex.EXPLAINED]
    return options(spark, sf).select("route_id", "baseline_tiles", "sample_tiles", F.explode(F.array(*rows)).alias("r")).select("route_id", "baseline_tiles", "sample_tiles", "r.*")


_prefers = q.values([(p, i, k) for p, names in ex.PROFILE_LEADS.items() for i, k in enumerate(names)], "profile, place, component")
# Leads that the fold starts from: for half of the requests the same for all options, and some options lead with nothing.
_own_lead = "CASE request_id % 3 WHEN 0 THEN 'elevation' WHEN 1 THEN 'curves' ELSE CASE option_no WHEN 0 THEN 'greenery' ELSE 'solitude' END END"
_LEADS = f"""given AS (SELECT request_id, route_id, option_no, route_profile, CASE WHEN request_id % 2 = 0 THEN ['solitude', 'curves', 'greenery'] WHEN request_id % 5 = 0 AND option_no = 1 THEN []
      ELSE [{_own_lead}, 'water', 'poi'] END AS leads FROM trips)"""
_FOLD = f"""{_LEADS},
  turned AS (SELECT request_id, count(*) > 1 AND bool_and(len(leads) > 0) AND count(DISTINCT leads[1]) = 1 AS diversified FROM given GROUP BY 1),
  placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY option_no, route_id) AS pos FROM given JOIN turned USING (request_id)),
  choices AS (SELECT p.request_id, p.pos, c.component, c.k, coalesce(w.place, CASE WHEN p.route_profile IN ('balanced', 'shorter') THEN 100 + c.k ELSE c.k END) AS taste
    FROM placed p, (SELECT unnest([1, 2, 3]) AS k) n, LATERAL (SELECT p.leads[n.k] AS component, n.k AS k) c LEFT JOIN {_prefers} w ON w.profile = p.route_profile AND w.component = c.component WHERE c.component IS NOT NULL AND p.diversified),
  fold AS (SELECT request_id, 0::BIGINT AS pos, []::VARCHAR[] AS used, NULL::VARCHAR AS lead FROM turned WHERE diversified
    UNION ALL SELECT f.request_id, f.pos + 1, list_append(f.used, n.lead), n.lead FROM fold f JOIN placed p ON p.request_id = f.request_id AND p.pos = f.pos + 1,
      LATERAL (SELECT coalesce((SELECT arg_min(component, taste) FROM choices c WHERE c.request_id = f.request_id AND c.pos = f.pos + 1 AND NOT list_contains(f.used, c.component)), p.leads[1]) AS lead) n)"""


@query("diversified_leads", oracle(["trips"], """SELECT p.request_id, p.route_id, p.diversified, CASE WHEN p.diversified THEN concat_ws('|', f.lead, nullif(array_to_string(list_filter(p.leads, lambda x: x <> f.lead), '|'), ''))
    ELSE array_to_string(p.leads, '|') END AS leads FROM placed p LEFT JOIN fold f ON f.request_id = p.request_id AND f.pos = p.pos""", extra=_FOLD, recursive=True))
def diversified_leads(spark, sf):
    request, option = F.col("request_id"), F.col("option_no")
    first = F.when(request % 3 == 0, "elevation").when(request % 3 == 1, "curves").when(option == 0, "greenery").otherwise("solitude")
    leads = F.when(request % 2 == 0, F.array(F.lit("solitude"), F.lit("curves"), F.lit("greenery"))).when((request % 5 == 0) & (option == 1), F.array().cast("array<string>")).otherwise(F.array(first, F.lit("water"), F.lit("poi")))
    done = ex.diversify_leads(domain(spark, sf, "trips").withColumn("leading_components", leads))
    return done.select("request_id", "route_id", "diversified", F.array_join("leading_components", "|").alias("leads"))
