"""Fixed values of the scoring rules: vibe profiles, aliases, lookup weights, thresholds, names.

Results depend on these numbers and names, so they are stated here as plain tables and nowhere else.
"""

from __future__ import annotations

# Tile score columns in storage order.
TILE_SCORES = [
    "scenic_score", "water_proximity", "elevation_variance", "natural_land_use", "road_density", "traffic_signal_score",
    "poi_density", "visual_complexity", "water_score", "green_score", "elevation_score", "solitude_score", "curve_score",
    "poi_score", "park_score", "overture_poi_score", "building_density_score", "darkness_score", "urban_penalty_score",
    "road_stress_score", "water_visibility_score", "water_crossing_score", "coastal_road_score", "tree_canopy_score",
    "scenic_poi_score", "viewpoint_score", "bridge_coastal_score",
]
COMPONENTS = ["water", "greenery", "elevation", "solitude", "curves", "poi"]

# Vibe profiles. id -> label, weights in COMPONENTS order, targets, antis, outward, min best, min mean.
VIBE_PROFILES = {
    "coastal": ("Coastal", [0.95, 0.55, 0.25, 0.45, 0.35, 0.25], ["water", "bridge_coastal"], [], False, 0.34, 0.27),
    "mountain": ("Mountain", [0.15, 0.55, 0.95, 0.65, 0.85, 0.15], ["elevation", "curves"], [], True, 0.34, 0.27),
    "countryside": ("Country", [0.25, 0.75, 0.35, 0.90, 0.45, 0.20], ["solitude", "greenery", "open_space"],
                    ["urban_penalty", "building_density", "road_stress"], True, 0.36, 0.29),
    "riverside": ("Riverside", [0.90, 0.70, 0.25, 0.55, 0.35, 0.20], ["water", "bridge_coastal", "greenery"], [], False,
                  0.34, 0.27),
    "nature_escape": ("Nature", [0.35, 0.95, 0.45, 0.92, 0.35, 0.10], ["tree_canopy", "greenery", "solitude"],
                      ["urban_penalty", "building_density", "road_stress"], True, 0.36, 0.29),
    "open_roads": ("Open Road", [0.15, 0.45, 0.25, 0.90, 0.25, 0.05], ["open_space", "solitude"],
                   ["urban_penalty", "building_density", "poi", "road_density", "road_stress"], True, 0.35, 0.28),
    "adventure": ("Adventure", [0.30, 0.55, 0.90, 0.40, 0.95, 0.20], ["curves", "elevation"], [], True, 0.34, 0.27),
    "relaxing": ("Relaxing", [0.30, 0.70, 0.25, 0.96, 0.22, 0.10], ["solitude", "greenery"],
                 ["urban_penalty", "building_density", "poi", "curves", "road_stress"], True, 0.36, 0.29),
    "winding_roads": ("Winding", [0.25, 0.40, 0.65, 0.45, 0.98, 0.10], ["curves", "elevation"], [], True, 0.34, 0.27),
}
VIBES = list(VIBE_PROFILES)
DEFAULT_VIBE = "countryside"
VIBE_LABELS = {k: v[0] for k, v in VIBE_PROFILES.items()}

# Accepted spellings of each vibe.
VIBE_ALIASES = {
    "countryside": ["country", "rural", "countryside", "sunday", "sunday_drive", "sunday_cruise", "scenic",
                    "loop_with_variety", "variety"],
    "coastal": ["coast", "coastak"],
    "riverside": ["river"],
    "nature_escape": ["forest", "woods", "nature", "nature_escaped"],
    "open_roads": ["open_road", "openroad", "openroads"],
    "winding_roads": ["winding", "winding_road", "twisty", "twisties", "fun_drive"],
    "relaxing": ["quiet", "peaceful", "calm", "clear_head", "clear_my_head", "clear_my_mind", "smooth",
                 "smooth_cruise", "cruise", "cruisek", "minimaltraffic", "minimal_traffic", "low_traffic",
                 "lowtraffic", "no_traffic", "scenic_reset"],
    "adventure": ["hide", "hidden", "hidden_gem", "hidden_gems", "photo", "photo_run", "photo_worthy", "photoworthy",
                  "photo_op", "photo_ops", "photogenic", "date_night", "golden", "golden_hour", "sunset", "sunrise",
                  "sunrise_sunset", "sunrise_and_sunset"],
}

# Preference keys accepted in a request.
PREFERENCE_ALIASES = {
    "water": "water", "greenery": "greenery", "green": "greenery", "elevation": "elevation", "solitude": "solitude",
    "curves": "curves", "curve": "curves", "poi": "poi",
}

# Geometry strategies in code order, and the vibes that choose them (first match wins).
STRATEGIES = ["WATER_FOLLOWING", "OPEN_SPACE_ESCAPE", "PHOTO_PEAKS", "QUIET_LOW_PRESSURE", "CURVY_ELEVATION",
              "BALANCED_VARIETY"]
STRATEGY_VIBES = [
    ("WATER_FOLLOWING", ["coastal", "riverside"]),
    ("OPEN_SPACE_ESCAPE", ["open_roads"]),
    ("QUIET_LOW_PRESSURE", ["relaxing", "countryside", "nature_escape"]),
    ("CURVY_ELEVATION", ["mountain", "winding_roads", "adventure"]),
]
# strategy -> minimum and maximum radius ratio, floor and divisor of the time radius, expected fit
STRATEGY_RULES = {
    "WATER_FOLLOWING": (0.45, 1.90, 3.0, 2.1, 0.34),
    "OPEN_SPACE_ESCAPE": (0.65, 2.15, 3.0, 2.1, 0.34),
    "PHOTO_PEAKS": (0.45, 1.75, 3.0, 2.1, 0.68),
    "QUIET_LOW_PRESSURE": (0.95, 3.20, 8.0, 1.35, 0.34),
    "CURVY_ELEVATION": (0.65, 2.15, 3.0, 2.1, 0.34),
    "BALANCED_VARIETY": (0.50, 2.00, 3.0, 2.1, 0.38),
}
PROFILES = ["most_scenic", "balanced", "shorter"]

# Older seven-vibe signal weights.
SIGNALS = ["water_proximity", "elevation", "land_use", "curvature", "traffic", "poi"]
SIGNAL_WEIGHTS = {
    "COASTAL": [0.40, 0.15, 0.15, 0.20, 0.05, 0.05],
    "RIVERSIDE": [0.45, 0.15, 0.20, 0.10, 0.05, 0.05],
    "MOUNTAIN": [0.10, 0.40, 0.15, 0.25, 0.05, 0.05],
    "COUNTRYSIDE": [0.15, 0.15, 0.40, 0.15, 0.10, 0.05],
    "FOREST": [0.10, 0.20, 0.40, 0.15, 0.10, 0.05],
    "OPEN_ROADS": [0.10, 0.15, 0.15, 0.35, 0.20, 0.05],
    "URBAN_EXPLORER": [0.15, 0.10, 0.25, 0.15, 0.05, 0.30],
}

# Analytics event names.
ANALYTICS_EVENTS = [
    "route_generate_clicked", "route_generate_submitted", "route_generation_primary_ready", "route_results_committed",
    "route_map_painted", "route_generation_completed", "route_generation_failed", "vibe_unavailable",
    "route_option_selected", "start_drive_clicked", "navigation_opened", "gpx_exported", "plan_new_route_clicked",
    "route_results_minimized", "route_results_viewed", "location_selected", "geolocate_clicked", "theme_toggled",
]
LATENCY_MILESTONES = ["route_generation_primary_ready", "route_results_committed", "route_map_painted"]

# Feedback tags and their signal per component (COMPONENTS order).
FEEDBACK_SIGNALS = {
    "more_like_this": [0.18, 0.18, 0.18, 0.18, 0.18, 0.08],
    "too_urban": [0.22, 0.42, 0.0, 0.80, 0.0, -0.36],
    "not_scenic": [0.30, 0.30, 0.30, 0.30, 0.30, -0.18],
    "too_boring": [0.0, 0.0, 0.32, 0.0, 0.74, 0.18],
    "loved_quiet": [0.0, 0.24, 0.0, 0.72, 0.0, 0.0],
    "loved_curves": [0.0, 0.0, 0.26, 0.0, 0.72, 0.0],
    "loved_water": [0.80, 0.0, 0.0, 0.0, 0.0, 0.0],
    "loved_greenery": [0.0, 0.78, 0.0, 0.18, 0.0, 0.0],
    "loved_stops": [0.12, 0.0, 0.12, 0.0, 0.0, 0.72],
    "too_long": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "too_short": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
}
FEEDBACK_TAGS = list(FEEDBACK_SIGNALS)

# Road stress per type and surface.
ROAD_TYPE_STRESS = [
    ("motorway", 1.00), ("motorway_link", 0.92), ("trunk", 0.90), ("trunk_link", 0.82), ("primary", 0.74),
    ("primary_link", 0.68), ("secondary", 0.54), ("secondary_link", 0.50), ("tertiary", 0.40), ("tertiary_link", 0.38),
    ("unclassified", 0.34), ("residential", 0.22), ("living_street", 0.12), ("service", 0.24), ("track", 0.46),
]
ROAD_TYPE_STRESS_OTHER = 0.36
SURFACE_STRESS = [
    ("asphalt", 0.02), ("paved", 0.04), ("concrete", 0.04), ("concrete:lanes", 0.05), ("concrete:plates", 0.06),
    ("sett", 0.16), ("paving_stones", 0.14), ("compacted", 0.18), ("fine_gravel", 0.22), ("gravel", 0.28),
    ("unpaved", 0.42), ("dirt", 0.48), ("earth", 0.50), ("ground", 0.50), ("mud", 0.68),
]
SURFACE_STRESS_OTHER = 0.08
SPEED_STRESS = [(30, 0.12), (40, 0.18), (50, 0.26), (60, 0.34), (80, 0.54), (100, 0.78)]
SPEED_STRESS_UNKNOWN = 0.32
SPEED_STRESS_FAST = 0.92
MAJOR_ROADS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"]

# Land-cover class -> greenness, urban flag.
LANDCOVER_WEIGHTS = [
    (1, 1.0, False), (2, 0.9, False), (3, 1.0, False), (4, 1.0, False), (5, 1.0, False), (6, 1.0, False),
    (7, 0.6, False), (8, 0.6, False), (9, 0.6, False), (10, 0.6, False), (11, 0.5, False), (12, 0.5, False),
    (13, 0.2, False), (14, 0.8, False), (15, 0.3, False), (16, 0.0, False), (17, 0.0, True), (18, 0.0, False),
    (19, 0.0, False), (21, 0.0, True), (22, 0.0, True), (23, 0.0, True), (24, 0.0, True), (31, 0.0, False),
    (41, 1.0, False), (42, 1.0, False), (43, 1.0, False), (52, 0.6, False), (71, 0.6, False), (81, 0.3, False),
    (82, 0.3, False), (90, 0.7, False), (95, 0.7, False),
]
# Land-cover class -> canopy.
CANOPY_WEIGHTS = [
    (1, 0.95), (2, 0.95), (3, 0.95), (4, 0.80), (5, 0.40), (6, 0.40), (7, 0.65), (8, 0.08), (9, 0.00), (10, 0.00),
    (11, 0.00), (12, 0.00), (13, 0.65), (14, 0.45), (15, 0.15), (16, 0.00), (17, 0.00), (18, 0.00), (19, 0.00),
    (21, 0.03), (22, 0.08), (23, 0.03), (24, 0.00), (31, 0.00), (41, 1.00), (42, 1.00), (43, 1.00), (52, 0.30),
    (71, 0.08), (81, 0.05), (82, 0.02), (90, 0.80), (95, 0.10),
]

# Place category -> weight, group, for the three place signals.
SCENIC_PLACE_WEIGHTS = [
    ("lookout", 1.00, "viewpoint"), ("viewpoint", 1.00, "viewpoint"), ("scenic_lookout", 1.00, "viewpoint"),
    ("waterfall", 0.96, "natural_feature"), ("lighthouse", 0.94, "landmark"), ("national_park", 0.92, "park"),
    ("state_park", 0.88, "park"), ("nature_reserve", 0.88, "park"), ("botanical_garden", 0.86, "park"),
    ("forest", 0.84, "natural_feature"), ("mountain", 0.84, "natural_feature"), ("beach", 0.82, "waterfront"),
    ("lake", 0.78, "waterfront"), ("river", 0.74, "waterfront"), ("pier", 0.72, "waterfront"),
    ("marina", 0.68, "waterfront"), ("campground", 0.64, "outdoor"), ("hiking_trail", 0.62, "outdoor"),
    ("trail", 0.62, "outdoor"), ("mountain_bike_trails", 0.58, "outdoor"), ("park", 0.56, "park"),
    ("landmark_and_historical_building", 0.54, "landmark"), ("monument", 0.52, "landmark"), ("castle", 0.52, "landmark"),
    ("fort", 0.50, "landmark"), ("bridge", 0.46, "landmark"), ("museum", 0.44, "culture"),
    ("history_museum", 0.46, "culture"), ("community_museum", 0.42, "culture"), ("art_museum", 0.44, "culture"),
    ("science_museum", 0.38, "culture"), ("art_gallery", 0.40, "culture"), ("zoo", 0.36, "culture"),
    ("aquarium", 0.36, "culture"), ("winery", 0.34, "discovery"), ("farm", 0.28, "discovery"),
]
VIEWPOINT_WEIGHTS = [
    ("lookout", 1.00, "viewpoint"), ("viewpoint", 1.00, "viewpoint"), ("scenic_lookout", 1.00, "viewpoint"),
    ("waterfall", 0.92, "natural_feature"), ("lighthouse", 0.88, "landmark"), ("mountain", 0.72, "natural_feature"),
    ("beach", 0.58, "waterfront"), ("pier", 0.54, "waterfront"), ("bridge", 0.48, "landmark"),
    ("monument", 0.42, "landmark"), ("landmark_and_historical_building", 0.36, "landmark"),
]
BRIDGE_COASTAL_WEIGHTS = [
    ("bridge", 1.00, "bridge"), ("pier", 0.90, "waterfront_structure"), ("marina", 0.78, "waterfront_structure"),
    ("lighthouse", 0.76, "coastal_landmark"), ("beach", 0.64, "waterfront"), ("waterfall", 0.58, "water_moment"),
]
# Share of the sum, the group count and the best place, and the two log scales.
PLACE_SIGNAL_SCENIC = (0.62, 0.18, 0.20, 5.0, 3.0)
PLACE_SIGNAL_VIEWPOINT = (0.58, 0.14, 0.28, 3.0, 2.0)
PLACE_SIGNAL_BRIDGE = (0.60, 0.12, 0.28, 3.0, 2.0)
PLACE_PATTERN = ("(park|view|trail|beach|waterfall|lookout|historic|landmark|nature|garden|camp|museum|tourist|"
                 "attraction|scenic)")

# Release versions in order.
VERSIONS = {
    "2.1": "2.1-traffic-signals", "2.3": "2.3-raster-data-quality-upgrade", "2.5": "2.5-park-score",
    "2.6": "2.6-raster-data-quality-upgrade-national-batched", "2.8": "2.8-urban-aware-elevation-calibration",
    "2.9": "2.9-protected-areas-enrichment", "3.0": "3.0-overture-lightpollution-enrichment",
    "3.1": "3.1-darkness-urban-penalty-calibration", "3.2": "3.2-road-stress-calibration",
    "3.3": "3.3-water-visibility-calibration", "3.4": "3.4-tree-canopy-calibration",
    "3.5": "3.5-scenic-poi-calibration", "3.6": "3.6-viewpoint-calibration",
    "3.7": "3.7-bridge-coastal-calibration",
}
