"""String, JSON, array and map helpers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistagrid.functions import catalog
from vistagrid.functions.scalars import c, clamp01, int_div


def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs for x in (k, v)])


_ALIASES = {alias: vibe for vibe, names in catalog.VIBE_ALIASES.items() for alias in names}


def slug(value) -> Column:
    s = F.regexp_replace(F.lower(c(value)), "&", " and ")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_|_$", "")


def normalize_vibe(value) -> Column:
    """Canonical spelling of a vibe; null and blank give ''."""
    s = slug(F.coalesce(c(value), F.lit("")))
    return F.coalesce(literal_map(_ALIASES.items())[s], s)


def supported(vibe) -> Column:
    return c(vibe).isin(catalog.VIBES)


def parse_vibes(raw_json) -> Column:
    """Ordered distinct supported vibes of a JSON array; bad JSON gives []."""
    raw = F.from_json(c(raw_json), "array<string>")
    kept = F.filter(F.transform(F.filter(raw, lambda v: v.isNotNull() & (F.trim(v) != "")), normalize_vibe), supported)
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def resolve_vibes(raw_json, vibe) -> Column:
    """JSON list first, then the single vibe, then the default."""
    parsed = parse_vibes(raw_json)
    single = normalize_vibe(vibe)
    return F.when(F.size(parsed) > 0, parsed).otherwise(
        F.array(F.when(single == "", F.lit(catalog.DEFAULT_VIBE)).otherwise(single)))


def _numeric_entries(raw_json, accept_text: bool) -> Column:
    """map<string, double> of a JSON object.

    Values keep their JSON spelling as variants, so numbers and text can be told apart.
    """
    entries = F.from_json(c(raw_json), "map<string, variant>")

    def number(v):
        kind = F.schema_of_variant(v)
        text_ok = F.lit(accept_text) & (kind == "STRING")
        return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL") | text_ok,
                      F.try_variant_get(v, "$", "double"))

    return F.map_filter(F.transform_values(entries, lambda k, v: number(v)), lambda k, v: v.isNotNull())


def parse_preferences(raw_json) -> Column:
    """Accepted preference keys with values clamped to [0, 1]; anything unusable is dropped."""
    known = literal_map(catalog.PREFERENCE_ALIASES.items())
    entries = F.map_entries(_numeric_entries(raw_json, accept_text=True))
    named = F.transform(entries, lambda e: F.struct(
        known[F.translate(F.lower(F.trim(e["key"])), "- ", "__")].alias("key"), clamp01(e["value"]).alias("value")))
    kept = F.filter(named, lambda e: e["key"].isNotNull())
    # A key may arrive under two spellings: the last one wins. The fold reads the parsed entries once.
    single = F.aggregate(kept, F.array().cast("array<struct<key:string,value:double>>"),
                         lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(single)


def parse_breakdown(raw_json) -> Column:
    """Numeric entries of a score-breakdown object."""
    return F.coalesce(_numeric_entries(raw_json, accept_text=False), F.create_map().cast("map<string,double>"))


def blank_to_null(value) -> Column:
    s = F.lower(F.trim(c(value)))
    return F.when(s != "", s)


def normalize_region(value) -> Column:
    return F.substring(blank_to_null(value), 1, 40)


def time_bucket(minutes) -> Column:
    """15-minute bucket used by calibration, without an upper cap."""
    return F.greatest(F.lit(15), int_div(c(minutes) + 7, 15) * 15)


def time_bucket_capped(minutes) -> Column:
    """Bucket used by analytics: null for missing or non-positive, at most 360."""
    return F.when(c(minutes) > 0, F.least(F.lit(360), time_bucket(minutes)))


def hmac_sha256(message, secret: str) -> Column:
    """Hex HMAC-SHA256 as two nested digests over literal key pads; the secret never becomes a column."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(c(message), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def hash_client(client_id, session_id, secret: str) -> Column:
    client = F.when(F.trim(c(client_id)) != "", F.trim(c(client_id)))
    session = F.when(F.trim(c(session_id)) != "", F.trim(c(session_id)))
    return hmac_sha256(F.coalesce(client, session), secret)


def normalize_feedback_tags(tags) -> Column:
    """First four distinct allowed tags, in order."""
    clean = F.transform(F.filter(c(tags), lambda t: t.isNotNull()), lambda t: F.translate(F.lower(F.trim(t)), "- ", "__"))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t.isin(catalog.FEEDBACK_TAGS))), 1, 4)


def display_list(vibes) -> Column:
    """Labels joined by ' + '; unknown vibes keep their text; an empty list shows the default."""
    labels = literal_map(catalog.VIBE_LABELS.items())
    shown = F.filter(F.transform(c(vibes), lambda v: F.coalesce(labels[normalize_vibe(v)], v)),
                     lambda v: v.isNotNull() & (F.trim(v) != ""))
    return F.when(F.size(F.coalesce(shown, F.array().cast("array<string>"))) > 0, F.array_join(shown, " + ")).otherwise(
        catalog.VIBE_LABELS[catalog.DEFAULT_VIBE])


def calibration_key(mode, region, minutes, strategy) -> Column:
    def part(value):
        s = F.translate(F.lower(F.trim(c(value))), " ", "_")
        return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)

    bucket = time_bucket(F.greatest(F.lit(1), c(minutes)))
    return F.concat_ws("|", part(mode), part(region), bucket.cast("string"), part(strategy))


def normalize_profile(value) -> Column:
    s = F.translate(F.lower(F.trim(c(value))), "- ", "__")
    return F.when(s.isin(catalog.PROFILES), s)


def tag_present(tags, key: str) -> Column:
    return F.map_contains_key(c(tags), F.lit(key))


def tag_in(tags, key: str, values) -> Column:
    return F.coalesce(c(tags)[key].isin(*values), F.lit(False))


def tag_set(tags, key: str) -> Column:
    """Key exists with a value other than '' and 'no'."""
    return F.coalesce(~c(tags)[key].isin("", "no"), F.lit(False))


def any_tag(tags, rules) -> Column:
    """rules: (key, None) for presence or (key, [values]) for membership."""
    out = F.lit(False)
    for key, values in rules:
        out = out | (tag_present(tags, key) if values is None else tag_in(tags, key, values))
    return out


def region_grid(lat, lon) -> Column:
    """Half-degree region key with one decimal, null when a coordinate is missing."""
    def half(v):
        return F.format_string("%.1f", F.floor(c(v) / 0.5) * 0.5)

    return F.when(c(lat).isNotNull() & c(lon).isNotNull(), F.concat(F.lit("grid:"), half(lat), F.lit(":"), half(lon)))


# Metadata limits. Fixed values.
META_DEPTH, META_ITEMS, META_VALUE, META_TOTAL = 4, 50, 1000, 4000


def metadata_check(raw_json) -> Column:
    """struct(depth, items, longest, size, ok) of a JSON text, all on the JVM.

    String literals are blanked first; nesting and item counts then follow from the punctuation that is left.
    """
    raw = c(raw_json)
    literal = r'"(?:\\.|[^"\\])*+"'
    skeleton = F.regexp_replace(raw, literal, "s")
    brackets = F.regexp_replace(skeleton, r"[^\[\]{}]", "")
    depth = F.aggregate(
        F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, ch: F.struct(
            (acc["now"] + F.when(ch.isin("{", "["), 1).when(ch.isin("}", "]"), -1).otherwise(0)).alias("now"),
            F.greatest(acc["most"], acc["now"] + F.when(ch.isin("{", "["), 1).otherwise(0)).alias("most")))["most"]
    full = F.length(F.regexp_replace(F.regexp_replace(skeleton, r"[\[{]\s*[\]}]", ""), r"[^\[{]", ""))
    items = F.length(F.regexp_replace(skeleton, "[^,]", "")) + full
    words = F.transform(F.regexp_extract_all(raw, F.lit(literal), F.lit(0)),
                        lambda w: F.length(F.regexp_replace(w, r"\\u[0-9a-fA-F]{4}|\\.", "x")) - 2)
    numbers = F.transform(F.split(skeleton, r"[\[\]{},:\s]+"), F.length)
    longest = F.greatest(F.coalesce(F.array_max(words), F.lit(0)), F.coalesce(F.array_max(numbers), F.lit(0)))
    variant = F.try_parse_json(raw)
    size = F.length(F.to_json(variant))
    ok = raw.isNull() | (variant.isNotNull() & (depth <= META_DEPTH) & (items <= META_ITEMS) & (longest <= META_VALUE)
                         & (size <= META_TOTAL))
    return F.struct(depth.alias("depth"), items.alias("items"), longest.alias("longest"), size.alias("size"),
                    F.coalesce(ok, F.lit(False)).alias("ok"))
