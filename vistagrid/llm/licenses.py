"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame operations only.

A text that holds none of the gate's words is done at once. For the others every rule whose own keyword occurs is
matched against the text's words. Detections are word intervals; one that lies inside another of the same or a better
tier is suppressed by a running maximum over the intervals sorted by start, so no pair of detections is ever formed.

Rules come from families (name, keyword, versions) and phrasings; the tier of a phrasing is its priority.

Defined cases: null reads as empty; texts without a gate word have no labels and score 0; copies of a text are scanned
once; of the input only the columns in `keep` are carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistagrid.llm.common import ascii_lower, table
from vistagrid.llm.registry import query
from vistagrid.llm.spans import located, matches, text_key

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GATE = r"(?i)licen[sc]|copyright|copyleft|spdx|public domain|all rights reserved|warranty|gpl|creative commons|\bcc[ -]by"

# Base phrases of the contract: words that stand one behind the other, and the label they give.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Families: label, keyword that must occur, name as a regex over lower-case words, versions (a version is words too).
FAMILIES = [
    ("apache", "apache", r"(?:the )?apache(?: software)?(?: license)?", ["1 0", "1 1", "2 0"]),
    ("mit", "mit", r"(?:the )?(?:mit|expat)(?: style)?", []),
    ("mit-0", "mit", r"mit(?: no attribution| 0)", []),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public license", ["1", "2", "2 0", "3", "3 0"]),
    ("gpl", "gpl", r"(?:the )?(?:gnu )?gpl", ["v1", "v2", "v3", "2", "2 0", "3", "3 0"]),
    ("lgpl", "lesser general", r"(?:the )?(?:gnu )?lesser general public license", ["2 1", "3", "3 0"]),
    ("lgpl", "library general", r"(?:the )?(?:gnu )?library general public license", ["2", "2 0"]),
    ("lgpl", "lgpl", r"(?:the )?(?:gnu )?lgpl", ["v2", "v3", "2 0", "2 1", "3 0"]),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public license", ["1 0", "3", "3 0"]),
    ("agpl", "agpl", r"(?:the )?(?:gnu )?agpl", ["v3", "3 0"]),
    ("gfdl", "documentation license", r"(?:the )?(?:gnu )?free documentation license", ["1 1", "1 2", "1 3"]),
    ("bsd", "bsd", r"(?:the )?bsd", ["0 clause", "1 clause", "2 clause", "3 clause", "4 clause", "two clause", "three clause", "four clause"]),
    ("bsd", "bsd", r"(?:the )?(?:new|modified|simplified|revised|original|freebsd) bsd", []),
    ("isc", "isc", r"(?:the )?isc", []),
    ("mpl", "mozilla", r"(?:the )?mozilla public license", ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", r"(?:the )?mpl", ["v2", "1 1", "2 0"]),
    ("epl", "eclipse", r"(?:the )?eclipse public license", ["1 0", "2 0", "v10", "v20"]),
    ("edl", "eclipse", r"(?:the )?eclipse distribution license", ["1 0"]),
    ("cddl", "common development", r"(?:the )?common development and distribution license", ["1 0", "1 1"]),
    ("cpl", "common public", r"(?:the )?common public license", ["0 5", "1 0"]),
    ("cpal", "common public attribution", r"(?:the )?common public attribution license", ["1 0"]),
    ("artistic", "artistic", r"(?:the )?artistic", ["1 0", "2 0"]),
    ("boost", "boost", r"(?:the )?boost software", ["1 0"]),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", []),
    ("libpng", "libpng", r"(?:the )?libpng", ["2 0"]),
    ("unlicense", "unlicense", r"(?:the )?unlicense", []),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl", ["1", "2"]),
    ("eupl", "european union", r"(?:the )?european union public (?:license|licence)", ["1 0", "1 1", "1 2"]),
    ("eupl", "eupl", r"(?:the )?eupl", ["1 0", "1 1", "1 2"]),
    ("osl", "open software", r"(?:the )?open software license", ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic free", r"(?:the )?academic free license", ["1 2", "2 0", "2 1", "3 0"]),
    ("apsl", "apple public", r"(?:the )?apple public source license", ["1 0", "1 1", "1 2", "2 0"]),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public license", []),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal license", []),
    ("python", "python", r"(?:the )?python software foundation license", ["2", "2 0"]),
    ("php", "php", r"(?:the )?php license", ["3 0", "3 01"]),
    ("ruby", "ruby", r"(?:the )?ruby license", []),
    ("openssl", "openssl", r"(?:the )?openssl", []),
    ("ofl", "open font", r"(?:the )?(?:sil )?open font license", ["1 0", "1 1"]),
    ("odbl", "open database", r"(?:the )?open database license", ["1 0"]),
    ("odc-by", "open data commons", r"(?:the )?open data commons attribution license", ["1 0"]),
    ("pddl", "public domain dedication", r"(?:the )?public domain dedication(?: and)? license", ["1 0"]),
    ("upl", "universal permissive", r"(?:the )?universal permissive license", ["1 0"]),
    ("ncsa", "illinois", r"(?:the )?university of illinois ncsa(?: open source)?", []),
    ("postgresql", "postgresql", r"(?:the )?postgresql", []),
    ("vim", "vim", r"(?:the )?vim", []),
    ("w3c", "w3c", r"(?:the )?w3c software(?: notice and)?", []),
    ("cecill", "cecill", r"(?:the )?cecill(?: free software)?(?: license)?", ["1 0", "2 0", "2 1"]),
    ("mulan", "mulan", r"(?:the )?mulan (?:psl|permissive software license)", ["1", "2", "v1", "v2"]),
    ("elastic", "elastic", r"(?:the )?elastic license", ["1 0", "2 0"]),
    ("sspl", "server side public", r"(?:the )?server side public license", ["1"]),
    ("busl", "business source", r"(?:the )?business source license", ["1 0", "1 1"]),
    ("openrail", "openrail", r"(?:the )?(?:creativeml |bigscience )?openrail(?: m)?", []),
]
CREATIVE = {"cc-by": r"by|attribution", "cc-by-sa": r"by sa|attribution sharealike|attribution share alike", "cc-by-nd": r"by nd|attribution noderivatives|attribution noderivs",
            "cc-by-nc": r"by nc|attribution noncommercial|attribution non commercial", "cc-by-nc-sa": r"by nc sa|attribution noncommercial sharealike",
            "cc-by-nc-nd": r"by nc nd|attribution noncommercial noderivatives|attribution noncommercial noderivs", "cc0": r"0|zero"}
CREATIVE_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Rules that stand alone: label, tier, keyword, regex.
SINGLE = [
    ("mit", 1, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 1, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 1, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", 1, "free software foundation", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("zlib", 1, "altered source", r"altered source versions must be plainly marked as such"),
    ("unlicense", 1, "public domain", r"this is free and unencumbered software released into the public domain"),
    ("boost", 1, "boost", r"distributed under the boost software license version 1 0"),
    ("public-domain", 2, "public domain", r"(?:in|into|to) the public domain"),
    ("all-rights-reserved", 3, "all rights reserved", r"all rights reserved"),
    ("no-warranty", 4, "warranty", r"(?:without|no) (?:any )?warranty(?: of any kind)?"),
    ("copyright", 4, "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("license-mention", 4, "licen", r"(?:licensed|released|distributed|available|provided) under (?:the|a|an) (?:terms of (?:the|a|an) )?[^ ]+ licen[sc]e"),
]
TIERS = 4
WEIGHT = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}
LEAD = r"(?:licensed|released|distributed|available|provided|published|covered|governed) (?:under|by)(?: the terms of)?(?: the)? "


def rules() -> list[tuple[str, int, str, str]]:
    """(label, tier, keyword, regex), in order of priority: statements, names with version, bare names, mentions."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            tail = rf"{name}(?: license)?(?: version)?(?: v)? {v}"
            out.append((label, 1, keyword, LEAD + tail))
            out.append((label, 2, keyword, tail))
        out.append((label, 1, keyword, rf"{LEAD}{name}(?: license)?"))
        out.append((label, 2, keyword, name if "license" in name.split(" ")[-1] else rf"{name} licen[sc]e"))
        out.append((label, 1, "spdx", rf"spdx license identifier {label.replace('-', ' ')}(?: [0-9]+){{0,2}}(?: only| or later)?"))
    for label, name in CREATIVE.items():
        for v in CREATIVE_VERSIONS:
            out.append((label, 1, "cc", rf"(?:{LEAD})?cc (?:{name}) {v}"))
            out.append((label, 2, "creative commons", rf"(?:{LEAD})?creative commons (?:{name})(?: license)?(?: version)? {v}(?: international| unported| generic)?"))
        out.append((label, 2, "creative commons", rf"creative commons (?:{name}) license"))
    out += [(label, tier, keyword, rx) for label, tier, keyword, rx in SINGLE]
    return list(dict.fromkeys(sorted(out, key=lambda r: r[1])))


def padded_words(text: Column) -> Column:
    """Lower-case words with one space before and after each: ' w0 w1 ... '."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), GAP, " ")


def spaces(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base_places(padded: Column, phrase: str) -> Column:
    """(n, first, last) of a phrase: how often it stands, and the first and last word it starts at."""
    rx = F.lit(f"(?<= ){phrase}(?= )")
    pieces, n = F.split(padded, rx, -1), len(phrase.split())
    count = (F.size(pieces) - 1).cast("bigint")
    first = spaces(F.element_at(pieces, 1)) - 1
    last = spaces(padded) - spaces(F.element_at(pieces, -1)) - n
    return F.struct(count.alias("n"), F.when(count > 0, first.cast("bigint")).alias("first"), F.when(count > 0, last.cast("bigint")).alias("last"))


def detections(texts: DataFrame, key: str, padded: str) -> DataFrame:
    """Surviving detections (key, label, tier, weight, start, end) of distinct texts; start and end count words."""
    table_ = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(tier).alias("tier"), F.lit(word).alias("word"),
                                F.lit(f"(?<= )(?:{rx})(?= )").alias("rx")) for i, (label, tier, word, rx) in enumerate(rules())])
    open_ = texts.select(key, padded, F.explode(F.filter(table_, lambda r: F.contains(F.col(padded), r["word"]))).alias("r"))
    found = open_.select(key, "r.rule", "r.label", "r.tier", matches(F.col(padded), F.col("r.rx")).alias("hits")).where(F.size("hits") > 0)
    places = located(found, [key, "rule"], "hits", size=spaces)
    # Before the first word stands one space, inside a match one fewer than it has words.
    places = places.select(key, "rule", "label", "tier", (F.col("start") - 1).alias("start"), F.col("end").alias("end"))
    over = Window.partitionBy(key).orderBy("start", F.desc("end"), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.when(F.col("tier") == t, F.max(F.when(F.col("tier") <= t, F.col("end"))).over(over)) for t in range(1, TIERS + 1)]
    places = places.withColumn("covered", F.coalesce(*reach))
    weight = reduce(lambda acc, t: acc.when(F.col("tier") == t, WEIGHT[t]), range(2, TIERS + 1), F.when(F.col("tier") == 1, WEIGHT[1]))
    return places.where(F.coalesce(F.col("covered") < F.col("end"), F.lit(True))).select(key, "label", "tier", weight.alias("weight"), "start", "end")


OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score")


def license_scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with word count, places of the base phrases, labels, detections and a score."""
    keep = [c for c in keep or ["doc_id"] if c not in OUTPUTS]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    gated = F.rlike(body, F.lit(GATE))
    own = docs.select(*keep, body.alias("__text"), gated.alias("__gated"))
    own = own.withColumn("__padded", F.when(F.col("__gated"), padded_words(F.col("__text"))))
    own = own.withColumn("__key", F.when(F.col("__gated"), text_key(F.col("__text"))))
    texts = own.where("__gated").select("__key", "__padded").groupBy("__key").agg(F.first("__padded").alias("__padded"))
    found = detections(texts, "__key", "__padded").groupBy("__key").agg(
        F.array_sort(F.collect_set("label")).alias("__labels"), F.max("weight").alias("__score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "tier"))).alias("__found"))
    places = {label: F.when(F.col("__gated") & F.contains("__padded", F.lit(f" {phrase} ")), _base_places(F.col("__padded"), phrase)) for phrase, label in BASE.items()}
    rows = own.select(*keep, F.regexp_count("__text", F.lit(WORD)).cast("bigint").alias("n_words"), *[p.alias(f"__{n}") for n, p in places.items()],
                      F.coalesce("__key", F.xxhash64(*keep).cast("string")).alias("__key"))
    joined = rows.join(found, "__key", "left")
    labels = [F.col(f"__{n}") for n in places]
    base = F.filter(F.array(*[F.when(F.col(f"__{n}.n") > 0, F.lit(n)) for n in places]), lambda x: x.isNotNull())
    return joined.select(
        *keep, "n_words", reduce(lambda a, b: a + b, [F.coalesce(c["n"], F.lit(0)) for c in labels]).cast("bigint").alias("n_base"),
        F.least(*[c["first"] for c in labels]).alias("first_word"), F.greatest(*[c["last"] for c in labels]).alias("last_word"),
        F.array_sort(base).alias("base_labels"), F.array_sort(F.array_union(base, F.coalesce("__labels", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("__found", F.array().cast(found.schema["__found"].dataType)).alias("detections"),
        F.coalesce("__score", F.when(F.size(base) > 0, F.lit(WEIGHT[2])), F.lit(0.0)).alias("score"))


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")
