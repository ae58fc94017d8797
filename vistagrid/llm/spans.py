"""Regex matches with their places, in DataFrame operations only.

`split` by a pattern gives the texts between its matches and `regexp_extract_all` the matches themselves, both from the
leftmost non-overlapping scan; running sums of their sizes give every place in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_key(text: Column) -> Column:
    """Identity of a text: results that depend on the text alone are found once for all its copies."""
    return F.sha2(text, 256)


def matches(text: Column, pattern: Column, group: Column | None = None) -> Column:
    """Array of (before, found, value): the text between two matches, the match, and one of its groups."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = [F.split(text, pattern, -1).alias("before"), found.alias("found")]
    parts.append((found if group is None else F.regexp_extract_all(text, pattern, group)).alias("value"))
    zipped = F.arrays_zip(*parts)
    return F.slice(zipped, F.lit(1), F.size(found))


def located(rows: DataFrame, key: list[str], array: str, size=F.length) -> DataFrame:
    """Explodes an array made by `matches` into rows with `start` and `end` (exclusive), counted by `size` of the strings."""
    at = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select(*[c for c in rows.columns if c != array], F.posexplode(array).alias("pos", "m"))
    out = out.withColumns({"__gap": size("m.before"), "__len": size("m.found"), "value": F.col("m.value")}).drop("m")
    return out.withColumn("end", F.sum(F.col("__gap") + F.col("__len")).over(at).cast("bigint")).withColumn(
        "start", (F.col("end") - F.col("__len")).cast("bigint")).drop("__gap", "__len", "pos")


def rebuilt(text: Column, spans: Column) -> Column:
    """Text with each of the sorted, disjoint `spans` (start, end, new) replaced by its new string; places in code points."""
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    kept = F.transform(spans, lambda s, i: F.concat(F.substring(text, (F.get(ends, i) + 1).cast("int"), (s["start"] - F.get(ends, i)).cast("int")), s["new"]))
    last = F.element_at(ends, -1)
    return F.concat(F.array_join(kept, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))
