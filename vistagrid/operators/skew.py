"""Ordered operations that keep every task bounded even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistagrid.session import cut_lineage

# Rows of one key that one task handles together.
SPAN = 4096


def numbered(df: DataFrame, order: list, chunk: Column, keys: list[str] | None = None, name: str = "rn",
             total: str | None = None) -> DataFrame:
    """Dense 1-based position per key without ever sorting a whole key in one task.

    `chunk` must be monotone in the order. Rows are ranked inside (key, chunk); the rows of earlier chunks are added
    from the small table of chunk counts.
    """
    keys = keys or []
    tagged = df.withColumn("__chunk", chunk)
    counts = tagged.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__chunk") if keys else Window.orderBy("__chunk")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    extra = [(F.sum("__n").over(over) - F.col("__n")).alias("__before")]
    if total:
        extra.append(F.sum("__n").over(whole).alias(total))
    offsets = counts.select(*keys, "__chunk", *extra)
    inner = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    ranked = tagged.withColumn("__rn", F.row_number().over(inner))
    return ranked.join(offsets, [*keys, "__chunk"]).withColumn(name, (F.col("__before") + F.col("__rn")).cast("bigint")).drop(
        "__chunk", "__rn", "__before")


def numbered_in_ranges(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Dense 1-based position in the whole order: rows are dealt into even ranges of the full order, ranked there, and
    shifted by the rows of earlier ranges. The ranges grow in number, not in size, with the data.

    Range borders come from a sample, so the dealt rows are checkpointed before they are counted and ranked.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    return numbered(dealt, order, F.col("__range"), name=name).drop("__range")


def with_halo(df: DataFrame, keys: list[str], seq: str, before: int = 0, after: int = 0, span: int = SPAN) -> DataFrame:
    """Splits each key into spans of `span` dense positions and copies the border rows into the neighbouring span.

    Adds `__span` and `__ghost`. A window partitioned by (keys, __span) then sees `before` rows to the left and
    `after` rows to the right of every real row; drop the ghosts afterwards. Needs dense positions in `seq`.
    """
    s = F.col(seq)
    own = F.floor(s / span)
    spans = [F.struct(own.alias("span"), F.lit(False).alias("ghost"))]
    if before:
        spans.append(F.when(s % span >= span - before, F.struct((own + 1).alias("span"), F.lit(True).alias("ghost"))))
    if after:
        spans.append(F.when((s % span < after) & (s >= span), F.struct((own - 1).alias("span"), F.lit(True).alias("ghost"))))
    copies = F.filter(F.array(*spans), lambda x: x.isNotNull())
    return df.withColumn("__h", F.explode(copies)).withColumns({"__span": F.col("__h.span"), "__ghost": F.col("__h.ghost")}).drop("__h")


def span_window(keys: list[str], seq: str) -> Window:
    return Window.partitionBy(*keys, "__span").orderBy(seq)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("__ghost")).drop("__span", "__ghost")


def running_total(df: DataFrame, keys: list[str], seq: str, value: str, name: str, total: str | None = None, span: int = SPAN) -> DataFrame:
    """Inclusive running sum of `value` per key: inside spans, plus the sums of the earlier spans."""
    tagged = df.withColumn("__span", F.floor(F.col(seq) / span))
    sums = tagged.groupBy(*keys, "__span").agg(F.sum(value).alias("__s"))
    over = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.coalesce(F.sum("__s").over(over), F.lit(0.0)).alias("__before")]
    if total:
        extra.append(F.sum("__s").over(Window.partitionBy(*keys)).alias(total))
    offsets = sums.select(*keys, "__span", *extra)
    inner = Window.partitionBy(*keys, "__span").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("__r", F.sum(value).over(inner)).join(offsets, [*keys, "__span"]).withColumn(
        name, F.col("__before") + F.col("__r")).drop("__span", "__r", "__before")
