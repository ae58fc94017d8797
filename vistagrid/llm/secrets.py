"""Secret scans: multipart credential linking, in DataFrame operations only.

Base secrets (assignments, access keys, long hex runs) are reported as they are. Identifiers, bare secrets and endpoints
are weak by themselves: an interval join on (text, scope cell) reports one only when the parts that complete it start
within `SCOPE` code points of it. A cell is `SCOPE` code points wide and each part has a bounded number of neighbours in
it, since parts of one kind never overlap, so the join cannot grow with the length of a text.

Defined cases: null reads as empty; texts without any candidate have no spans; copies of a text are scanned once; of the
input only the columns in `keep` are carried by `secret_spans`, and all of them by `redacted`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistagrid.llm.common import table
from vistagrid.llm.registry import query
from vistagrid.llm.spans import located, matches, rebuilt, text_key

SCOPE = 400
# kind: (rank, gate, regex, group, least length of the group, part of a credential)
BASE = {
    "assign": (0, r"(?i)password|passwd|secret|token|api_?key",
               r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret"),
    "access": (1, r"AKIA[A-Z0-9]{12}", r"AKIA[A-Z0-9]+", 0, 16, "identifier"),
    "hex": (2, r"[0-9a-f]{32}", r"[0-9a-f]{32,}", 0, 32, "secret"),
}
WEAK = {
    "identifier": (3, r"(?i)client|user|login|account|tenant|key_?id",
                   r"""(?i:\b(client_?id|client|access_?key_?id|key_?id|username|user|login|account|tenant))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 4,
                   "identifier"),
    "bare": (4, r"[0-9][A-Za-z0-9+/_=-]{0,39}[A-Z][A-Za-z0-9+/_=-]{0,39}|[A-Z][A-Za-z0-9+/_=-]{0,39}[0-9]",
             r"(?<![A-Za-z0-9+/_=-])(?=[^0-9\s]{0,60}[0-9])(?=[^A-Z\s]{0,60}[A-Z])(?=[^a-z\s]{0,60}[a-z])[A-Za-z0-9+/_=-]{20,}", 0, 20, "secret"),
    "endpoint": (5, r"(?i)://|host|endpoint|server",
                 r"""(?i:\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]+|\b(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9.-]+)""", 0, 6,
                 "endpoint"),
}
# A weak part is reported when one of these sets of other parts lies in its scope.
COMPLETE = {"identifier": [["secret"]], "bare": [["identifier"], ["endpoint"]], "endpoint": [["identifier", "secret"]]}
RULES = {**BASE, **WEAK}


def gate(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(r[1])) for r in RULES.values()])


def candidates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, rank, part, start, end, value) of all base and weak candidates of distinct texts."""
    body = F.col(text)
    found = [F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(part).alias("part"), F.lit(least).alias("least"),
                      F.when(F.rlike(body, F.lit(pre)), matches(body, F.lit(rx), F.lit(group))).alias("hits"))
             for kind, (rank, pre, rx, group, least, part) in RULES.items()]
    rows = texts.select(key, F.explode(F.array(*found)).alias("f")).select(key, "f.*").where(F.size("hits") > 0)
    return located(rows, [key, "kind"], "hits").where(F.length("value") >= F.col("least")).drop("least")


def linked(found: DataFrame, key: str) -> DataFrame:
    """Base candidates, and the weak ones that do not overlap a base one and whose complementary parts share their scope."""
    base = F.col("rank") < len(BASE)
    order = Window.partitionBy(key).orderBy("start", "rank")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = found.withColumns({"__before": before, "__after": after}).where(
        base | (F.coalesce(F.col("__before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("__after") >= F.col("end"), F.lit(True))))
    cell = F.floor(F.col("start") / SCOPE)
    parts = free.select(key, F.col("part").alias("other"), F.col("start").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    weak = free.where(~base).withColumn("cell", cell)
    met = weak.join(parts, [key, "cell"]).where(F.abs(F.col("start") - F.col("at")) <= SCOPE).groupBy(key, "kind", "rank", "start", "end").agg(
        F.collect_set("other").alias("others"))
    complete = [(F.col("kind") == kind) & reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [F.array_contains("others", p) for p in need]) for need in sets])
                for kind, sets in COMPLETE.items()]
    return free.where(base).select(key, "kind", "rank", "start", "end").unionByName(
        met.where(reduce(lambda a, b: a | b, complete)).select(key, "kind", "rank", "start", "end"))


def _spans_of(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep`, the text's key (own for texts without a candidate), and its sorted spans or null."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(*[F.col(f"`{c}`") for c in keep], body.alias("__text")).withColumn("__gated", gate(F.col("__text")))
    own = own.withColumn("__key", F.when(F.col("__gated"), text_key(F.col("__text"))))
    texts = own.where("__gated").groupBy("__key").agg(F.first("__text").alias("__text"))
    spans = linked(candidates(texts, "__key", "__text"), "__key").groupBy("__key").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("__spans"))
    # Texts without a candidate get keys of their own, so no task receives all of them.
    rows = own.withColumn("__key", F.coalesce("__key", F.xxhash64(*[F.col(f"`{c}`") for c in keep]).cast("string"))).drop("__gated", "__text")
    return rows.join(spans, "__key", "left").drop("__key")


def secret_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` and `spans`: array of (start, rank, end, kind) by start, then rank; code points, end exclusive."""
    found = _spans_of(docs, text, [c for c in keep or ["doc_id"] if c.lower() != "spans"])
    return found.withColumn("spans", F.coalesce("__spans", F.array().cast(found.schema["__spans"].dataType))).drop("__spans")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Input rows and columns, with every reported span of the text replaced by `mark`; texts without spans stay as they are."""
    clean = docs.where(~F.coalesce(gate(F.col(text)), F.lit(False)))
    # Only texts with a candidate travel: their columns go through the join, all others are passed on where they are.
    marked = _spans_of(docs.where(gate(F.col(text))), text, docs.columns)
    merged = F.aggregate(
        F.coalesce("__spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")),
        F.array().cast("array<struct<start:bigint,end:bigint,new:string>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                       F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                                                        F.lit(mark).alias("new")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("new"))))))
    fixed = marked.withColumn("__m", merged).withColumn(text, F.when(F.size("__m") > 0, rebuilt(F.col(text), F.col("__m"))).otherwise(F.col(text)))
    return clean.unionByName(fixed.select(*[F.col(f"`{c}`") for c in docs.columns]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
