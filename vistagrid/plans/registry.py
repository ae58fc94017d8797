"""Query registry: name -> Spark plan, and name -> equivalent SQL for the correctness check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.sources.fixtures import duck_ctes

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles so that sums in another order compare equal: noise goes at 9 digits, ties go up at 6."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        col = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            col = F.floor(F.round(col, digits + 3) * 10.0**digits + 0.5) / 10.0**digits
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        out.append(col.alias(f.name))
    return df.select(*out)


def oracle(tables: list[str], body: str, doubles: str = "", extra: str = "", recursive: bool = False) -> str:
    """SQL text: domain tables as CTEs, optional further CTEs, the body, rounding of the named doubles."""
    head = duck_ctes(*tables) if tables else ""
    parts = [p for p in (head, extra.strip().rstrip(",")) if p]
    if parts and not head:
        parts[0] = "WITH " + parts[0]
    with_part = ",\n".join(parts)
    lead = f"{with_part},\n" if with_part else "WITH "
    rounded = ", ".join(f"floor(round({n}, {DIGITS + 3}) * 1e{DIGITS} + 0.5e0) / 1e{DIGITS} AS {n}" for n in doubles.split())
    select = f"SELECT * REPLACE ({rounded})" if rounded else "SELECT *"
    text = f"{lead}result_rows AS ({body}) {select} FROM result_rows"
    return text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text


def query(name: str, sql: str | None = None):
    """Registers a plan under `name`, with its SQL equivalent where one exists."""

    def wrap(fn: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
