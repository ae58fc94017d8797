"""Folds a log of job events into the state of every job.

A job is always in one of few states: waiting, running, primary ready with or without a worker's lease, each with so many
retries left, or done or failed. So an event is a function on those states, held as a short array, and functions
compose: a span of events shrinks to one array whatever came before it. Spans are folded apart and then chained, so a
job that owns all events of the table needs no task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistagrid.operators.analytics import HOUR_US
from vistagrid.operators.skew import SPAN, numbered

KINDS = ["claim", "primary", "release", "complete", "transient_failure", "permanent_failure", "expire"]


@dataclass(frozen=True)
class State:
    status: str = "QUEUED"
    leased: bool = False
    primary: bool = False
    left: int = 0


def after(state: State, kind: str) -> tuple[State, int]:
    """Next state and the number of state revisions that the event adds; what a state does not allow changes nothing."""
    done, failed = State("COMPLETED", False, True, state.left), State("FAILED", left=state.left)
    active = state.status in ("PROCESSING", "PRIMARY_READY") and state.leased
    if kind == "claim":
        if state.status == "QUEUED":
            return State("PROCESSING", True, state.primary, state.left), 1
        if state.status == "PRIMARY_READY" and not state.leased:
            return State("PRIMARY_READY", True, True, state.left), 0
    elif not active:
        pass
    elif kind == "primary" and state.status == "PROCESSING":
        return State("PRIMARY_READY", True, True, state.left), 1
    elif kind == "release" and state.status == "PRIMARY_READY":
        return State("PRIMARY_READY", False, True, state.left), 0
    elif kind == "complete" and state.primary:
        return done, 1
    elif kind == "permanent_failure":
        return (done if state.primary else failed), 1
    elif kind in ("transient_failure", "expire"):
        if not state.left:
            return (done if state.primary else failed), 1
        return (State("PRIMARY_READY", False, True, state.left - 1) if state.primary else State("QUEUED", False, False, state.left - 1)), 1
    return state, 0


@dataclass(frozen=True)
class Table:
    """All states that a retry budget of at most `budget` can reach, and per event kind the next state and added revisions of each."""

    budget: int

    @property
    def states(self) -> list[State]:
        out = [State(left=n) for n in range(self.budget + 1)]
        for s in out:
            out.extend(t for t in dict.fromkeys(after(s, k)[0] for k in KINDS) if t not in out)
        return out

    @property
    def moves(self) -> list[list[tuple[int, int]]]:
        """moves[kind][state] = (next state, revisions)."""
        states = self.states
        return [[(states.index(t), n) for t, n in (after(s, k) for s in states)] for k in KINDS]


def kind_code(kind: str = "kind") -> Column:
    """Position of a kind in KINDS; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.lower(F.trim(F.col(kind)))), F.lit(0)) - 1


def _ints(rows) -> Column:
    return F.array(*[F.lit(n) for n in rows])


def _point(state: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(state.cast("int").alias("s"), zero.alias("rev"), zero.alias("applied"))


def fold_lifecycle(events: DataFrame, jobs: DataFrame, attempts: int = 4, span: int = SPAN, levels: int = 2) -> DataFrame:
    """State of every job of `jobs` (job_id, max_retries) after its events (job_id, event_id, at_us, kind).

    Repeated event ids count once; unknown kinds change nothing. Events are ordered by (at_us, event_id). A job may retry as
    often as both its own limit and `attempts` allow.
    """
    table = Table(attempts - 1)
    states, moves, size = table.states, table.moves, len(table.states)
    to, added = _ints(t for row in moves for t, _ in row), _ints(n for row in moves for _, n in row)
    own = jobs.select("job_id", F.greatest(F.lit(0), F.least(F.lit(attempts - 1), F.coalesce("max_retries", F.lit(0)))).cast("int").alias("start"))
    once = events.groupBy("event_id").agg(F.min(F.struct("at_us", "job_id", kind_code().alias("code"))).alias("e")).select("event_id", "e.*")
    known = once.where("code IS NOT NULL").join(own, "job_id")
    ranked = numbered(known, ["at_us", "event_id"], F.floor(F.col("at_us") / HOUR_US), ["job_id"], "pos")
    first = F.floor((F.col("pos") - 1) / span)
    items = ranked.groupBy("job_id", first.alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("items"), F.first("start").alias("start"))
    # Only the first span of a job knows where it starts; the others are folded from every state.
    begin = F.when(F.col("run") == 0, F.array(_point(F.col("start")))).otherwise(F.array(*[_point(F.lit(k)) for k in range(size)]))

    def step(acc, e):
        def move(x):
            at = (e["code"] * size + x["s"]).cast("int")
            changed = (to[at] != x["s"]) | (added[at] > 0)
            return F.struct(to[at].alias("s"), (x["rev"] + added[at]).alias("rev"), (x["applied"] + changed.cast("bigint")).alias("applied"))

        return F.transform(acc, move)

    def chain(acc, f):
        return F.transform(acc, lambda x: F.struct(f["map"][x["s"]]["s"].alias("s"), (x["rev"] + f["map"][x["s"]]["rev"]).alias("rev"), (x["applied"] + f["map"][x["s"]]["applied"]).alias("applied")))

    runs = items.select("job_id", "run", F.size("items").cast("bigint").alias("n"), F.aggregate("items", begin, step).alias("map"))
    for level in range(levels):
        keys = ["job_id"] if level == levels - 1 else ["job_id", F.floor(F.col("run") / span).alias("up")]
        grouped = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("run", "map", "n"))).alias("items"))
        run = F.lit(0).cast("bigint") if level == levels - 1 else F.col("up")
        rest = F.slice("items", 2, F.greatest(F.lit(1), F.size("items")))
        runs = grouped.select("job_id", run.alias("run"), F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]).alias("n"),
                              F.aggregate(rest, F.col("items")[0]["map"], chain).alias("map"))
    end = runs.select("job_id", F.col("map")[0].alias("end"), "n")
    at = F.coalesce(F.col("end.s"), F.col("start"))
    pick = lambda values: F.array(*map(F.lit, values))[at]
    return own.join(end, "job_id", "left").select(
        "job_id", pick([s.status for s in states]).alias("status"), pick([s.leased for s in states]).alias("leased"), pick([s.primary for s in states]).alias("has_primary"),
        (F.col("start") - pick([s.left for s in states])).cast("bigint").alias("retries"),
        F.coalesce("end.rev", F.lit(0)).cast("bigint").alias("state_rev"), F.coalesce("end.applied", F.lit(0)).cast("bigint").alias("applied"), F.coalesce("n", F.lit(0)).cast("bigint").alias("events"))
