"""Hard-negative mining by a vertical scan of columnar vectors.

Rows are packed into blocks that hold one array per dimension; blocks are dealt by hash into cells of about `CELL` rows.
Anchors, a stated share of the rows, pass every cell in packs, so a task holds one cell and one pack at a time. Inside a
cell each anchor reads the dimensions in the descending order of its own magnitudes. After every step the remaining
dimensions add at least the sum of their smallest and at most the sum of their largest contributions (from the cell's
minimum and maximum per dimension); a row whose interval can no longer matter leaves the candidate bitmap:

* first pass, positives: rows of the anchor's label whose upper bound is below the k-th best lower bound;
* second pass, negatives: rows of other labels whose interval meets no score window of the anchor's positives, or whose
  upper bound is below the k-th best lower bound of rows that surely lie in the window.

The survivors' sums are complete and exact. Each cell gives at most k rows per anchor and window; their ranks over all cells
follow from a window function, which Spark limits to k rows before the shuffle.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; shorter vectors are
filled with zeros; repeated rows count as often as they stand there, but an anchor id asks once, with its smallest (label,
vector); a row with the anchor's own id is never its partner; ties go to the smaller id; an empty table, or anchors without
partners, give no rows. Components are whole numbers; sums up to 2^53 run in floating point, larger ones in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistagrid.llm.common import stored, table
from vistagrid.llm.registry import query

BLOCK, CELL, PACK, STRIPE = 2048, 16384, 64, 8192
STEP = 8
EXACT = 2.0**53
CELLS = "cell bigint, kind int, ids binary, labels binary, width int, columns binary, wanted binary"
POSITIVE, NEGATIVE = "anchor_id bigint, id bigint, score bigint", "anchor_id bigint, slot int, id bigint, score bigint"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, dtype=np.int64).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=np.int64)


def _columns(column: pa.Array) -> np.ndarray:
    """Vectors as (dimension, row), shorter ones filled with zeros."""
    vectors = [np.array(v, dtype=np.int64) for v in column.to_pylist()]
    out = np.zeros((max(map(len, vectors), default=0), len(vectors)), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[:len(v), k] = v
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            columns = _columns(b.column("v"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), pa.array([_packed(b.column("id").to_numpy())], pa.binary()), pa.array([_packed(b.column("label").to_numpy())], pa.binary()),
                 pa.array([len(columns)], pa.int32()), pa.array([_packed(columns)], pa.binary())], names=["block", "ids", "labels", "width", "columns"])
            number += 1


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in packs; `wanted` holds the number of score windows of each anchor, then their positive scores."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            b = batch.slice(at, PACK)
            columns = _columns(b.column("v"))
            wanted = b.column("wanted").to_pylist()
            numbers = np.array([*map(len, wanted), *(s for w in wanted for s in w)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), pa.array([_packed(b.column("id").to_numpy())], pa.binary()), pa.array([_packed(b.column("label").to_numpy())], pa.binary()),
                 pa.array([len(columns)], pa.int32()), pa.array([_packed(columns)], pa.binary()), pa.array([_packed(numbers)], pa.binary())],
                names=["pack", "ids", "labels", "width", "columns", "wanted"])
            number += 1


class Cell:
    """Rows of one cell by label, one array per dimension, with the minimum and maximum of each."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        width = max((len(c) for _, _, c in blocks), default=0)
        ids, labels = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        columns = np.concatenate([np.pad(c, ((0, width - len(c)), (0, 0))) for _, _, c in blocks], axis=1)
        order = np.lexsort((ids, labels))
        self.ids, self.labels, columns = ids[order], labels[order], columns[:, order]
        self.low, self.high = columns.min(axis=1, initial=0), columns.max(axis=1, initial=0)
        self.reach = np.maximum(np.abs(self.low.astype(np.float64)), np.abs(self.high.astype(np.float64)))
        self.whole, self.floats = columns, columns.astype(np.float64) if (self.reach < EXACT).all() else None

    def scan(self, anchor: np.ndarray, rows: np.ndarray, prune: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Surviving rows and their exact sums. `prune(low, high, rows)` tells which rows may still matter."""
        width = min(len(anchor), len(self.whole))
        q = anchor[:width]
        exact = self.floats is not None and float(np.abs(q.astype(np.float64)) @ self.reach[:width]) < EXACT
        kind, columns = (np.float64, self.floats) if exact else (np.int64, self.whole)
        q = q.astype(kind)
        order = np.argsort(-np.abs(q), kind="stable")
        order = order[q[order] != 0]
        ends = np.stack([q * self.low[:width].astype(kind), q * self.high[:width].astype(kind)])[:, order]
        left_low, left_high = (np.r_[np.cumsum(part[::-1])[::-1], 0].astype(kind) for part in (ends.min(axis=0), ends.max(axis=0)))
        bitmap = np.zeros(columns.shape[1], dtype=bool)
        bitmap[rows] = True
        total = np.zeros(len(rows), dtype=kind)
        for at in range(0, len(order), STEP):
            dims = order[at:at + STEP]
            dense = len(rows) * 2 > columns.shape[1]
            part = q[dims] @ columns[dims] if dense else q[dims] @ columns[np.ix_(dims, rows)]
            total += part[rows] if dense else part
            done = min(at + STEP, len(order))
            keep = prune(total + left_low[done], total + left_high[done], rows)
            if not keep.all():
                bitmap[rows[~keep]] = False
                rows, total = np.flatnonzero(bitmap), total[keep]
            if not len(rows):
                break
        return rows, total.astype(np.int64)

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        rows = np.arange(lo, hi)
        rows = rows[self.ids[rows] != anchor_id]

        def prune(low, high, rows):
            return high >= (np.partition(low, -k)[-k] if len(low) > k else -math.inf)

        rows, score = self.scan(anchor, rows, prune)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]

    def negatives(self, anchor_id: int, label: int, anchor: np.ndarray, scores: list[int], k: int, least: int, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Best rows of other labels for each positive score: least * positive <= 100 * score <= most * positive."""
        windows = [(-(-least * s // 100), most * s // 100) for s in scores]
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        rows = np.r_[0:lo, hi:len(self.ids)]
        rows = rows[self.ids[rows] != anchor_id]

        def prune(low, high, rows):
            keep = np.zeros(len(rows), dtype=bool)
            for first, last in windows:
                inside = (high >= first) & (low <= last)
                sure = low[(low >= first) & (high <= last)]
                keep |= inside & (high >= np.partition(sure, -k)[-k]) if len(sure) > k else inside
            return keep

        rows, score = self.scan(anchor, rows, prune)
        out = []
        for slot, (first, last) in enumerate(windows):
            fit = np.flatnonzero((score >= first) & (score <= last))
            fit = fit[np.lexsort((self.ids[rows[fit]], -score[fit]))[:k]]
            out.append((slot, self.ids[rows[fit]], score[fit]))
        return out


def _scanned(find: Callable, names: list[str]) -> Callable:
    """Streams the sorted rows of a partition: the blocks of a cell first, then the anchor packs that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks, cell = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != current:
                    current, blocks, cell = row["cell"], [], None
                ids, labels = _unpacked(row["ids"]), _unpacked(row["labels"])
                columns = _unpacked(row["columns"]).reshape(row["width"], len(ids))
                if row["kind"] == 0:
                    blocks.append((ids, labels, columns))
                    continue
                if not blocks:
                    continue
                cell = cell or Cell(blocks)
                numbers = _unpacked(row["wanted"])
                ends = np.cumsum(np.r_[len(ids), numbers[:len(ids)]])
                out = [[] for _ in names]
                for k, (i, label) in enumerate(zip(ids.tolist(), labels.tolist())):
                    for values in find(cell, i, label, columns[:, k], numbers[ends[k]:ends[k + 1]].tolist()):
                        n = len(values[-1])
                        for kept, v in zip(out, (i, *values)):
                            kept.append(v if isinstance(v, np.ndarray) else np.full(n, v))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int32() if c == "slot" else pa.int64()) for c, v in zip(names, out)], names=names)

    return run


def _met(blocks: DataFrame, anchors: DataFrame, cells: int, find: Callable, schema: str) -> DataFrame:
    """Sends blocks to their cells and every anchor pack past all cells, and runs `find` there."""
    packs = stored(anchors.mapInArrow(_packs, "pack bigint, ids binary, labels binary, width int, columns binary, wanted binary"))
    stripes = max(1, math.ceil(packs.count() * PACK / STRIPE))
    stripe = F.pmod(F.xxhash64("pack"), F.lit(stripes))
    at = F.pmod(F.xxhash64("block"), F.lit(cells))
    names = ["cell", "kind", "ids", "labels", "width", "columns", "wanted"]
    held = blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).select((F.col("stripe") * cells + at).cast("bigint").alias("cell"), F.lit(0).alias("kind"), "ids", "labels", "width",
                                                                                                  "columns", F.lit(None).cast("binary").alias("wanted"))
    passing = packs.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).select((stripe * cells + F.col("at")).cast("bigint").alias("cell"), F.lit(1).alias("kind"), *names[2:])
    dealt = held.unionAll(passing).repartition(cells * stripes, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_scanned(find, [c.split()[0] for c in schema.split(", ")]), schema)


def _ranked(found: DataFrame, groups: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, asks: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """Hard negatives of the rows that `asks` picks; `rows` has id and label (bigint) and v (array of bigint), none null."""
    blocks = stored(rows.select("id", "label", "v").mapInArrow(_blocks, "block bigint, ids binary, labels binary, width int, columns binary"))
    cells = max(1, math.ceil(rows.count() / CELL))
    anchors = stored(rows.where(asks).groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v"))
    first = _met(blocks, anchors.withColumn("wanted", F.array().cast("array<bigint>")), cells, lambda c, i, label, v, w: [c.positives(i, label, v, positives)], POSITIVE)
    partners = stored(_ranked(first, ["anchor_id"], positives).select("anchor_id", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Bounded lists: at most `positives` scores per anchor, in the order of their ranks. Below zero a window is empty.
    scores = partners.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("s")).select(F.col("anchor_id").alias("id"), F.col("s.positive_score").alias("wanted"))
    second = _met(blocks, anchors.join(scores, "id"), cells, lambda c, i, label, v, w: c.negatives(i, label, v, w, negatives, least, most), NEGATIVE)
    best = _ranked(second, ["anchor_id", "slot"], negatives).withColumn("positive_rank", F.col("slot") + 1)
    return best.join(partners, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                                                                    F.col("score").alias("negative_score"), F.col("positive_rank").cast("int").alias("positive_rank"))


SQL = """
WITH used AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256e0 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.id % 100 = 0 AND a.id <> b.id),
partners AS (
  SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS positive_rank FROM scored WHERE same)
  WHERE positive_rank <= 5),
found AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
    id AS negative_id, positive_score, score AS negative_score, CAST(positive_rank AS INTEGER) AS positive_rank
  FROM partners p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM found WHERE rank <= 5
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = (table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select(F.col("vec_id").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v")))
    return hard_negatives(rows, F.col("id") % 100 == 0)
