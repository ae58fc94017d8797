"""Hard negatives by the vertical scan against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistagrid.llm import vertical
from vistagrid.llm.vertical import Cell, hard_negatives, op12_hard_negatives

SCHEMA = "id long, label long, v array<bigint>"


def brute(rows, asks, positives=5, negatives=5, least=80, most=100):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, label, v in rows:
        if asks(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in anchors.items():
        scored = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
        same = [(j, -s) for s, j, m in scored if m == label][:positives]
        for k, (j, p) in enumerate(same):
            fit = [(-s, n) for s, n, m in scored if m != label and least * p <= 100 * -s <= most * p][:negatives]
            out += [(i, j, r + 1, n, p, s, k + 1) for r, (s, n) in enumerate(fit)]
    return sorted(out)


def table_of(seed, n, width, spread, labels=3):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(labels), [rng.randint(-spread, spread) for _ in range(width)]) for k in range(n)]
    return rows + rows[:7] + [(n, 0, []), (n + 1, 0, [5]), (n + 2, 1, [spread] * (width + 3))]


@pytest.mark.parametrize(("spread", "width"), [(3, 5), (200, 24), (3 * 10**8, 9)])
def test_matches_all_pairs(spark, monkeypatch, spread, width):
    monkeypatch.setattr(vertical, "CELL", 90)
    rows = table_of(spread, 300, width, spread)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("id") % 10 == 0).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r[c] for c in "anchor_id positive_id rank negative_id positive_score negative_score positive_rank".split()) for r in got) == want


def test_scan_drops_rows_but_none_that_count():
    rng = np.random.default_rng(5)
    columns = rng.integers(-50, 50, (32, 4000))
    columns[:, :40] *= 6
    cell = Cell([(np.arange(4000), np.zeros(4000, np.int64), columns)])
    seen = []
    anchor = columns[:, 3]

    def prune(low, high, rows):
        seen.append(len(rows))
        return high >= np.partition(low, -5)[-5]

    rows, score = cell.scan(anchor, np.arange(4000), prune)
    exact = anchor @ columns
    assert (score == exact[rows]).all() and set(np.argsort(-exact, kind="stable")[:5]) <= set(rows)
    assert seen[-1] < seen[0] / 2 and len(rows) < seen[0] / 20


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.125], 2), (3, None, 1), (4, [0.5, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (None, [0.5, 0.2], 2), (8, [0.5, 0.2], None),
            (100, [0.0, 0.0], 3), (2, [0.5, 0.125], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("positive_id", F.lit("own")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12_hard_negatives(spark, str(tmp_path)).collect()
    # Row 0 has label 2 after the shift, so its partner is row 2, twice; row 1 (label 1) scores higher than 100 %.
    assert [(r.anchor_id, r.positive_id) for r in got if r.anchor_id == 100] == []
    assert {r.positive_id for r in got} <= {2}


def test_empty_table(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).count() == 0
