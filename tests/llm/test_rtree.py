"""Hard negatives against all pairs."""

import math
import random

import numpy as np

from ledgerspark.llm import rtree as R

SCHEMA = "vec_id long, embedding array<double>, label string, score long, number long, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, "x") for i, v, lab in rows], SCHEMA)


def brute(rows, every=50, scale=256):
    """(anchor, positive, rank, negative, scores) by all pairs of rows of one length, in whole numbers of Python."""
    rows = [(i, [math.floor(scale * c) for c in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, v, lab) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, b) for b, (j, w, _) in enumerate(rows) if b != a and len(w) == len(v))
        positives = [(-s, j) for s, j, b in scored if rows[b][2] == lab][:5]
        for p, j in positives:
            inside = [(-s, k) for s, k, b in scored if rows[b][2] != lab and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, j, r, k, p, s) for r, (s, k) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in R.hard_negatives(df, **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding], str((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in R.op11_hard_negatives(spark, sf).collect()) == brute(rows)


def test_clusters_ties_and_a_hot_label(spark):
    """Many leaves and trees, a third of all rows of one label, copies of one vector, and repeated ids."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + 0.1 * rng.normal(size=6)).round(2).tolist(), "hot" if i % 3 == 0 else f"l{i % 5}") for i in range(900)]
    rows += [(1000 + i, rows[0][1], "hot" if i % 2 else "l1") for i in range(250)] + [(50, rows[7][1], "l2"), (50, rows[7][1], "l2"), (51, rows[50][1], "hot")]
    assert mined(frame(spark, rows), shape=(200, 8, 4)) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], f"l{i % 3}") for i in range(160)]
    rows += [(None, rows[0][1], "l0"), (200, None, "l0"), (250, [0.5] * 4, None), (300, [0.5, None, 0.1, 0.2], "l1"), (350, [0.1, math.nan, 0.2, 0.3], "l1"), (400, [0.5, 0.5], "l0"), (401, [0.6, 0.5], "l0"), (402, [0.5, 0.2], "l1"), (450, [], "l0"), (451, [], "l1")]
    got = mined(frame(spark, rows))
    assert got == brute(rows) and any(g[0] == 400 for g in got)
    assert mined(frame(spark, [])) == [] and mined(frame(spark, rows[:1])) == []


def test_scores_beyond_floats(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 4e4 * 10 ** (i % 3) for _ in range(3)], f"l{i % 2}") for i in range(120)]
    assert mined(frame(spark, rows)) == brute(rows)
    huge = mined(frame(spark, [(i, [1e300, 1.0], f"l{i % 2}") for i in range(4)]))
    assert huge == []  # all scores are alike, so none lies below 95 hundredths


def test_packing_and_intervals():
    x = np.random.default_rng(1).integers(-50, 50, (1000, 5))
    order = R.str_order(x)
    assert sorted(order.tolist()) == list(range(1000))
    boxes = [x[order[i : i + R.LEAF]] for i in range(0, 1000, R.LEAF)]
    spread = lambda parts: sum(np.prod(p.max(axis=0) - p.min(axis=0) + 1.0) for p in parts)
    assert spread(boxes) < spread([x[i : i + R.LEAF] for i in range(0, 1000, R.LEAF)]) / 2
    q = np.random.default_rng(2).integers(-9, 9, (7, 5)).astype(float)
    least, most = R.intervals(q, np.array([b.min(axis=0) for b in boxes], float), np.array([b.max(axis=0) for b in boxes], float))
    for k, b in enumerate(boxes):
        s = q @ b.T
        assert (least[:, k] <= s.min(axis=1)).all() and (s.max(axis=1) <= most[:, k]).all()
