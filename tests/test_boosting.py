"""Boosted trees against plain versions of their definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import boosting as B
from ledgerspark.operators import evaluation as E
from ledgerspark.operators import models as D
from ledgerspark.operators import sampling as S
from ledgerspark.sources.adapter import loans


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 9, 3000), rng.integers(0, 2, 3000)]).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] > 4) * 1.5 - x[:, 2] * (x[:, 0] > 0))))).astype(float)
    w = rng.choice([1.0, 2.0], 3000)
    return spark.createDataFrame([(r.tolist(), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "features array<double>, label double, weight double").repartition(6), x, y, w


def plain(x, y, w, cuts, plan, features=(0, 1, 2)):
    """The same trees, node by node over the rows themselves."""
    rate = (y * w).sum() / w.sum()
    margin, trees = np.full(len(y), np.log(rate / (1 - rate))), []
    for _ in range(plan.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, tree = w * (p - y), w * p * (1 - p), {}

        def grow(k, at, depth, g=g, h=h, tree=tree, margin=margin):
            best, score = (1e-9, None, None), lambda a: g[a].sum() ** 2 / (h[a].sum() + plan.ridge)
            if depth < plan.depth:
                for f in features:
                    for c, cut in enumerate(cuts[f]):
                        left, right = at[x[at, f] <= cut], at[x[at, f] > cut]
                        if h[left].sum() >= plan.least_cover and h[right].sum() >= plan.least_cover:
                            gain = (score(left) + score(right) - score(at)) / 2
                            if gain > best[0] + 1e-12:
                                best = gain, f, c
            if best[1] is None:
                tree[k] = (-1, -plan.step * g[at].sum() / (h[at].sum() + plan.ridge))
                margin[at] += tree[k][1]
                return
            _, f, c = best
            tree[k] = (f, c)
            grow(2 * k + 1, at[x[at, f] <= cuts[f][c]], depth + 1)
            grow(2 * k + 2, at[x[at, f] > cuts[f][c]], depth + 1)

        grow(0, np.arange(len(y)), 0)
        trees.append(tree)
    return trees, margin


@pytest.mark.parametrize("alone,cells,direct", [(1_000_000, 1, 1), (0, 1_000_000, 32), (0, 2_000, 32), (0, 2_000, 1)])
def test_trees_equal_their_definition(rows, monkeypatch, alone, cells, direct):
    df, x, y, w = rows
    monkeypatch.setattr(B, "ALONE", alone)
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "DIRECT", direct)
    plan = B.Plan(trees=4, depth=3, step=0.3, rows=1.0, columns=1.0)
    got = B.boost(df, 2, 3, plan)
    want, margin = plain(x, y, w, got.cuts, plan)
    for tree, t in zip(got.trees, want, strict=True):
        assert {k: (int(n["feature"]), int(n["cut"])) for k, n in enumerate(tree) if n["feature"] >= 0} == {k: v for k, v in t.items() if v[0] >= 0}
        assert all(abs(tree["value"][k] - v[1]) < 1e-9 for k, v in t.items() if v[0] < 0)
    assert np.allclose(got.margins(x), margin, atol=1e-9)


def test_gains_add_up_to_the_loss_taken_away(rows):
    df, x, y, w = rows
    plan = B.Plan(trees=1, depth=4, step=1.0, rows=1.0, columns=1.0)
    got = B.boost(df, 2, 3, plan)
    p = 1 / (1 + np.exp(-got.base))
    g, h, at = w * (p - y), w * p * (1 - p), B.leaves(got.trees[0], B.binned(x, got.cuts))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + plan.ridge) / 2
    taken = sum(score(at == k) for k in np.unique(at)) - score(np.ones(len(y), bool))
    gain, weight, cover = zip(*got.importance(), strict=True)
    assert abs(sum(gain) - taken) < 1e-8 * taken and sum(weight) == (got.trees[0]["feature"] >= 0).sum() and all(c > 0 for c, n in zip(cover, weight, strict=True) if n)


def test_edge_cases(spark):
    schema = "features array<double>, label double, weight double"
    assert B.boost(spark.createDataFrame([], schema), 1, 1).trees == []
    one = B.boost(spark.createDataFrame([([1.0], 1.0, 1.0)] * 20, schema), 1, 1, B.Plan(trees=3, columns=1.0))
    assert one.trees == [] and one.margins(np.array([[1.0], [np.nan]])).tolist() == [one.base] * 2
    several = B.boost(spark.createDataFrame([([float("nan") if i % 3 == 0 else float(i)], float(i % 3 == 0), 1.0) for i in range(300)], schema), 1, 1, B.Plan(trees=3, columns=1.0))
    assert several.margins(np.array([[np.nan]]))[0] > several.margins(np.array([[5.0]]))[0]


def test_one_task_and_jobs_give_the_same_trees(rows, monkeypatch):
    """Of rows in one partition, with draws of rows and features."""
    df, plan = rows[0].coalesce(1), B.Plan(trees=6, rows=0.7, columns=0.7)
    one = B.boost(df, 2, 3, plan)
    monkeypatch.setattr(B, "ALONE", 0)
    jobs = B.boost(df, 2, 3, plan)
    assert len(one.trees) == 6 and all(np.array_equal(a, b) for a, b in zip(one.trees, jobs.trees, strict=True))


def test_nothing_stays_persistent(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "ALONE", 0)
    B.boost(rows[0], 2, 3, B.Plan(trees=2))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


def test_fit_on_loans(spark, sf):
    """Better than chance on rows it hasn't seen, and the same on every run; attributions of any key and of scenarios add up."""
    df = loans(spark, sf).filter("target is not null").drop("predicted_pd").withColumn("target", F.when(F.col("dti") > 25, 1).when(F.col("loan_amnt") > 15000, 1).otherwise(F.col("target")))
    split = S.stratified_split(df)
    train, test = (df.join(split.filter(F.col("split") == n).select("loan_id"), "loan_id", "left_semi") for n in ("train", "test"))
    m = D.fit(train, "trees", trees=15)
    auc = E.ranking_metrics(E.score_histogram(D.score_batch(m, test, 0.35))).first()["roc_auc"]
    assert auc > 0.85
    again = D.fit(train, "trees", trees=15)
    assert all(np.array_equal(a, b) for a, b in zip(m.trees.trees, again.trees.trees, strict=True))

    keyed = test.limit(50).withColumn("application", F.col("loan_id").cast("long") + 1)
    got = {r.application: r.s for r in D.contributions(m, keyed, "application").groupBy("application").agg(F.sum("contribution").alias("s")).collect()}
    expected = D.tree_contributions(m, keyed, "application").first()["expected"]
    want = {r.application: float(np.log(r.predicted_pd / (1 - r.predicted_pd))) for r in m.scored(keyed).collect()}
    assert max(abs(got[k] + expected - want[k]) for k in want) < 1e-9

    scenarios = test.limit(30).select(F.concat(F.lit("s"), "loan_id").alias("scenario"), "loan_id", F.lit(30_000.0).alias("loan_amnt"), F.lit(None).cast("double").alias("annual_inc"), F.lit(12.0).alias("dti"), F.lit(60).alias("term_months"))
    parts = D.what_if_attributions(m, test, scenarios).groupBy("loan_id", "scenario").agg(F.sum("contribution").alias("s")).collect()
    scored = {(r.loan_id, r.scenario): r.predicted_pd for r in D.what_if(test, scenarios, m, 0.35).collect()}
    assert len(parts) == 60 and all(abs(r.s + expected - np.log(scored[r.loan_id, r.scenario] / (1 - scored[r.loan_id, r.scenario]))) < 1e-9 for r in parts)


def test_attributions_that_do_not_add_up_fail(spark, sf, monkeypatch):
    from pyspark.errors import PythonException

    df = loans(spark, sf).filter("target is not null").drop("predicted_pd").limit(300)
    m = D.fit(df, "trees", trees=2)
    monkeypatch.setattr(D, "ADDITIVITY", -1.0)
    with pytest.raises(PythonException, match="attributions miss the margin"):
        D.tree_contributions(m, df).collect()


def test_folds_see_only_the_others(spark, sf):
    df = loans(spark, sf).filter("target is not null").drop("predicted_pd")
    folds = S.stratified_folds(df, 3)
    got = {r.loan_id: (r.fold, r.predicted_pd) for r in D.out_of_fold_scores(folds, "trees", trees=3).collect()}
    own = D.fit(folds.filter("fold <> 1"), "trees", trees=3)
    want = {r.loan_id: r.predicted_pd for r in D.score_batch(own, folds.filter("fold = 1"), 0.5).collect()}
    assert len(got) == df.count() and {k: p for k, (f, p) in got.items() if f == 1} == want


def test_medians_are_exact(spark):
    df = spark.createDataFrame([(str(i), float(i * i % 7919), None if i % 4 else float(i), "a" if i % 2 else None) for i in range(1, 4000)], "loan_id string, annual_inc double, dti double, purpose string")
    got = D.fill_medians(df, ["annual_inc", "dti"])
    incs, dtis = [float(i * i % 7919) for i in range(1, 4000)], [float(i) for i in range(4, 4000, 4)]
    assert got == {"annual_inc": float(np.median([x for x in incs if x > 0])), "dti": float(np.median(dtis))}
