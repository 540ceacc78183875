"""Work that must not grow faster than the input: what makes a model's rows runs once, not in every pass."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import models as D
from ledgerspark.operators import sampling as S
from ledgerspark.sources.adapter import loans, raw_accepted


@pytest.fixture(scope="module")
def labelled(spark, sf):
    return loans(spark, sf).filter("target is not null").drop("predicted_pd").localCheckpoint()


def counted(df, column="loan_amnt"):
    """df, and a counter of how often its rows are made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    return df.withColumn(column, F.udf(seen, "double")(column)), made


def test_folds_are_made_once(spark, labelled):
    rows = labelled.count()
    folds, made = counted(S.stratified_folds(labelled))
    assert D.out_of_fold_scores(folds).count() == rows
    assert made.value == rows


def test_a_fit_and_its_scores_read_their_rows_once_each(spark, labelled):
    rows = labelled.count()
    df, made = counted(labelled)
    assert D.full_refit(df, labelled.select("loan_id", "purpose"), 0.35).count() == rows
    assert made.value == 2 * rows and spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= 1


def test_many_customers_in_small_files_do_not_pass_through_the_driver(spark, tmp_path):
    """120 000 customers fill less than a megabyte of files, which Spark would broadcast."""
    n = 120_000
    spark.range(n, numPartitions=1).selectExpr("id AS c_custkey", "'name' AS c_name", "cast(id % 25 as int) AS c_nationkey", "1000.0D AS c_acctbal", "'MACHINERY' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    orders = "id AS o_orderkey", f"id * 7 % {n} AS o_custkey", "substr('FOP', cast(id % 3 as int) + 1, 1) AS o_orderstatus", "100.0D + id AS o_totalprice", "timestamp'1995-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority"
    spark.range(n, numPartitions=1).selectExpr(*orders).write.parquet(f"{tmp_path}/orders.parquet")
    for rows in (loans(spark, str(tmp_path)), raw_accepted(spark, str(tmp_path))):
        got = rows.select(F.col(rows.columns[0]).alias("id"), "annual_inc")
        assert len(got.collect()) == n and got.select("id").distinct().count() == n
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_fit_uses_the_cores_whatever_the_files(spark, monkeypatch):
    """Rows of one partition are dealt to a partition a core, no more; features of few bins share a byte."""
    from ledgerspark.operators import boosting as B

    rows = spark.range(40_000, numPartitions=1).selectExpr("array(cast(id % 977 as double), cast(id % 2 as double), cast(id % 3 = 0 as double)) AS features", "cast(id % 5 = 0 as double) AS label", "1.0D AS weight")
    passes, real = spark.sparkContext.accumulator(0), B._histograms

    def counting(*how):
        of = real(*how)
        return lambda part, blocks: (passes.add(1), of(part, blocks))[1]

    monkeypatch.setattr(B, "_histograms", counting)
    monkeypatch.setattr(B, "ALONE", 0)
    monkeypatch.setattr(B, "CELLS", 1000)
    B.boost(rows, 1, 3, B.Plan(trees=1, depth=1))
    assert passes.value == spark.sparkContext.defaultParallelism
    places = B.packing([64, 2, 2, 5, 33])
    assert len({c for c, _, _ in places}) == 3
    bins = B.np.array([[63, 0], [1, 0], [0, 1], [4, 2], [32, 7]], dtype=B.np.uint8)
    assert all((B.Packed.of(bins, places)[f] == bins[f]).all() for f in range(5))


def test_contributions_are_made_once_for_all_directions(spark, labelled):
    parts = labelled.selectExpr("loan_id", "stack(2, 'dti', coalesce(dti, 20) / 50, 'loan_amnt', -loan_amnt / 90000) AS (feature, contribution)")
    values = labelled.selectExpr("loan_id", "stack(2, 'dti', dti, 'loan_amnt', loan_amnt) AS (feature, value)")
    contributions, made = counted(parts, "contribution")
    got = {r.feature: r.direction for r in D.global_importance(contributions, None, values).collect()}
    assert made.value == parts.count() and got == {"dti": "rising", "loan_amnt": "falling"}


def test_tables_give_the_attributions_of_leaves(spark, labelled, monkeypatch):
    monkeypatch.setattr(D, "TABLE", 60)  # several tables of the same features
    m = D.fit(labelled, "trees", trees=12)
    x = D.np.array([r.features for r in m.transform(labelled.limit(200)).select("features").collect()], dtype=float)
    x[0, :3] = D.np.nan
    tables, mean = D.contribution_tables(m.trees)
    want, expected = D.path_contributions(m.trees.nodes(), x)
    got = D.table_contributions(tables, D.binned(x, m.trees.cuts)).T
    assert D.np.allclose(got, want, atol=1e-12) and abs(mean - expected - m.trees.base) < 1e-12
    assert max(cells.shape[1] for _, _, cells in tables) <= 60 or len(tables) > 1
