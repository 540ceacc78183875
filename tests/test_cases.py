"""The published cases of the loan engine, with their expected values."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning as C
from ledgerspark.functions import features as X
from ledgerspark.functions import scoring as K
from ledgerspark.operators import evaluation as E
from ledgerspark.operators import gates as G
from ledgerspark.operators import marts as M
from ledgerspark.operators import models as D
from ledgerspark.operators import sampling as S
from ledgerspark.operators import tables as P
from ledgerspark.sources import io


def values(spark, rows, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], f"x {kind}").select(column).collect()]


def test_label_policy(spark):
    s = ["Fully Paid", "Charged Off", "Default", "Current", "In Grace Period", "Late (16-30 days)", "Does not meet the credit policy. Status:Fully Paid", None]
    assert values(spark, s, C.derive_target(F.col("x"))) == [0, 1, 1, None, None, None, None, None]


def test_parsers(spark):
    x = F.col("x")
    assert values(spark, [" 36 months", "months", None], C.parse_term_months(x)) == [36, None, None]
    assert values(spark, ["< 1 year", "10+ years", "3 years", "n/a", None], C.parse_employment_years(x)) == [0.5, 10.0, 3.0, None, None]
    assert values(spark, [" ca", "bad", "C1", None], C.normalize_state(x)) == ["CA", None, None, None]
    assert values(spark, ["021XX ", "12", "12345"], C.normalize_zip(x)) == ["021xx", None, "12345"]
    assert values(spark, ["12.5%", "x%", "inf", "12d", "1e3"], C.parse_percent(x)) == [12.5, None, None, None, 1000.0]
    assert values(spark, ["", "null", "NULL", "n/a", "N/A", " a "], C.clean_string(x)) == [None, None, None, None, "N/A", "a"]


def test_rejected_needs_its_columns(spark):
    with pytest.raises(ValueError, match="State"):
        C.clean_rejected(spark.createDataFrame([("1",)], "`Amount Requested` string"))


def test_bands(spark):
    x = F.col("x")
    assert values(spark, [640.0, 650.0, 699.0, 700.0, 749.0, 750.0, None], X.band(x, X.FICO_BANDS, right=False), "double") == ["<650", "650-699", "650-699", "700-749", "700-749", "750+", None]
    assert values(spark, [5000.0, 5000.01, 10000.0, 20000.0, 20000.01, math.nan], X.band(x, X.LOAN_BANDS, right=True), "double") == ["<=5k", "5k-10k", "5k-10k", "10k-20k", ">20k", None]
    assert values(spark, [10.0, 10.01, 30.0, 30.01], X.band(x, X.DTI_BANDS, right=True), "double") == ["<=10", "10-20", "20-30", ">30"]


def test_features(spark):
    df = spark.sql("select 10000d loan_amnt, inc annual_inc, 5d dti, 680d fico_range_low, 684d fico_range_high, date'2018-01-01' issue_d, d earliest_cr_line from values (50000d, date'2008-01-01'), (0d, date'2019-01-01') t(inc, d)")
    a, b = X.engineer_features(df).orderBy(F.desc("annual_inc")).collect()
    assert (a.fico_avg, a.loan_to_income_ratio, a.credit_history_months, a.issue_quarter) == (682.0, 0.2, 120.0, "Q1")
    assert (b.loan_to_income_ratio, b.credit_history_months) == (None, None)


def test_scores_and_tiers(spark):
    x = F.col("x")
    assert values(spark, [0.0, 0.25, 0.5, 1.0], K.risk_score(x), "double") == [0, 25, 50, 100]
    assert values(spark, [0.0, 0.25, 0.5, 1.0], K.credit_score(x), "double") == [1000, 750, 500, 0]
    t = 0.22
    assert values(spark, [0.0, t / 2, t, 2 * t, 1.0], K.pd_tier(x, t), "double") == ["A", "B", "C", "D", "D"]
    assert values(spark, [1.0, 0.02, 0.95, 0.05, 0.22, math.nextafter(0.05, 0)], K.pd_bin(x), "double") == [20, 1, 20, 2, 5, 1]
    with pytest.raises(ValueError):
        K.pdo_score(x, pdo=0)
    with pytest.raises(ValueError):
        K.score_tier(x, [2, 1], ["a", "b", "c"])


def test_expected_loss_and_policy(spark):
    df = spark.sql("select * from values ('1',0,.1d),('2',1,.2d),('3',0,.3d),('4',1,.4d) t(loan_id,target,predicted_pd)").withColumn("loan_amnt", F.lit(1000.0))
    r = M.threshold_policy(df, 0.25, 0.5).first()
    assert (r.approved, r.rejected, r.defaults_approved, r.el_approved) == (2, 2, 1, pytest.approx(150))


def scored(spark, y, p):
    return spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(zip(y, p, strict=True))], "loan_id string, target int, predicted_pd double")


def test_perfect_classifier(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    r = E.confusion_metrics(df, 0.5).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.precision, r.recall, r.f1) == (2, 0, 0, 2, 1, 1, 1)
    m = E.ranking_metrics(E.score_histogram(df)).first()
    assert (m.roc_auc, m.average_precision) == (1, 1)


def test_best_threshold(spark):
    r = E.best_threshold(E.score_histogram(scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]))).first()
    assert r.threshold == 0.35 and r.f1 == pytest.approx(0.8)
    r = E.best_threshold(E.score_histogram(scored(spark, [1, 1, 0, 0, 0], [0.9, 0.8, 0.8, 0.8, 0.1]))).first()
    assert r.recall == 1 and r.threshold == 0.8 or r.threshold == 0.9


def test_percentiles(spark):
    ref, df = scored(spark, [0] * 4, [0.1, 0.2, 0.3, 0.4]), scored(spark, [0] * 6, [0.05, 0.1, 0.2, 0.25, 0.4, 0.5])
    assert [r.shown for r in E.percentile_index(df, ref).orderBy("predicted_pd").collect()] == [0, 25, 50, 50, 100, 100]


def test_prefix_sums_agree_over_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    rows = E.prefix_sums(df, "v", ["n"]).orderBy("v").collect()
    assert [r.cum_n for r in rows] == list(range(1, 1001)) and {r.total_n for r in rows} == {1000}


def test_split_covers_and_is_stratified(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("loan_id"), (F.col("id") % 4 == 0).cast("int").alias("target"))
    got = S.stratified_split(df)
    assert got.count() == 200 and got.select("loan_id").distinct().count() == 200
    assert {r.split: r.rows for r in S.split_audit(got).collect()} == {"train": 120, "validation": 40, "test": 40}
    assert all(r.within_tolerance for r in S.split_audit(got).collect())


def test_split_is_reused(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("loan_id"), (F.col("id") % 2).cast("int").alias("target"))
    one = S.reuse_or_create_split(df, f"{tmp_path}/split").collect()
    assert sorted(one) == sorted(S.reuse_or_create_split(df, f"{tmp_path}/split").collect())
    with pytest.raises(ValueError):
        S.reuse_or_create_split(df.limit(10), f"{tmp_path}/split")


def test_publish_set_is_all_or_nothing(spark, tmp_path):
    good, empty = spark.range(3).toDF("x"), spark.range(0).toDF("x")
    assert io.publish_set({"a": good}, str(tmp_path)) == {"a": 3}
    with pytest.raises(ValueError):
        io.publish_set({"a": spark.range(9).toDF("x"), "b": empty}, str(tmp_path))
    assert io.read_published(spark, str(tmp_path), "a").count() == 3 and not list(tmp_path.glob("versions/*/b"))


def test_lookup_and_tables(spark, tmp_path):
    df = spark.range(3).toDF("x")
    assert io.lookup(df, "x", 1) == {"x": 1}
    with pytest.raises(LookupError):
        io.lookup(df, "x", 9)
    io.export_samples({"t": df}, str(tmp_path), 2)
    raw = io.read_raw(spark, f"{tmp_path}/t", ["x"], ["x"])
    assert sorted(r.x for r in raw.collect()) == ["0", "1"]
    with pytest.raises(ValueError):
        P.project(df, ("loan_id", "x"))


def test_gates(spark):
    df = spark.sql("select * from values ('1',0,1d),('1',1,double('inf')),(null,2,1d) t(loan_id,target,x)")
    assert {r.check: r.observed for r in G.canonical_gate(df).collect()} == {"null keys": 1, "duplicate keys": 1, "targets not 0 or 1": 1, "infinite values": 1}
    with pytest.raises(ValueError):
        G.strict(G.grain_gate(df, "loan_id"))


def test_masking(spark):
    df = spark.range(99).select(F.lit("<650").alias("fico_band"), F.lit(1).alias("target"))
    rows = M.band_metrics(df, "fico_band", X.FICO_BANDS[1]).orderBy("sort_order").collect()
    assert (rows[0].loans, rows[0].default_rate, rows[0].masked) == (99, None, True) and (rows[1].loans, rows[1].masked) == (0, False)


def test_tree_contributions_add_up(spark, sf):
    from ledgerspark.sources.adapter import loans

    df = loans(spark, sf).filter("target is not null").drop("predicted_pd")
    m = D.fit(df, "trees", trees=3)
    some = S.stratified_sample(df, 60)
    got = {r.loan_id: r.expected + sum(r.phi) for r in D.tree_contributions(m, some).collect()}
    want = {r.loan_id: math.log(r.predicted_pd / (1 - r.predicted_pd)) for r in m.scored(some).collect()}
    assert len(got) > 50 and max(abs(got[k] - want[k]) for k in want) < 1e-3


def test_tree_queries_do_the_whole_job(spark, sf, monkeypatch):
    """Every labelled loan is explained, by a model of as many trees as the operator's default; 3 are fitted here to be quick."""
    import ledgerspark.plans.models  # noqa: F401  registers the queries
    from ledgerspark.plans.registry import QUERIES
    from ledgerspark.sources.adapter import loans

    real, asked = D.fit, []

    def fit(df, kind="logistic", **how):
        asked.append(how.pop("trees", 200))
        return real(df, kind, trees=3, **how)

    explained, real_contributions = [], D.tree_contributions
    monkeypatch.setattr(D, "fit", fit)
    monkeypatch.setattr(D, "tree_contributions", lambda m, df: explained.append(df.count()) or real_contributions(m, df))
    labelled = loans(spark, sf).filter("target is not null").count()
    assert QUERIES["tree_contributions"](spark, sf).count() == labelled
    for name in ("importance_join", "gain_importance", "fit_gbt"):
        assert not QUERIES[name](spark, sf).isEmpty()
    assert asked == [200] * 4 and explained == [labelled] * 2


def test_compact_models_of_both_kinds(spark, sf, monkeypatch):
    import ledgerspark.plans.models  # noqa: F401  registers the queries
    from ledgerspark.plans.registry import QUERIES

    real, asked = D.fit, []

    def fit(df, kind="logistic", **how):
        asked.append((kind, len(how["numbers"]) + len(how["categories"]), how.pop("trees", 200)))
        return real(df, kind, trees=3, **how)

    monkeypatch.setattr(D, "fit", fit)
    got = QUERIES["compact_model"](spark, sf).groupBy("inputs", "kind").count().collect()
    assert sorted(asked) == sorted((k, n, 200) for k in ("logistic", "trees") for n in (5, 6)) and len({r["count"] for r in got}) == 1 and len(got) == 4


def test_tree_contributions_equal_the_definition():
    """Against Shapley values over all subsets, with a feature that splits twice on a path."""
    from itertools import combinations

    tree = [[0, 1.0, 1, 4, 100.0, 0.0], [1, 0.5, 2, 3, 60.0, 0.0], [-1, 0, -1, -1, 25.0, 2.0], [-1, 0, -1, -1, 35.0, -1.0], [0, 2.0, 5, 6, 40.0, 0.0], [2, 0.0, 7, 8, 30.0, 0.0], [-1, 0, -1, -1, 10.0, 4.0], [-1, 0, -1, -1, 12.0, 1.0], [-1, 0, -1, -1, 18.0, -3.0]]

    def mean(at, row, known):
        f, threshold, left, right, cover, value = tree[at]
        if f < 0:
            return value
        if f in known:
            return mean(left if row[f] <= threshold else right, row, known)
        return sum(tree[k][4] / cover * mean(k, row, known) for k in (left, right))

    rows = [[a, b, c] for a in (0.0, 1.0, 1.5, 2.0, 3.0) for b in (0.0, 1.0) for c in (-1.0, 1.0)]
    phi, expected = D.path_contributions([[[*node[:5], 0.5 * node[5]] for node in tree]], D.np.array(rows))
    assert abs(expected - 0.5 * mean(0, rows[0], ())) < 1e-12
    for row, got in zip(rows, phi, strict=True):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum((mean(0, row, (*s, f)) - mean(0, row, s)) / (3 * math.comb(2, len(s))) for k in range(3) for s in combinations(rest, k))
            assert abs(got[f] - 0.5 * want) < 1e-12


def test_linear_contributions_add_up(spark, sf):
    from ledgerspark.sources.adapter import loans

    df = loans(spark, sf).filter("target is not null").drop("predicted_pd")
    m = D.fit(df)
    got = {r.loan_id: r.s for r in D.linear_contributions(m, df).groupBy("loan_id").agg(F.sum("contribution").alias("s")).collect()}
    want = {r.loan_id: r.m - m.fitted.stages[-1].intercept for r in m.transform(df).select("loan_id", D.vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_no_window_over_the_whole_table(spark, sf):
    """The prefix sums never order all rows in one task: the only single-partition windows are over parts."""
    from ledgerspark.sources.adapter import loans

    plan = E.at_scores(E.score_histogram(loans(spark, sf)))._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan and "windowspecdefinition(pd" not in plan


def test_funnel_stream(spark, tmp_path):
    from ledgerspark.streaming import funnel_counts

    rows = spark.sql("select date'2020-01-05' application_date, 'CA' state_code, 'accepted' decision, 10d requested_amount union all select date'2020-01-06', 'CA', 'accepted', 5d")
    rows.write.parquet(f"{tmp_path}/in")
    q = funnel_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("funnel_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.applications, r.requested_amount) for r in spark.table("funnel_test").collect()] == [(2, 15.0)]


def test_guards_of_joins(spark):
    """Each fault is refused: repeated or missing ids, other targets, scores out of range, a context that brings outcomes."""
    t = "loan_id string, target int, predicted_pd double"
    good = spark.createDataFrame([("1", 0, 0.1), ("2", 1, 0.9)], t)
    ids = good.select("loan_id", "target")
    assert P.align_predictions({"a": good, "b": good}, ids).count() == 2
    bad = [[("1", 0, 0.1)], [("1", 0, 0.1), ("2", 1, 0.9), ("3", 0, 0.5)], [("1", 1, 0.1), ("2", 1, 0.9)], [("1", 0, 1.1), ("2", 1, 0.9)], [("1", 0, 0.1), ("1", 0, 0.1)], [("1", 0, None), ("2", 1, 0.9)], [("1", None, 0.1), ("2", 1, 0.9)]]
    for rows in bad:
        with pytest.raises(ValueError):
            P.align_predictions({"a": spark.createDataFrame(rows, t)}, ids)
    canonical = spark.createDataFrame([("1", 0, 5.0), ("2", 1, 6.0), ("3", 0, 7.0)], "loan_id string, target int, dti double")
    assert P.partition_rows(canonical, ids, ["dti"]).count() == 2
    for rows in ([("1", 1)], [("9", 0)], [("1", 0), ("1", 0)]):
        with pytest.raises(ValueError):
            P.partition_rows(canonical, spark.createDataFrame(rows, "loan_id string, target int"), ["dti"])
    scored = good.withColumn("predicted_class", F.col("target"))
    context = canonical.select("loan_id", "dti")
    assert P.scored_context_join(scored, context, 0.5).select("risk_tier").distinct().count() == 2
    for predictions, more in ((scored.withColumn("predicted_class", F.lit(0)), context), (scored, context.filter("loan_id <> '2'")), (scored, context.withColumn("target", F.lit(1))), (scored, context.union(context))):
        with pytest.raises(ValueError):
            P.scored_context_join(predictions, more, 0.5)
    with pytest.raises(ValueError):
        P.project(context.union(context), ("loan_id", "dti"), strict=True)


def test_evaluated_fact_refuses_faults(spark):
    from ledgerspark.operators import marts as M

    scored = spark.createDataFrame([("1", 0, 0.1, 700.0, 1000.0, 5e4, 9.0, 0.02, "RENT", "car"), ("2", 1, 0.9, 650.0, 2000.0, 4e4, 8.0, 0.05, "OWN", "car")], "loan_id string, target int, predicted_pd double, fico_avg double, loan_amnt double, annual_inc double, dti double, loan_to_income_ratio double, home_ownership string, purpose string")
    scored = P.scored_context_join(scored.select("loan_id", "target", "predicted_pd", F.col("target").alias("predicted_class")), scored.drop("target", "predicted_pd"), 0.5)
    loss, fico = M.losses(scored), spark.createDataFrame([("1", "700-749"), ("2", None), ("3", "<650")], "loan_id string, fico_band string")
    fact = M.evaluated_fact(scored, loss, fico)
    assert tuple(fact.columns) == M.FACT and len(M.FACT) == 27
    rows = {r.loan_id: r for r in fact.collect()}
    assert (rows["1"].risk_tier, rows["1"].risk_tier_label, rows["1"].pd_bin_label, rows["2"].pd_bin_label) == ("A", "Tier A — Low", "0.10–<0.15", "0.90–<0.95")
    assert (rows["2"].fico_band, rows["2"].fico_band_sort_order, rows["2"].tier_sort_order, rows["1"].pd_bin_sort_order) == ("Missing", 5, 3, 3)
    faults = [
        (scored, loss.filter("loan_id = '1'"), fico), (scored, loss, fico.filter("loan_id = '1'")), (scored, loss.withColumn("loan_amnt", F.lit(1.0)), fico), (scored, loss.withColumn("expected_loss", F.lit(7.0)), fico),
        (scored.withColumn("risk_tier", F.lit("A")), loss.withColumn("risk_tier", F.lit("A")), fico), (scored.union(scored), loss, fico), (scored, loss, fico.withColumn("fico_band", F.lit("high"))), (scored.drop("dti"), loss, fico),
    ]
    for fault in faults:
        with pytest.raises(ValueError):
            M.evaluated_fact(*fault)


def test_candidate_choice_follows_complexity_before_loss(spark):
    def chosen(*rows):
        return E.select_candidate(spark.createDataFrame([(m, *map(float, r)) for m, *r in rows], "model string, roc_auc double, average_precision double, log_loss double, brier double")).first()[0]

    a, b, c = "logistic_baseline", "logistic_weighted", "xgboost_candidate"
    assert chosen((a, 0.7, 0.3, 0.5, 0.2), (b, 0.699, 0.3, 0.6, 0.2), (c, 0.7, 0.3, 0.1, 0.1)) == a
    assert chosen((a, 0.7, 0.3, 0.5, 0.2), (b, 0.699, 0.3, 0.4, 0.2), (c, 0.7, 0.3, 0.1, 0.1)) == b
    assert chosen((a, 0.7, 0.3, 0.5, 0.2), (b, 0.7, 0.3, 0.5, 0.2), (c, 0.71, 0.3, 0.9, 0.9)) == c
    assert chosen((a, 0.7, 0.2, 0.5, 0.2), (b, 0.7, 0.2, 0.5, 0.2), (c, 0.7, 0.3, 0.9, 0.9)) == c
    assert chosen((a, 0.7, 0.3, 0.5, 0.2), (b, 0.7, 0.3, 0.5, 0.2), (c, 0.7, 0.3, 0.5, 0.2)) == a


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500), rng.integers(0, 5, 300)])
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)] + [(0, None), (1, float("nan")), (7, 2.5)], "g int, v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {r.g: r.q for r in E.exact_quantiles(df, "v", shares, ["g"]).collect()}
    assert all(np.allclose(got[g], np.quantile(x[np.arange(len(x)) % 3 == g], shares)) for g in range(3)) and set(got[7]) == {2.5}
    assert np.allclose(E.exact_quantiles(df, "v", shares).first().q, np.quantile(np.append(x, 2.5), shares))
    assert "percentile(" not in E.exact_quantiles(df, "v", shares)._jdf.queryExecution().toString()


def test_direction_guards(spark):
    df = spark.createDataFrame([(str(i), float(i), float(i) / 2, 1.0, float(i % 2)) for i in range(40)], "loan_id string, f double, up double, flat double, two double")
    said = lambda f, c, d=df: E.direction_summary(d, f, c).first()
    assert said("f", "up").direction == "rising" and abs(said("f", "up").rho - 1) < 1e-9
    assert said("f", "flat").direction == said("two", "up").direction == said("f", "up", df.limit(29)).direction == "insufficient"


def test_split_audit_finds_faults(spark):
    split = spark.createDataFrame([("1", 0, "train"), ("1", 0, "test"), ("2", 1, "train"), ("9", 1, "test")], "loan_id string, target int, split string")
    rows = {r.split: r for r in S.split_audit(split, spark.createDataFrame([("1",), ("2",), ("3",)], "loan_id string")).collect()}
    assert (rows["train"].overlap, rows["test"].overlap, rows["test"].unknown, rows["train"].unknown, rows["test"].lost) == (1, 1, 1, 0, 1)


def test_reference_refuses_test_ids(spark):
    long = spark.createDataFrame([("a", "1", 0.1), ("a", "2", 0.3), ("a", "3", 0.3)], "model string, loan_id string, pd double")
    got = E.reference_distribution(long, spark.createDataFrame([("7",)], "loan_id string"))
    assert E.reference_summary(got).first() == ("a", 3, 0.1, 0.3, 0.3)
    for rows, ids in ((long, [("2",)]), (long.limit(1), [("7",)]), (long.withColumn("pd", F.lit(2.0)), [("7",)])):
        with pytest.raises(ValueError):
            E.reference_distribution(rows, spark.createDataFrame(ids, "loan_id string"))


def test_policy_classes():
    from ledgerspark.operators import policy as Y

    assert len(Y.CREDIT) == 85 and len(Y.POST_LOAN) == 19 and len(Y.BORROWER) == 13
    assert [Y.policy_class(c) for c in ("emp_title", "addr_state", "zip_code", "hardship_x", "settlement_term", "debt_settlement_flag_date", "foo", "fico_avg", "int_rate", "member_id", "target", "loan_status")] == [
        "TEXT_HIGH_CARDINALITY", "GEOGRAPHY_ANALYTICS", "GEOGRAPHY_ANALYTICS", "POST_LOAN", "POST_LOAN", "POST_LOAN", "UNKNOWN_REVIEW_REQUIRED", "CREDIT_SNAPSHOT", "POLICY_DERIVED", "IDENTIFIER",
        "ANALYTICS_ONLY", "TARGET_SOURCE",
    ]


def test_cleaning_of_what_the_file_has(spark):
    raw = spark.createDataFrame([("7.0", "Fully Paid", "\u00a01e3\t", "12.5%", "Jan-2018", " 36 months", "n/a", "ny\u2003", "x")], "id string, loan_status string, revol_bal string, revol_util string, last_pymnt_d string, term string, emp_length string, addr_state string, other string")
    r = C.clean_accepted(raw).first().asDict()
    assert (r["loan_id"], r["target"], r["revol_bal"], r["revol_util"], str(r["last_pymnt_d"]), r["term_months"], r["term"], r["emp_length"], r["emp_length_years"], r["state_code"], r["addr_state"], r["country"], r["other"]) == (
        "7", 0, 1000.0, 12.5, "2018-01-01", 36, "36 months", None, None, "NY", "ny", "United States", "x",
    )
    for missing in ("id", "loan_status"):
        with pytest.raises(ValueError):
            C.clean_accepted(raw.drop(missing))


def test_funnel_ids_of_equal_applications(spark, monkeypatch):
    monkeypatch.setattr(P, "EQUALS", 3)
    t = "requested_amount double, application_date date, loan_title string, zip_code string, state_code string"
    rows = [(1.0, None, "a", None, "NY")] * 10 + [(1.0, None, None, "a", "NY")] * 2 + [(None, None, None, None, None)]
    accepted = spark.createDataFrame([("5", None, 2.0, "NY", "1", "car")], "loan_id string, issue_d date, loan_amnt double, state_code string, zip_code string, purpose string")
    got = P.application_funnel(accepted, spark.createDataFrame(rows, t)).collect()
    assert len(got) == 14 and len({r.application_id for r in got}) == 14 and sum(r.purpose == "a" for r in got) == 10


def test_publish_replaces_when_complete(spark, tmp_path):
    from ledgerspark.sources import io as IO

    path = str(tmp_path / "t")
    IO.publish(spark.range(3), path)
    IO.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        IO.publish(broken, path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
