"""Cases outside the driver's tables: gates, digests, splits and publishing must not let faults through."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning as C
from ledgerspark.functions import features as X
from ledgerspark.operators import evaluation as E
from ledgerspark.operators import gates as G
from ledgerspark.operators import marts as M
from ledgerspark.operators import sampling as S
from ledgerspark.operators import tables as P
from ledgerspark.sources import io as IO

LOSS = "expected_loss double, predicted_pd double, loan_amnt double, el_lgd_30 double, el_lgd_45 double, el_lgd_60 double, tier string, predicted_class int"
SOUND = (4.5, 0.1, 100.0, 3.0, 4.5, 6.0, "A", 0)


def failed(gate):
    return {r.check for r in gate.collect() if not r.passed}


@pytest.mark.parametrize("place,checks", [(0, {"EL = PD x LGD x EAD", "0 <= EL <= EAD"}), (1, {"EL = PD x LGD x EAD"}), (2, {"EL = PD x LGD x EAD", "0 <= EL <= EAD"}), (3, {"monotone in LGD"}), (5, {"monotone in LGD"})])
@pytest.mark.parametrize("value", [None, float("nan")])
def test_losses_that_are_not_there_fail(spark, place, checks, value):
    assert failed(G.el_reconciliation(spark.createDataFrame([SOUND], LOSS))) == set()
    bad = spark.createDataFrame([SOUND, (*SOUND[:place], value, *SOUND[place + 1 :])], LOSS)
    assert failed(G.el_reconciliation(bad)) == checks
    with pytest.raises(ValueError, match="failed"):
        G.strict(G.el_reconciliation(bad))


def test_classes_metrics_and_totals_that_are_not_there_fail(spark):
    rows = lambda c, p: spark.createDataFrame([(0.9, 1), (p, c)], "predicted_pd double, predicted_class int")
    assert failed(G.probability_gate(rows(0, 0.1), 0.5)) == set()
    assert failed(G.probability_gate(rows(None, 0.1), 0.5)) == {"class matches threshold"}
    assert failed(G.probability_gate(rows(0, None), 0.5)) == {"probabilities in [0, 1]", "class matches threshold"}
    a, b = (spark.createDataFrame([(0.5, x)], "auc double, ap double") for x in (0.4, None))
    assert failed(G.metric_match(a, a, ["auc", "ap"])) == set() and failed(G.metric_match(a, b, ["auc", "ap"])) == {"ap"} == failed(G.metric_match(b, b, ["auc", "ap"]))
    losses = spark.createDataFrame([(None, 0.1, 100.0, 3.0, 4.5, 6.0, "A", 0)], LOSS)
    gate = G.control_totals(losses, "tier", spark.createDataFrame([("A", 1)], "label string, n long"), el=4.5)
    assert failed(gate) == {"total expected loss"} and all(r.passed is not None for r in gate.collect())
    with pytest.raises(ValueError, match="unsaid"):
        G.strict(spark.createDataFrame([("unsaid", None)], "check string, passed boolean"))


def test_digest_tells_places_nulls_names_and_types(spark):
    one = lambda rows, schema="a long, b long": IO.fingerprint(spark.createDataFrame(rows, schema)).first()["digest"]
    seen = [one(r) for r in ([(None, 1)], [(1, None)], [(1, 1)], [(1, 1), (1, 1)], [(None, None)], [], [(1, 2), (3, 4)], [(1, 4), (3, 2)])] + [one([(1, 1)], "a long, c long"), one([(1, 1)], "a int, b long")]
    assert len(set(seen)) == len(seen)
    assert one([(1, 2), (3, 4), (5, None)]) == one([(5, None), (1, 2), (3, 4)])
    a = spark.range(5000).select("id", (F.col("id") * 7).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 1234, F.lit(None)).otherwise(F.col("v"))).filter("id <> 77")
    assert IO.differing_ranges(a, a, "id").count() == 0
    got = {r.range: (r.rows_a, r.rows_b) for r in IO.differing_ranges(a, b, "id").collect()}
    at = {r.id: r.p for r in a.filter("id in (1234, 77)").select("id", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int").alias("p")).collect()}
    assert set(got) == set(at.values()) and sum(x - y for x, y in got.values()) == 1


def test_splits_of_ids_of_any_kind(spark):
    rng = random.Random(3)
    ids = [f"a{i}" for i in range(300)] + [str(9_000_000_000_000_000_000 + i) for i in range(300)] + [f"é-{i}" for i in range(200)]
    df = spark.createDataFrame([(i, rng.randint(0, 1)) for i in ids], "loan_id string, target int")
    got = S.stratified_split(df)
    assert got.count() == 800 == got.select("loan_id").distinct().count()
    assert sorted(got.collect()) == sorted(S.stratified_split(df.repartition(7)).collect())
    sizes = {(r.split, r.target): r.n for r in S.class_counts(got).collect()}
    for t, n in {r.target: r["count"] for r in df.groupBy("target").count().collect()}.items():
        assert sizes["train", t] == int(n * 0.6) and sizes["train", t] + sizes["validation", t] == int(n * 0.8)
    assert abs(S.stratified_sample(df, 100).count() - 100) <= 2 and S.stratified_folds(df, 4).groupBy("fold").count().count() == 4
    assert [r.loan_id for r in S.first_n(spark.createDataFrame([("b",), ("10",), ("9",), ("a",)], "loan_id string"), 3).collect()] == ["9", "10", "a"]


def test_a_split_that_was_not_finished_or_is_not_sound_is_no_split(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").cast("string").alias("loan_id"), (F.col("id") % 3 == 0).cast("int").alias("target"))
    broken = df.withColumn("target", F.when(F.col("loan_id") == "7", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("target")))
    with pytest.raises(Exception, match="lost"):
        S.reuse_or_create_split(broken, f"{tmp_path}/s")
    assert not (tmp_path / "s").exists()
    first = sorted(S.reuse_or_create_split(df, f"{tmp_path}/s").collect())
    assert sorted(S.reuse_or_create_split(df, f"{tmp_path}/s", seed=1).collect()) == first
    skewed = S.stratified_split(df).withColumn("split", F.when(F.col("target") == 1, "test").otherwise(F.col("split")))
    IO.publish(skewed, f"{tmp_path}/skewed")
    with pytest.raises(ValueError, match="audit"):
        S.reuse_or_create_split(df, f"{tmp_path}/skewed")


def test_a_set_is_published_at_one_moment(spark, tmp_path, monkeypatch):
    """The driver may end after any step: readers see the old set or the new one, whole."""
    folder = str(tmp_path)
    tables = lambda k: {n: spark.range(k).select(F.lit(k).cast("int").alias("v")) for n in ("a", "b")}
    seen = lambda: {IO.read_published(spark, folder, n).first()["v"] for n in ("a", "b")}
    with pytest.raises(FileNotFoundError):
        IO.read_published(spark, folder, "a")
    assert IO.publish_set(tables(2), folder) == {"a": 2, "b": 2} and seen() == {2}

    class Ended(BaseException):
        pass

    def ends(*_):
        raise Ended

    with monkeypatch.context() as m:  # all is written, the pointer isn't moved
        m.setattr(IO, "_point", ends)
        with pytest.raises(Ended):
            IO.publish_set(tables(3), folder)
    assert seen() == {2}
    half = {"a": tables(4)["a"], "b": tables(4)["b"].withColumn("v", F.raise_error(F.lit("x")).cast("int"))}
    with pytest.raises(Exception):  # noqa: B017
        IO.publish_set(half, folder)
    assert seen() == {2}
    for k in (5, 6, 7):
        IO.publish_set(tables(k), folder)
        assert seen() == {k}
    assert len(list(tmp_path.glob("versions/*"))) == 2
    wider = {n: df.select(F.col("v").cast("long").alias("v"), F.lit(1).alias("more")) for n, df in tables(8).items()}
    IO.publish_set(wider, folder)
    assert IO.read_published(spark, folder, "a").dtypes == [("v", "int")]
    with pytest.raises(Exception):  # noqa: B017
        IO.publish_set({n: df.select(F.lit("x").alias("w")) for n, df in tables(9).items()}, folder)
    assert seen() == {8}


def test_publish_casts_to_a_schema(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([StructField("s", StringType()), StructField("n", IntegerType())])
    IO.publish(spark.range(3).select(F.col("id").alias("n"), F.lit("x").alias("s")), f"{tmp_path}/t", schema)
    assert spark.read.parquet(f"{tmp_path}/t").dtypes == [("s", "string"), ("n", "int")]
    with pytest.raises(Exception):  # noqa: B017
        IO.publish(spark.range(3).toDF("n"), f"{tmp_path}/t", StructType([StructField("s", StringType(), False)]))


def test_raw_files_are_cut(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,said\n" + "".join(f'{i:06d},"a ""b"" {i}"\n' for i in range(60_000)))
    (tmp_path / "u.csv").write_text('id,said\n01,"two\nlines"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = IO.read_raw(spark, f"{tmp_path}/t.csv", ["id", "said"])
        assert got.rdd.getNumPartitions() > 3 and got.count() == 60_000 and got.filter("id = '000007'").first().said == 'a "b" 7'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert IO.read_raw(spark, f"{tmp_path}/u.csv", ["id", "said"], line_breaks=True).first().said == "two\nlines"


def test_infinities(spark):
    df = spark.createDataFrame([("1e400",), ("-1e999",), ("1e3",), ("inf",)], "x string")
    assert [r[0] for r in df.select(C.to_number(F.col("x"))).collect()] == [None, None, 1000.0, None]
    raw = spark.createDataFrame([("1", "Fully Paid", "1e400", "1e309%")], "id string, loan_status string, annual_inc string, int_rate string")
    assert C.clean_accepted(raw).select("annual_inc", "int_rate").first() == (None, None)
    names = list(C.REJECTED_NAMES)
    row = dict.fromkeys(names, "1e400")
    assert C.clean_rejected(spark.createDataFrame([tuple(row.values())], names)).select("requested_amount", "risk_score", "dti").first() == (None, None, None)
    needed = "loan_amnt double, annual_inc double, fico_range_low double, fico_range_high double, dti double, issue_d date, earliest_cr_line date"
    for k in range(5):
        values = [1.0, 2.0, 600.0, 604.0, 3.0]
        values[k] = float("inf")
        with pytest.raises(Exception, match="is infinite"):
            X.engineer_features(spark.createDataFrame([(*values, None, None)], needed)).collect()


def jobs(spark, run):
    """Jobs that a call runs, by their group."""
    sc = spark.sparkContext
    group = f"counted {random.random()}"
    sc.setJobGroup(group, "")
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    found = len(sc.statusTracker().getJobIdsForGroup(group))
    sc._jsc.clearJobGroup()
    return found


def test_guards_take_one_pass(spark, sf):
    from ledgerspark.sources.adapter import loans

    df = loans(spark, sf).filter("target is not null")
    good = df.select("loan_id", "target", "predicted_pd")
    scored = good.withColumn("predicted_class", (F.col("predicted_pd") >= 0.35).cast("int"))
    context = X.engineer_features(df).select("loan_id", "purpose", "home_ownership", "fico_avg", "loan_amnt", "annual_inc", "dti", "loan_to_income_ratio")
    full = P.scored_context_join(scored, context, 0.35)
    bands = X.engineer_features(df).select("loan_id", "fico_band")
    calls = {
        "canonical": lambda: P.canonical_join(good, good, good, good, strict=True), "partition": lambda: P.partition_rows(df, good, ["dti"]), "context": lambda: P.scored_context_join(scored, context, 0.35),
        "align": lambda: P.align_predictions({"a": good, "b": good, "c": good}, good), "fact": lambda: M.evaluated_fact(full, M.losses(full), bands),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # each stage is a job of its own where plans adapt
    try:
        took = {k: jobs(spark, run) for k, run in calls.items()}
        assert max(took.values()) <= 2, took  # the pass, and the broadcast below the loans
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_guards_name_what_is_wrong(spark):
    good = spark.createDataFrame([("1", 0, 0.1), ("2", 1, 0.9)], "loan_id string, target int, predicted_pd double")
    with pytest.raises(ValueError, match="b lacks ids of ids .1 ids, such as 2"):
        P.align_predictions({"a": good, "b": good.filter("loan_id = '1'")}, good.select("loan_id", "target"))
    with pytest.raises(ValueError, match="credit: loan_id isn't a key .1 ids, such as null"):
        P.canonical_join(good, good, good.union(spark.createDataFrame([(None, 1, 0.5)], good.schema)), good, strict=True)


def test_ordered_sums_run_no_job_of_their_own(spark, sf):
    from ledgerspark.sources.adapter import loans

    df = loans(spark, sf).filter("target is not null")
    assert jobs(spark, lambda: E.direction_summary(df.select("loan_id", "dti", "predicted_pd"), "dti", "predicted_pd")) == 0
    assert jobs(spark, lambda: E.at_scores(E.score_histogram(df))) == 0
    E.best_threshold(E.score_histogram(df)).collect()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


@pytest.mark.parametrize("rows", [0, 1, 5, 3000])
def test_ordered_sums_with_many_parts(spark, monkeypatch, rows):
    monkeypatch.setattr(E, "ROWS", 10)
    rng = random.Random(rows)
    data = [(f"g{rng.randint(0, 2)}", float(v), rng.randint(0, 9)) for v in rng.sample(range(100_000), rows)]
    got = E.prefix_sums(spark.createDataFrame(data, "g string, v double, n long"), "v", ["n"], ["g"]).collect()
    for r in got:
        assert r.cum_n == sum(n for g, v, n in data if g == r.g and v <= r.v) and r.total_n == sum(n for g, _, n in data if g == r.g)
    assert len(got) == rows


def test_lookup_reads_few_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.xxhash64("id")).alias("k"), (F.col("id") * 3).alias("v"))
    IO.publish(rows, f"{tmp_path}/t", key="k")
    got = spark.read.parquet(f"{tmp_path}/t")
    key = rows.filter("v = 2997").first().k
    assert IO.lookup(got, "k", key) == {"k": key, "v": 2997}
    hit = got.filter(F.col("k") == key)
    hit.collect()
    assert f"EqualTo(k,{key})" in hit._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(f"{tmp_path}/t").select(F.input_file_name()).distinct().count() > 1
    ends = got.groupBy(F.input_file_name()).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:]))  # noqa: B905  files hold ranges of the key


def test_wide_profile_copies_no_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "SET", 40)
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randint(0, 30), None if i % 3 else float(i % 7) * -0.0, f"s{i % 500}") for i in range(2000)], "id long, `few values` int, zero double, `a:b` string")
    wide = df.select("*", *[F.col("id").alias(f"c{i}") for i in range(60)])
    plan = P.column_profile(wide, exact=())
    assert "Expand" not in plan._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]  # but of the one row of results
    got = {r.column_name: (r.nulls, r.distinct_values) for r in plan.collect()}
    assert got["few values"] == (0, 31) and got["zero"] == (1333, 1) and abs(got["id"][1] - 2000) < 200
    got = {r.column_name: (r.nulls, r.distinct_values) for r in P.column_profile(df).collect()}
    assert got == {"id": (0, 2000), "few values": (0, 31), "zero": (1333, 1), "a:b": (0, 500)}
