"""Portfolio aggregates, risk summaries and dashboard measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import scoring as K
from ..functions.cleaning import derive_target
from .evaluation import exact_quantiles
from .tables import Meeting, share, unsound_scores

#: Groups smaller than this show no rate.
SPARSE = 100


def default_rate_by(df: DataFrame, by: str) -> DataFrame:
    return df.filter(F.col(by).isNotNull() & F.col("target").isNotNull()).groupBy(by).agg(F.count("*").alias("loans"), F.avg("target").alias("default_rate")).orderBy(F.desc("loans"), by)


def with_order(df: DataFrame, by: str, labels: list[str]) -> DataFrame:
    """All labels in their order, with what df has for them."""
    frame = df.sparkSession.createDataFrame(list(enumerate(labels, 1)), f"sort_order int, {by} string")
    return frame.join(df, by, "left")


def band_metrics(df: DataFrame, by: str, labels: list[str], least: int = SPARSE) -> DataFrame:
    """sort_order, label, loans (0 if none), defaults, default_rate (null if none or masked), masked."""
    got = with_order(df.filter("target is not null").groupBy(by).agg(F.count("*").alias("n"), F.sum("target").alias("d")), by, labels)
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))
    return got.select("sort_order", by, n.alias("loans"), d.alias("defaults"), F.when(n >= least, d / F.nullif(n, F.lit(0))).alias("default_rate"), ((n > 0) & (n < least)).alias("masked"))


def box_stats(df: DataFrame, by: str, value: str, cap: float = 0.99) -> DataFrame:
    """Quartiles and whiskers at 1.5 interquartile ranges of the values up to a quantile of all; exact quantiles from running counts."""
    sound = df.filter((F.col(value) >= 0) & ~F.isnan(value)).select(by, value)
    top = exact_quantiles(sound, value, [cap]).select(F.col("q")[0].alias("cap"))
    got = sound.filter(F.col(by).isNotNull()).crossJoin(F.broadcast(top)).filter(F.col(value) <= F.col("cap"))
    q = exact_quantiles(got, value, [0.25, 0.5, 0.75], [by]).select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    edge = F.broadcast(q.select(F.col(by).alias("k"), "q1", "q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    w = got.join(edge, got[by] == edge["k"]).groupBy(by).agg(F.count("*").alias("n"), F.max("cap").alias("cap"), F.min(inside).alias("low_whisker"), F.max(inside).alias("high_whisker"))
    return q.join(w, by)


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal widths from the least to the greatest value, the last bin closed; one scan for the ends and one to count."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return x.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(F.col("lo") + at * width).alias("left"))


def risk_tier_summary(df: DataFrame, threshold: float) -> DataFrame:
    t = df.withColumn("tier", K.pd_tier(F.col("predicted_pd"), threshold))
    got = t.groupBy("tier").agg(F.count("*").alias("loans"), F.min("predicted_pd").alias("min_pd"), F.max("predicted_pd").alias("max_pd"), F.avg("predicted_pd").alias("mean_pd"), F.sum("target").alias("defaults"), F.avg("target").alias("observed_rate"))
    median = exact_quantiles(t, "predicted_pd", [0.5], ["tier"]).select("tier", F.col("q")[0].alias("median_pd"))
    got = got.join(median, "tier", "left").withColumn("share", share(F.col("loans")))
    return with_order(got, "tier", list(K.TIERS)).withColumns({"loans": F.coalesce("loans", F.lit(0)), "defaults": F.coalesce("defaults", F.lit(0)), "share": F.coalesce("share", F.lit(0.0))})


def score_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a variable; the exact quantiles of all come from one set of running counts."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "v")
    got = long.groupBy("variable").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    names = ("p10", "p25", "median", "p75", "p90")
    q = exact_quantiles(long, "v", [0.1, 0.25, 0.5, 0.75, 0.9], ["variable"]).select("variable", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    return got.join(q, "variable", "left").select("variable", "n", "mean", "std", "min", *names, "max")


def el_portfolio(df: DataFrame) -> DataFrame:
    el, ead = F.col("expected_loss"), F.col("loan_amnt")
    got = df.agg(F.count("*").alias("loans"), F.sum(ead).alias("ead"), F.sum(el).alias("el"), F.avg(el).alias("mean_el"), (F.sum(el) / F.nullif(F.sum(ead), F.lit(0.0))).alias("el_rate"), (F.sum(F.col("predicted_pd") * ead) / F.nullif(F.sum(ead), F.lit(0.0))).alias("weighted_pd"))
    return got.crossJoin(F.broadcast(exact_quantiles(df, "expected_loss", [0.5]).select(F.col("q")[0].alias("median_el")))).select("loans", "ead", "el", "mean_el", "median_el", "el_rate", "weighted_pd")


def el_by(df: DataFrame, by: str) -> DataFrame:
    got = df.groupBy(by).agg(F.count("*").alias("loans"), F.sum("loan_amnt").alias("ead"), F.sum("expected_loss").alias("el"), F.avg("predicted_pd").alias("mean_pd"), F.avg("expected_loss").alias("mean_el"), F.avg("target").alias("observed_rate"))
    return got.withColumns({f"{c}_share": share(F.col(c)) for c in ("loans", "ead", "el")})


def el_sensitivity(df: DataFrame, lgds: tuple[float, ...] = K.LGDS) -> DataFrame:
    """Total expected loss per LGD: one sum, scaled, as the loss is linear in it."""
    return df.agg(F.sum(F.col("predicted_pd") * F.col("loan_amnt")).alias("x")).select(F.explode(F.array(*map(F.lit, lgds))).alias("lgd"), "x").select("lgd", (F.col("lgd") * F.col("x")).alias("total_el"))


def threshold_policy(df: DataFrame, threshold: float, lgd: float = K.BASE_LGD) -> DataFrame:
    yes = F.col("predicted_pd") < threshold
    return df.agg(F.sum(yes.cast("long")).alias("approved"), F.sum((~yes).cast("long")).alias("rejected"), F.sum(F.when(yes, F.col("target")).otherwise(0)).alias("defaults_approved"), F.sum(F.when(yes, K.expected_loss(F.col("predicted_pd"), lgd, F.col("loan_amnt"))).otherwise(0.0)).alias("el_approved"))


def scored_fact(df: DataFrame, threshold: float) -> DataFrame:
    """Scored loans with losses, bins, tiers and their orders, as one projection."""
    p = F.col("predicted_pd")
    tier = K.pd_tier(p, threshold)
    return K.expected_loss_dataset(df).withColumns({
        "risk_score": K.risk_score(p), "credit_score": K.credit_score(p), "tier": tier, "tier_order": K.tier_order(tier), "predicted_class": K.flag_default(p, threshold),
        "pd_bin": K.pd_bin(p), "pd_bin_lower": (K.pd_bin(p) - 1) / 20, "fico_label": F.coalesce("fico_band", F.lit("Missing")), "fico_order": K.fico_order(F.col("fico_band")),
    })


# Fixed columns of the fact and of what it is joined from.
SCORES = ("loan_id", "target", "predicted_pd", "predicted_class", "risk_score", "credit_score", "risk_tier", "fico_avg", "loan_amnt", "annual_inc", "dti", "loan_to_income_ratio", "home_ownership", "purpose")
LOSSES = ("loan_id", "target", "predicted_pd", "risk_score", "credit_score", "risk_tier", "loan_amnt", "ead_proxy", "expected_loss", "expected_loss_rate", "expected_loss_lgd_30", "expected_loss_lgd_45", "expected_loss_lgd_60")
FACT = (
    "loan_id", "target", "predicted_pd", "predicted_class", "risk_score", "credit_score", "risk_tier", "risk_tier_label", "tier_sort_order", "fico_avg", "fico_band", "fico_band_sort_order",
    "loan_amnt", "annual_inc", "dti", "loan_to_income_ratio", "home_ownership", "purpose", "ead_proxy", "expected_loss", "expected_loss_rate", "expected_loss_lgd_30", "expected_loss_lgd_45",
    "expected_loss_lgd_60", "pd_bin", "pd_bin_label", "pd_bin_sort_order",
)
_BOTH = ("target", "predicted_pd", "risk_score", "credit_score", "risk_tier", "loan_amnt")


def losses(scores: DataFrame) -> DataFrame:
    """The loss side of scored loans: exposure, loss at the base LGD and at each of the others."""
    got = K.expected_loss_dataset(scores)
    return got.withColumns({"ead_proxy": F.col("loan_amnt")}).withColumnsRenamed({"el_rate": "expected_loss_rate"} | {f"el_lgd_{k}": f"expected_loss_lgd_{k}" for k in (30, 45, 60)}).select(*LOSSES)


def evaluated_fact(scores: DataFrame, loss: DataFrame, fico: DataFrame) -> DataFrame:
    """Grain loan, 27 columns in order of loan_id: scores (risk_tier as its long label), losses and FICO bands joined one to one.

    Raises unless ids are keys and the same on both sides, every loan has a band row, what both sides carry is equal, and
    targets, probabilities, tiers, bands and amounts are of their range; all of it in one pass over the three sides.
    """
    for name, df, columns in (("scores", scores, SCORES), ("losses", loss, LOSSES), ("FICO bands", fico, ("loan_id", "fico_band"))):
        if missing := sorted(set(columns).difference(df.columns)):
            raise ValueError(f"{name} lack {missing}")
    amounts = ("expected_loss", "expected_loss_rate", "expected_loss_lgd_30", "expected_loss_lgd_45", "expected_loss_lgd_60", "ead_proxy")
    finite = lambda *cs: reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in cs])
    odd_scores = unsound_scores() | ~(K.tier_code(F.col("risk_tier")).isNotNull() & F.coalesce(F.col("predicted_class").isin(0, 1), F.lit(False)) & finite("risk_score", "credit_score", "loan_amnt"))
    odd_losses = ~(finite(*amounts) & (F.col("expected_loss") == F.col("expected_loss_lgd_45")) & (F.col("ead_proxy") == F.col("loan_amnt")))
    band = F.coalesce("fico_band", F.lit("Missing"))
    met = Meeting().side("scores", scores, odd_scores, _BOTH).side("losses", loss, odd_losses, _BOTH).side("FICO bands", fico, ~band.isin(*X.FICO_BANDS[1], "Missing"))
    met.sound("scores", "values out of range").sound("losses", "amounts out of range").sound("FICO bands", "an unknown band", among="scores")
    met.covers("scores", "losses").covers("losses", "scores").covers("scores", "FICO bands").equal("scores", "losses", _BOTH).require()
    got = scores.select(*SCORES).join(loss.select("loan_id", *amounts), "loan_id").join(fico.select("loan_id", "fico_band"), "loan_id")
    code, bin_no = K.tier_code(F.col("risk_tier")), K.pd_bin(F.col("predicted_pd"))
    made = {
        "risk_tier_label": F.col("risk_tier"), "tier_sort_order": K.tier_order(code), "fico_band_sort_order": K.fico_order(F.col("fico_band")), "pd_bin_sort_order": bin_no,
        "pd_bin": (bin_no - 1) / 20, "pd_bin_label": K.pd_bin_label(bin_no), "risk_tier": code, "fico_band": band,
    }
    return got.withColumns(made).select(*FACT).orderBy("loan_id")


def fact_measures(fact: DataFrame, by: str) -> DataFrame:
    risky = F.col("tier").isin("C", "D")
    got = fact.groupBy(by).agg(
        F.count("*").alias("loans"), F.avg("predicted_pd").alias("mean_pd"), F.sum("target").alias("defaults"), F.avg("target").alias("default_rate"),
        F.sum("loan_amnt").alias("ead"), F.sum("expected_loss").alias("el"), F.avg("expected_loss").alias("mean_el"), F.sum(risky.cast("long")).alias("high_risk"),
    )
    median = exact_quantiles(fact, "predicted_pd", [0.5], [by]).select(F.col(by).alias("_by"), F.col("q")[0].alias("median_pd"))
    got = got.join(median, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return got.withColumns({"loan_share": share(F.col("loans")), "el_rate": F.col("el") / F.nullif(F.col("ead"), F.lit(0.0)), "el_contribution": share(F.col("el")), "high_risk_share": F.col("high_risk") / F.col("loans")})


def quartiles_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, q1, median, q3, mean."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], [by]).select(F.col(by).alias("_by"), *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    got = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return got.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "q1", "median", "q3", "mean")


def status_counts(df: DataFrame) -> DataFrame:
    """Rows per status, null as <NA>."""
    return df.groupBy(F.coalesce("loan_status", F.lit("<NA>")).alias("loan_status")).agg(F.count("*").alias("n"))


def target_audit(df: DataFrame) -> DataFrame:
    return df.groupBy("loan_status").agg(F.count("*").alias("n")).withColumn("mapped_target", derive_target(F.col("loan_status")))


def cleaning_audit(cleaned: DataFrame) -> DataFrame:
    n = F.count("*")
    return cleaned.agg(n.alias("rows"), F.count_if(F.col("target").isNull()).alias("unresolved"), F.count("state_code").alias("states"), F.count("zip_code").alias("zips"), (F.count("state_code") / F.nullif(n, F.lit(0))).alias("state_coverage"))


def canonical_audit(df: DataFrame) -> DataFrame:
    n, ids = F.count("*"), F.countDistinct("loan_id")
    return df.agg(n.alias("joined"), F.count("target").alias("labeled"), (n - F.count("target")).alias("unresolved"), ids.alias("unique_ids"), (n - ids).alias("duplicate_ids"), (n - F.count("loan_id")).alias("null_ids"), F.count_if(F.col("target") == 0).alias("paid"), F.count_if(F.col("target") == 1).alias("defaulted"))


def scan_audit(df: DataFrame) -> DataFrame:
    """One pass: rows, ids, targets, coverage, and infinities in any numeric column."""
    inf = F.lit(False)
    for c, t in df.dtypes:
        if t in ("double", "float"):
            inf = inf | F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False))
    n = F.count("*")
    part = lambda c: F.count(c) / F.nullif(n, F.lit(0))
    return df.agg(n.alias("rows"), (n - F.count("loan_id")).alias("null_ids"), (n - F.countDistinct("loan_id")).alias("duplicate_ids"), F.count_if(F.col("target") == 1).alias("defaulted"), part("state_code").alias("state_coverage"), part("issue_d").alias("date_coverage"), F.count_if(inf).alias("infinite"))


def loan_trend(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_format("issue_d", "yyyy-MM").alias("month")).agg(F.count("*").alias("loans"), F.sum("loan_amnt").alias("amount"))


def accepted_volume(df: DataFrame) -> DataFrame:
    return df.filter("issue_d is not null").groupBy(F.trunc("issue_d", "MM").alias("month")).agg(F.count("*").alias("loans"))


def time_metrics(df: DataFrame) -> DataFrame:
    return df.filter("target in (0, 1)").groupBy(F.trunc("issue_d", "MM").alias("month")).agg(F.count("*").alias("loans"), F.sum("target").alias("defaults"), F.avg("target").alias("default_rate"))


def funnel_counts(funnel: DataFrame, expected: dict[str, DataFrame]) -> DataFrame:
    """Applications per decision beside the rows of the table that each comes from."""
    counts = None
    for decision, df in expected.items():
        one = df.agg(F.lit(decision).alias("decision"), F.count("*").alias("expected"))
        counts = one if counts is None else counts.unionByName(one)
    return funnel.groupBy("decision").agg(F.count("*").alias("applications")).join(counts, "decision")


def funnel_monthly(funnel: DataFrame) -> DataFrame:
    return funnel.groupBy(F.trunc("application_date", "MM").alias("application_month"), "state_code", "decision").agg(F.count("*").alias("application_count"), F.sum("requested_amount").alias("requested_amount"), F.count("requested_amount").alias("amount_known_count"))


def lti_risk_line(fact: DataFrame, least: int = SPARSE) -> DataFrame:
    """Per loan-to-income bin: where it stands, its label, loans, mean probability, observed rate, their gap, and whether it is sparse."""
    got = fact.withColumn("lti_bin", K.lti_bin(F.col("loan_to_income_ratio"))).filter("lti_bin is not null").groupBy("lti_bin")
    got = got.agg(F.count("*").alias("n"), F.avg("predicted_pd").alias("mean_pd"), F.avg("target").alias("observed_rate"), (F.avg("target") - F.avg("predicted_pd")).alias("gap"), (F.count("*") < least).alias("sparse"))
    return got.withColumns({"lti_x": K.lti_bin_x(F.col("lti_bin")), "lti_label": K.lti_bin_label(F.col("lti_bin"))})


def state_risk_map(fact: DataFrame, states: DataFrame) -> DataFrame:
    """Every state, with 0 loans and defaults where the fact has none."""
    got = fact.groupBy("state_code").agg(F.count("*").alias("n"), F.sum("target").alias("d"), F.avg("target").alias("default_rate"), F.avg("predicted_pd").alias("mean_pd"))
    return states.select("state_code").join(got, "state_code", "left").select("state_code", F.coalesce("n", F.lit(0)).alias("loans"), F.coalesce("d", F.lit(0)).alias("defaults"), "default_rate", "mean_pd")


def portfolio_kpis(df: DataFrame, least: int = SPARSE) -> DataFrame:
    return df.agg(F.count("*").alias("loans"), F.sum("loan_amnt").alias("funded"), F.avg("fico_avg").alias("mean_fico"), F.avg("loan_amnt").alias("mean_loan"), F.when(F.count("target") >= least, F.avg("target")).alias("default_rate"))


def numeric_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high")).alias(c) for c in columns]).unpivot([], columns, "feature", "b").select("feature", "b.low", "b.high")


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).unpivot([], columns, "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n"))


def top_by_count(df: DataFrame, by: str) -> DataFrame:
    """The value with the most rows; of equal counts the first by value. The sort keeps one row a task."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(1)


def counts_and_share(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", share(F.col("n")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

