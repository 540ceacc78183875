"""Data tests as tables of checks: check, passed, observed, expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import leakage_gate
from .tables import grain


def checks(one_row: DataFrame, named: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """From a one-row table: (name, observed, expected), passed if they are there and equal."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(o == e, F.lit(False)).alias("passed"), o.cast("double").alias("observed"), e.cast("double").alias("expected")) for n, o, e in named])
    return one_row.select(F.explode(rows).alias("c")).select("c.*")


def strict(gate: DataFrame) -> DataFrame:
    """gate, or an error where a check failed; one that says neither way failed too."""
    failed = gate.filter(~F.coalesce("passed", F.lit(False))).select("check").limit(20).collect()
    if failed:
        raise ValueError(f"failed: {[r['check'] for r in failed]}")
    return gate


def grain_gate(df: DataFrame, key: str) -> DataFrame:
    return checks(grain(df, key), [("null keys", F.col("null_keys"), F.lit(0)), ("duplicate keys", F.col("duplicate_keys"), F.lit(0))])


def canonical_gate(df: DataFrame, key: str = "loan_id", features: Sequence[str] | None = None) -> DataFrame:
    """Key, targets, infinities, and with features that each is there and of a class that may feed a model."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    inf = F.lit(0)
    for c in numbers:
        inf = inf + F.coalesce((F.abs(F.col(c)) == float("inf")).cast("int"), F.lit(0))
    one = grain(df, key).crossJoin(df.agg(F.count_if(F.col("target").isNull() | ~F.col("target").isin(0, 1)).alias("bad_targets"), F.sum(inf).alias("infinite")))
    got = checks(one, [("null keys", F.col("null_keys"), F.lit(0)), ("duplicate keys", F.col("duplicate_keys"), F.lit(0)), ("targets not 0 or 1", F.col("bad_targets"), F.lit(0)), ("infinite values", F.coalesce("infinite", F.lit(0)), F.lit(0))])
    return got if features is None else got.unionByName(leakage_gate(df, features))


def el_reconciliation(df: DataFrame, lgd: float = 0.45, tiers: DataFrame | None = None, portfolio: DataFrame | None = None) -> DataFrame:
    """Losses row by row, and where given that the tiers' and the portfolio's totals (loans, ead, el) are those of the rows."""
    el, ead, p = F.col("expected_loss"), F.col("loan_amnt"), F.col("predicted_pd")
    tol = F.greatest(F.lit(1.0), F.abs(ead)) * 1e-9
    broken = lambda sound: F.count_if(~F.coalesce(sound, F.lit(False)))  # noqa: E731  a null or NaN breaks it
    monotone = (F.col("el_lgd_30") <= F.col("el_lgd_45") + 1e-10) & (F.col("el_lgd_45") <= F.col("el_lgd_60") + 1e-10) & ~F.isnan("el_lgd_60")
    number = ~F.isnan(el) & ~F.isnan(ead) & ~F.isnan(p)
    one = df.agg(broken(number & (F.abs(el - p * lgd * ead) <= tol)).alias("wrong"), broken((el >= 0) & (el - ead <= 1e-9) & ~F.isnan(el) & ~F.isnan(ead)).alias("outside"), broken(monotone).alias("not_monotone"), F.count("*").alias("rows"), F.sum(ead).alias("ead"), F.sum(el).alias("el"))
    named = [("EL = PD x LGD x EAD", F.col("wrong"), F.lit(0)), ("0 <= EL <= EAD", F.col("outside"), F.lit(0)), ("monotone in LGD", F.col("not_monotone"), F.lit(0))]
    off = lambda a, b: F.when(F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.abs(b), F.lit(1.0)), a.isNull() & b.isNull()), 0).otherwise(1)
    if tiers is not None:
        one = one.crossJoin(F.broadcast(tiers.agg(F.sum("loans").alias("t_rows"), F.sum("ead").alias("t_ead"), F.sum("el").alias("t_el"))))
        named += [("tiers' loans = rows", F.col("t_rows"), F.col("rows")), ("tiers' EAD off", off(F.col("t_ead"), F.col("ead")), F.lit(0)), ("tiers' EL off", off(F.col("t_el"), F.col("el")), F.lit(0))]
    if portfolio is not None:
        one = one.crossJoin(F.broadcast(portfolio.select(F.col("el").alias("p_el"))))
        named.append(("portfolio's EL off", off(F.col("p_el"), F.col("el")), F.lit(0)))
    return checks(one, named)


def control_totals(df: DataFrame, by: str, expected: DataFrame, el: float | None = None) -> DataFrame:
    """expected: label, n. A check for each label of either side, one for all rows, and with el one for the total loss; a total that isn't there fails."""
    got = df.groupBy(F.col(by).alias("label")).agg(F.count("*").alias("observed"))
    both = got.join(expected.withColumnRenamed("n", "expected"), "label", "full")
    rows = both.unionByName(both.agg(F.lit("all").alias("label"), F.sum("observed").alias("observed"), F.sum("expected").alias("expected")))
    out = rows.select(F.concat(F.lit("rows of "), "label").alias("check"), F.col("observed").eqNullSafe(F.col("expected")).alias("passed"), F.col("observed").cast("double").alias("observed"), F.col("expected").cast("double").alias("expected"))
    if el is None:
        return out
    total = F.sum("expected_loss")
    return out.unionByName(df.agg(F.lit("total expected loss").alias("check"), F.coalesce(F.abs(total - el) <= 1e-6 + 1e-12 * abs(el), F.lit(False)).alias("passed"), total.alias("observed"), F.lit(float(el)).alias("expected")))


def probability_gate(df: DataFrame, threshold: float) -> DataFrame:
    p = F.col("predicted_pd")
    one = df.agg(F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("bad"), F.count_if(~F.coalesce((p >= threshold).cast("int") == F.col("predicted_class"), F.lit(False))).alias("off"))
    return checks(one, [("probabilities in [0, 1]", F.col("bad"), F.lit(0)), ("class matches threshold", F.col("off"), F.lit(0))])


def metric_match(a: DataFrame, b: DataFrame, columns: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """Two one-row tables of metrics."""
    one = a.select(*[F.col(c).alias(f"a_{c}") for c in columns]).crossJoin(b.select(*[F.col(c).alias(f"b_{c}") for c in columns]))
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.lit(False)).alias("passed"), F.col(f"a_{c}").alias("observed"), F.col(f"b_{c}").alias("expected")) for c in columns])
    return one.select(F.explode(rows).alias("c")).select("c.*")


def handoff_manifest(df: DataFrame) -> DataFrame:
    one = df.agg(F.count("*").alias("accepted"), F.count("target").alias("labeled"), F.count_if(F.col("target").isNull()).alias("unresolved"), F.count_if(F.col("target") == 0).alias("paid"), F.count_if(F.col("target") == 1).alias("defaulted"), F.count("state_code").alias("with_state"))
    return checks(one, [("accepted = labeled + unresolved", F.col("accepted"), F.col("labeled") + F.col("unresolved")), ("labeled = paid + defaulted", F.col("labeled"), F.col("paid") + F.col("defaulted")), ("state for every row", F.col("with_state"), F.col("accepted"))])
