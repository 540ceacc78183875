"""Score, tier and loss functions, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("A", "B", "C", "D")
# Fixed labels of the tiers and the bins.
TIER_LABELS = ("Tier A — Low", "Tier B — Moderate", "Tier C — High", "Tier D — Very High")
#: Loss given default: the base case and the scenarios.
BASE_LGD, LGDS = 0.45, (0.30, 0.45, 0.60)
# Fixed values of the loan-to-income bins: upper edges (the last bin is open), where each stands on an axis, labels.
LTI_EDGES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)
LTI_X = (0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.7, 0.9, 1.3333333333333333)
LTI_LABELS = ("0 – <0,1", "0,1 – <0,2", "0,2 – <0,3", "0,3 – <0,4", "0,4 – <0,5", "0,5 – <0,6", "0,6 – <0,8", "0,8 – <1,0", "≥ 1,0 (nhóm đuôi)")


def pd_to_log_odds(p: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(p / (1 - p))


def log_odds_to_pd(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def pdo_score(p: Column, *, base_score: float = 600, base_odds: float = 0.05, pdo: float = 50, least: float | None = None, most: float | None = None) -> Column:
    """base_score at base_odds of default; `pdo` points fewer for each doubling of the odds."""
    if not (pdo > 0 and base_odds > 0):
        raise ValueError("pdo and base_odds must be positive")
    s = base_score - pdo / math.log(2) * (pd_to_log_odds(p) - math.log(base_odds))
    s = F.greatest(s, F.lit(float(least))) if least is not None else s
    return F.least(s, F.lit(float(most))) if most is not None else s


def score_tier(score: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the bin; a score at an edge belongs to the lower one."""
    if list(edges) != sorted(set(edges)) or len(set(labels)) != len(edges) + 1 or len(labels) != len(edges) + 1:
        raise ValueError("edges must increase strictly and labels be one more, all different")
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(score <= float(edge), label)
    return out.otherwise(labels[-1])


def risk_score(p: Column) -> Column:
    return 100 * p


def credit_score(p: Column) -> Column:
    """Half to even."""
    return F.rint(1000 * (1 - p)).cast("int")


def pd_tier(p: Column, threshold: float) -> Column:
    """A below T/2, B below T, C below 2T (1 at most), then D."""
    return F.when(p < threshold / 2, "A").when(p < threshold, "B").when(p < min(2 * threshold, 1.0), "C").when(p.isNotNull(), "D")


def flag_default(p: Column, threshold: float) -> Column:
    return F.when(p >= threshold, 1).when(p.isNotNull(), 0)


def outcome_code(p: Column, target: Column, threshold: float) -> Column:
    flag = p >= threshold
    return F.when(flag & (target == 1), "TP").when(flag & (target == 0), "FP").when(~flag & (target == 1), "FN").when(~flag & (target == 0), "TN")


def pd_bin(p: Column, bins: int = 20) -> Column:
    """1 to `bins`, left-closed on exact edges i / bins, the last closed."""
    n = F.lit(0)
    for i in range(bins):
        n = n + (p >= F.lit(i / bins)).cast("int")
    return F.least(n, F.lit(bins))


def pd_bin_label(bin_no: Column, bins: int = 20) -> Column:
    labels = [f"{i / bins:.2f}–<{(i + 1) / bins:.2f}" for i in range(bins - 1)] + [f"{(bins - 1) / bins:.2f}–1.00 (inclusive)"]
    return F.get(F.array(*map(F.lit, labels)), bin_no - 1)


def expected_loss(p: Column, lgd: Column | float, ead: Column) -> Column:
    lgd = lgd if isinstance(lgd, Column) else F.lit(float(lgd))
    return p * lgd * ead


def require_loss_inputs(df: DataFrame, pd_col: str = "predicted_pd", lgd: float = BASE_LGD, ead_col: str = "loan_amnt") -> None:
    """Raises unless every probability is finite and in [0, 1], lgd in [0, 1] and every exposure finite and not negative."""
    if not (math.isfinite(lgd) and 0 <= lgd <= 1):
        raise ValueError("LGD must be in [0, 1]")
    p, ead = F.col(pd_col), F.col(ead_col)
    bad = df.agg(F.count_if(~F.coalesce((p >= 0) & (p <= 1), F.lit(False))).alias("p"), F.count_if(~F.coalesce((ead >= 0) & (ead < float("inf")), F.lit(False))).alias("ead")).first()
    if bad["p"] or bad["ead"]:
        raise ValueError(f"{bad['p']} probabilities out of [0, 1], {bad['ead']} exposures negative or not finite")


def expected_loss_dataset(df: DataFrame, pd_col: str = "predicted_pd", ead_col: str = "loan_amnt") -> DataFrame:
    p, ead = F.col(pd_col), F.col(ead_col)
    base = expected_loss(p, BASE_LGD, ead)
    made = {"expected_loss": base, "el_rate": F.when(ead != 0, base / F.nullif(ead, F.lit(0.0)))}
    return df.withColumns(made | {f"el_lgd_{round(100 * x)}": expected_loss(p, x, ead) for x in LGDS})


def tier_order(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int")


def tier_label(tier: Column) -> Column:
    return F.get(F.array(*map(F.lit, TIER_LABELS)), tier_order(tier) - 1)


def tier_code(label: Column) -> Column:
    """A to D of a long label; null for any other text."""
    return F.get(F.array(*map(F.lit, TIERS)), F.nullif(F.array_position(F.array(*map(F.lit, TIER_LABELS)), label), F.lit(0)).cast("int") - 1)


def fico_order(label: Column) -> Column:
    """1 to 4; null is Missing, 5."""
    return F.when(label.isNull(), 5).otherwise(F.array_position(F.array(*map(F.lit, ("<650", "650-699", "700-749", "750+"))), label).cast("int"))


def lti_bin(ratio: Column) -> Column:
    """1 to 9; null and negative ratios have none."""
    out = F.when(ratio.isNull() | (ratio < 0), F.lit(None).cast("int"))
    for i, edge in enumerate(LTI_EDGES, 1):
        out = out.when(ratio < edge, i)
    return out.otherwise(len(LTI_EDGES) + 1)


def lti_bin_label(bin_no: Column) -> Column:
    return F.get(F.array(*map(F.lit, LTI_LABELS)), bin_no - 1)


def lti_bin_x(bin_no: Column) -> Column:
    return F.get(F.array(*map(F.lit, LTI_X)), bin_no - 1)


def scenario_id(*parts: str) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16)
