"""Evaluation of scores against targets, on histograms of distinct scores with distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that an ordered table is cut into, the most there are, and rows of a part beyond which there are so many; what one task sees of it is that many edges and sums.
PARTS, MOST_PARTS, ROWS = 64, 1024, 1_000_000
# The order of simplicity among candidates, and how complex each is.
CANDIDATES = ("logistic_baseline", "logistic_weighted", "xgboost_candidate")
COMPLEXITY = {"logistic_baseline": 0, "logistic_weighted": 0, "xgboost_candidate": 1}
F1_TOLERANCE = 1e-12
DIAGNOSTIC = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)


def ratio(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def ordered_parts(df: DataFrame, by: str) -> DataFrame:
    """df with `part`: ranges of `by` of about equal rows, by approximate quantiles.

    The quantiles are one row of the same query, broadcast: building the plan runs no job and nothing is kept. They ask
    for all columns of df, so Spark sees the same exchange below them and below df, and runs it once.
    """
    every = MOST_PARTS // PARTS
    edges = df.agg(F.percentile_approx(by, [i / MOST_PARTS for i in range(1, MOST_PARTS)], 16 * MOST_PARTS).alias("_all"), F.count("*").alias("_rows"), *[F.max(c).alias(f"_{i}") for i, c in enumerate(df.columns)])
    few = F.filter("_all", lambda e, i: (i + 1) % every == 0)
    edges = edges.select(F.when(F.col("_rows") > PARTS * ROWS, F.col("_all")).otherwise(few).alias("_edges"))
    # Edges at or below a value, by halving.
    steps = F.array(*[F.lit(MOST_PARTS >> k) for k in range(1, MOST_PARTS.bit_length())])
    at = F.aggregate(steps, F.lit(0), lambda place, step: F.when(F.get("_edges", place + step - 1) <= F.col(by), place + step).otherwise(place))
    return df.crossJoin(F.broadcast(edges)).withColumn("part", at).drop("_edges")


def prefix_sums(df: DataFrame, by: str, values: Sequence[str], within: Sequence[str] = (), *, parts: bool = False) -> DataFrame:
    """df with cum_<value> (this row included) in ascending order of `by`, and total_<value>, for each group of `within`; with parts, the `part` of each row too.

    Rows are cut into ranges; the ranges' sums, a few rows, are summed up, and each range runs its own sum. No task
    orders the whole table. `by` must be distinct within a group.
    """
    cut = ordered_parts(df, by)
    whole = Window.partitionBy(*within)
    sums = cut.groupBy(*within, "part").agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    running = whole.orderBy("part")
    sums = sums.select(*[F.col(w).alias(f"_{w}") for w in within], F.col("part").alias("_part"), *[(F.sum(f"sum_{v}").over(running) - F.col(f"sum_{v}")).alias(f"before_{v}") for v in values], *[F.sum(f"sum_{v}").over(whole).alias(f"total_{v}") for v in values])
    on = (cut["part"] == sums["_part"]) if not within else None
    for w in within:
        on = (F.col(w).eqNullSafe(F.col(f"_{w}"))) if on is None else on & F.col(w).eqNullSafe(F.col(f"_{w}"))
    on = on & (cut["part"] == sums["_part"]) if within else on
    got = cut.join(sums, on).drop("_part", *[f"_{w}" for w in within])
    inside = Window.partitionBy(*within, "part").orderBy(by)
    return got.select(*df.columns, *(["part"] if parts else []), *[(F.col(f"before_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in values], *[f"total_{v}" for v in values])


def score_histogram(df: DataFrame, pd_col: str = "predicted_pd", within: Sequence[str] = ()) -> DataFrame:
    """pd, pos, neg per distinct score."""
    return df.filter(F.col("target").isNotNull()).groupBy(*within, F.col(pd_col).alias("pd")).agg(F.sum("target").cast("long").alias("pos"), F.sum(1 - F.col("target")).cast("long").alias("neg"))


def at_scores(hist: DataFrame, *, parts: bool = False) -> DataFrame:
    """For each distinct score as threshold (pd >= threshold is flagged): tp, fp, fn, tn and own pos, neg, and other columns of hist."""
    got = prefix_sums(hist, "pd", ["pos", "neg"], parts=parts)
    more = [c for c in hist.columns if c not in ("pd", "pos", "neg")] + ["part"] * parts
    tp, fp = F.col("total_pos") - F.col("cum_pos") + F.col("pos"), F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    return got.select("pd", "pos", "neg", tp.alias("tp"), fp.alias("fp"), (F.col("total_pos") - tp).alias("fn"), (F.col("total_neg") - fp).alias("tn"), *more)


def rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + tn + fp + fn)})


def counts_at(pd_col: str, threshold: Column | float) -> list[Column]:
    flag, y = F.col(pd_col) >= threshold, F.col("target")
    return [F.count_if(flag & (y == 1)).alias("tp"), F.count_if(flag & (y == 0)).alias("fp"), F.count_if(~flag & (y == 1)).alias("fn"), F.count_if(~flag & (y == 0)).alias("tn")]


def confusion_metrics(df: DataFrame, threshold: float, by: Sequence[str] = (), pd_col: str = "predicted_pd") -> DataFrame:
    return rates(df.filter("target is not null").groupBy(*by).agg(*counts_at(pd_col, threshold)))


def roc_curve(hist: DataFrame) -> DataFrame:
    """threshold, fpr, tpr, kept. Points on a straight line between their neighbours aren't kept: a point is one if the next lower score adds the same counts."""
    got = at_scores(hist, parts=True)
    own = F.struct("pos", "neg")
    below = Window.partitionBy("part").orderBy(F.desc("pd"))
    # What comes after a part's last row is the first row of the next part that has rows.
    heads = got.groupBy("part").agg(F.max_by(own, "pd").alias("head"))
    heads = heads.select(F.col("part").alias("_part"), F.lead("head").over(Window.orderBy(F.desc("part"))).alias("next_head"), F.lag("head").over(Window.orderBy(F.desc("part"))).isNull().alias("top"))
    got = got.join(F.broadcast(heads), F.col("part") == F.col("_part"))
    nxt = F.coalesce(F.lead(own).over(below), "next_head")
    first = F.col("top") & (F.row_number().over(below) == 1)
    got = got.withColumn("kept", first | nxt.isNull() | (nxt["pos"] != F.col("pos")) | (nxt["neg"] != F.col("neg")))
    points = got.select(F.col("pd").alias("threshold"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), "kept")
    start = hist.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(True).alias("kept"))
    return points.unionByName(start)


def pr_curve(hist: DataFrame) -> DataFrame:
    points = rates(at_scores(hist)).select(F.col("pd").alias("threshold"), "precision", "recall")
    end = hist.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def ranking_metrics(hist: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """roc_auc (ties count half) and average_precision, one row a group."""
    got = prefix_sums(hist, "pd", ["pos", "neg"], within)
    tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return got.groupBy(*within).agg((wins / F.nullif(F.max("total_pos") * F.max("total_neg"), F.lit(0))).alias("roc_auc"), F.sum(F.col("pos") / F.nullif(F.col("total_pos"), F.lit(0)) * ratio(tp, tp + fp)).alias("average_precision"))


def log_loss(p: Column, y: Column) -> Column:
    eps = 2.220446049250313e-16
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def model_metrics(long: DataFrame) -> DataFrame:
    """long: model, pd, target -> one row a model with its metrics."""
    long = long.filter("target is not null")
    hist = long.groupBy("model", "pd").agg(F.sum("target").cast("long").alias("pos"), F.sum(1 - F.col("target")).cast("long").alias("neg"))
    other = long.groupBy("model").agg(log_loss(F.col("pd"), F.col("target")).alias("log_loss"), brier(F.col("pd"), F.col("target")).alias("brier"))
    return ranking_metrics(hist, ["model"]).join(other, "model")


def threshold_table(df: DataFrame, thresholds: Sequence[float], pd_col: str = "predicted_pd") -> DataFrame:
    """A row per threshold, all counted in one pass."""
    names = [f"t{i}" for i in range(len(thresholds))]
    one = df.filter("target is not null").agg(*[F.struct(F.lit(float(t)).alias("threshold"), *counts_at(pd_col, t)).alias(n) for n, t in zip(names, thresholds, strict=True)])
    return rates(one.unpivot([], names, "t", "v").select("v.*"))


def _best(scored: DataFrame, tolerance: float) -> DataFrame:
    top = scored.agg(F.max("f1").alias("top"))
    near = scored.crossJoin(F.broadcast(top)).filter(F.col("f1") >= F.col("top") - tolerance).drop("top")
    return near.orderBy(F.desc("recall"), F.desc("precision"), F.desc("threshold")).limit(1)


def best_threshold(hist: DataFrame, tolerance: float = F1_TOLERANCE) -> DataFrame:
    """The row of the greatest F1; within the tolerance by recall, precision and threshold, all descending."""
    return _best(rates(at_scores(hist)).withColumnRenamed("pd", "threshold"), tolerance)


def full_threshold_table(hist: DataFrame) -> DataFrame:
    """Distinct scores and the diagnostic thresholds, with all counts, specificity and which one is best."""
    marks = hist.sparkSession.createDataFrame([(t, 0, 0, False) for t in DIAGNOSTIC], "pd double, pos long, neg long, own boolean")
    both = hist.withColumn("own", F.lit(True)).unionByName(marks).groupBy("pd").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("own").alias("own"))
    got = rates(at_scores(both)).withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp"))).withColumnRenamed("pd", "threshold")
    best = F.broadcast(_best(got.filter("own"), F1_TOLERANCE).select(F.col("threshold").alias("best")))
    return got.crossJoin(best).withColumn("selected", F.col("threshold") == F.col("best")).drop("best", "pos", "neg", "own")


def select_candidate(metrics: DataFrame, order: Sequence[str] = CANDIDATES, complexity: dict[str, int] = COMPLEXITY, auc_band: float = 0.002, ap_band: float = 0.005) -> DataFrame:
    """Of the models within auc_band of the best ROC-AUC, those within ap_band of the best average precision of these; then the least complex, then by log loss, Brier and the fixed order. A few rows."""
    w = Window.partitionBy()
    near = metrics.withColumn("top", F.max("roc_auc").over(w)).filter(F.col("top") - F.col("roc_auc") <= auc_band)
    near = near.withColumn("top", F.max("average_precision").over(w)).filter(F.col("top") - F.col("average_precision") <= ap_band)
    cost = F.coalesce(*[F.when(F.col("model") == m, F.lit(c)) for m, c in complexity.items()], F.lit(max(complexity.values(), default=0) + 1))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return near.withColumns({"cost": cost, "place": place}).orderBy("cost", "log_loss", "brier", "place").limit(1).select("model")


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., q: the exact quantiles of a value at these shares, interpolated between neighbours, for each group. Null and NaN don't count. They come from running counts over distinct values, so no task holds a group's values."""
    v = F.col(value).cast("double")
    hist = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("v")).agg(F.count("*").alias("n"))
    got = prefix_sums(hist, "v", ["n"], by)
    at = [F.lit(float(p)) * (F.col("total_n") - 1) for p in shares]
    one = lambda place: F.min(F.when(F.col("cum_n") > place, F.col("v")))
    got = got.groupBy(*by).agg(F.max("total_n").alias("total_n"), *[x for i, p in enumerate(at) for x in (one(F.floor(p)).alias(f"lo{i}"), one(F.ceil(p)).alias(f"hi{i}"))])
    q = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p - F.floor(p)) for i, p in enumerate(at)]
    return got.select(*by, F.array(*q).alias("q"))


def calibration_quantile(df: DataFrame, bins: int = 10, pd_col: str = "predicted_pd") -> DataFrame:
    """Right-closed bins on exact quantiles, equal edges once; n, mean_pd, observed_rate."""
    df = df.filter("target is not null")
    edges = sorted(set((exact_quantiles(df, pd_col, [i / bins for i in range(bins + 1)]).first() or [[]])[0]))
    inner = edges[1:-1]
    at = F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e < F.col(pd_col))) if inner else F.lit(0)
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(pd_col).alias("mean_pd"), F.avg("target").alias("observed_rate"))


def calibration_uniform(df: DataFrame, bins: int = 10, least: int = 500, pd_col: str = "predicted_pd") -> DataFrame:
    at = F.least(F.floor(F.col(pd_col) * bins), F.lit(bins - 1)).cast("int")
    return df.filter("target is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(pd_col).alias("mean_pd"), F.avg("target").alias("observed_rate"), (F.count("*") < least).alias("sparse"))


def confusion_row_rates(df: DataFrame, threshold: float, pd_col: str = "predicted_pd") -> DataFrame:
    got = df.filter("target is not null").groupBy(F.col("target").alias("actual"), (F.col(pd_col) >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return got.withColumn("row_rate", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def percentile_index(df: DataFrame, reference: DataFrame, pd_col: str = "predicted_pd", key: str = "loan_id") -> DataFrame:
    """100 * share of the reference at or below a score, and its half-even whole value. Distinct scores of both sides meet in one prefix sum."""
    ref = reference.groupBy(F.col(pd_col).alias("pd")).agg(F.count("*").alias("n"))
    both = ref.unionByName(df.select(F.col(pd_col).alias("pd"), F.lit(0).cast("long").alias("n"))).groupBy("pd").agg(F.sum("n").alias("n"))
    index = prefix_sums(both, "pd", ["n"]).select(F.col("pd").alias(pd_col), (100 * F.col("cum_n") / F.col("total_n")).alias("percentile"))
    return df.select(key, pd_col).join(index, pd_col).withColumn("shown", F.rint("percentile").cast("int"))


def reference_distribution(long: DataFrame, test_ids: DataFrame | None = None, key: str = "loan_id") -> DataFrame:
    """long: model, pd and the key -> model, pd, n, cumulative, rows. Refuses ids that are also in the test split, probabilities out of [0, 1] and models of fewer than two rows."""
    if test_ids is not None and not long.join(test_ids.select(key), key, "left_semi").isEmpty():
        raise ValueError("the reference holds ids of the test split")
    if not long.filter(~F.coalesce(F.col("pd").between(0, 1), F.lit(False))).isEmpty():
        raise ValueError("the reference holds probabilities out of [0, 1]")
    got = prefix_sums(long.groupBy("model", "pd").agg(F.count("*").alias("n")), "pd", ["n"], ["model"]).select("model", "pd", "n", F.col("cum_n").alias("cumulative"), F.col("total_n").alias("rows"))
    if small := [r["model"] for r in got.filter("rows < 2").select("model").distinct().collect()]:
        raise ValueError(f"the reference has fewer than two rows of {small}")
    return got


def reference_summary(reference: DataFrame) -> DataFrame:
    """model, rows, least, median, most of a reference distribution."""
    at = lambda place: F.min(F.when(F.col("cumulative") > place, F.col("pd")))
    half = (F.col("rows") - 1) / 2
    return reference.groupBy("model").agg(F.max("rows").alias("rows"), F.min("pd").alias("least"), ((at(F.floor(half)) + at(F.ceil(half))) / 2).alias("median"), F.max("pd").alias("most"))


def percentile_by_model(rows: DataFrame, reference: DataFrame, key: str = "loan_id") -> DataFrame:
    """model, key, percentile: 100 * share of the same model's reference at or below a score. rows: model, key, pd, whose scores may be ones that the reference lacks."""
    seen = reference.select("model", "pd", "n").unionByName(rows.select("model", "pd", F.lit(0).cast("long").alias("n"))).groupBy("model", "pd").agg(F.sum("n").alias("n"))
    index = prefix_sums(seen, "pd", ["n"], ["model"]).select("model", "pd", (100 * F.col("cum_n") / F.col("total_n")).alias("percentile"))
    return rows.select("model", key, "pd").join(index, ["model", "pd"]).select("model", key, "percentile")


def nearest_to_quantiles(df: DataFrame, value: str, shares: Sequence[float], key: str = "loan_id") -> DataFrame:
    """q, key, value: for each share in turn the row nearest to its quantile, ties by key, no row twice. Each share's rows that could be taken are its nearest few, as many as there are shares."""
    at = exact_quantiles(df, value, shares).first()
    near = None
    for q, v in zip(shares, at["q"] if at else [], strict=False):
        one = df.select(F.lit(q).alias("q"), key, value, F.abs(F.col(value) - v).alias("d")).orderBy("d", key).limit(len(shares))
        near = one if near is None else near.unionByName(one)
    taken: list = []
    for q in shares if near is not None else ():
        mine = sorted((r["d"], r[key], r[value]) for r in near.filter(F.col("q") == q).collect() if r[key] not in {t[1] for t in taken})  # len(shares) rows
        taken += [(q, mine[0][1], mine[0][2])] if mine else []
    schema = f"q double, {key} {dict(df.dtypes)[key]}, {value} {dict(df.dtypes)[value]}"
    return df.sparkSession.createDataFrame(taken, schema)


def rank_importance(rows: DataFrame, n: int | None = None) -> DataFrame:
    """feature, v with rank: by value descending, then name. One row a feature."""
    got = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("v"), "feature")))
    return got if n is None else got.filter(F.col("rank") <= n)


def at_thresholds(hist: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """threshold_table() from a histogram of distinct scores instead of the rows."""
    names, p, n, at = [f"t{i}" for i in range(len(thresholds))], F.col("pos"), F.col("neg"), F.col("pd")
    total = lambda what, which: F.coalesce(F.sum(F.when(which, what).otherwise(0)), F.lit(0))
    one = lambda t: F.struct(F.lit(float(t)).alias("threshold"), total(p, at >= t).alias("tp"), total(n, at >= t).alias("fp"), total(p, at < t).alias("fn"), total(n, at < t).alias("tn"))
    return rates(hist.agg(*[one(t).alias(x) for x, t in zip(names, thresholds, strict=True)]).unpivot([], names, "t", "v").select("v.*"))


def generalization_delta(df: DataFrame, split: DataFrame, threshold: float) -> DataFrame:
    """Each metric on the test split less the same on the validation split, one row: those at the threshold, and ROC-AUC, average precision, log loss and Brier score."""
    rows = df.join(split.select("loan_id", "split").filter("split in ('test', 'validation')"), "loan_id")
    ranked = model_metrics(rows.select(F.col("split").alias("model"), F.col("predicted_pd").alias("pd"), "target"))
    got = confusion_metrics(rows, threshold, ["split"]).join(ranked.withColumnRenamed("model", "split"), "split")
    columns = ["precision", "recall", "f1", "accuracy", "roc_auc", "average_precision", "log_loss", "brier"]
    of = lambda name, c: F.max(F.when(F.col("split") == name, F.col(c)))
    return got.agg(*[(of("test", c) - of("validation", c)).alias(c) for c in columns])


def average_rank(df: DataFrame, column: str, key: str = "loan_id") -> DataFrame:
    """key, rank: ties get the mean of their places."""
    hist = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranks = prefix_sums(hist, "v", ["n"]).select("v", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    return df.select(key, F.col(column).alias("v")).join(ranks, "v").select(key, "rank")


def spearman(df: DataFrame, a: str, b: str, key: str = "loan_id") -> DataFrame:
    """n, rho: the correlation of average ranks; null where a side is constant."""
    sound = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return average_rank(sound, a, key).withColumnRenamed("rank", "ra").join(average_rank(sound, b, key), key).agg(F.count("*").alias("n"), (F.covar_pop("ra", "rank") / F.nullif(F.stddev_pop("ra") * F.stddev_pop("rank"), F.lit(0.0))).alias("rho"))


def direction_summary(df: DataFrame, feature: str, contribution: str, key: str = "loan_id", least_rows: int = 30, least_values: int = 3) -> DataFrame:
    """n, rho, low, middle, high, direction: the rank correlation of a feature with a contribution, the contribution's median in each third of the feature's order, and what they say. Too few rows or values, or a constant contribution: insufficient. Rows of equal feature values are ordered by key."""
    sound = df.filter(F.col(feature).isNotNull() & F.col(contribution).isNotNull()).select(key, F.col(feature).cast("double").alias("f"), F.col(contribution).cast("double").alias("c"))
    hist = sound.groupBy("f").agg(F.count("*").alias("n"))
    before = prefix_sums(hist, "f", ["n"]).select("f", (F.col("cum_n") - F.col("n")).alias("before"), F.col("n").alias("equal"), F.col("total_n").alias("total"))
    # A value's rows stand together; only values at the border of two thirds have theirs numbered.
    third = lambda place: F.when(3 * place < F.col("total"), 0).when(3 * place < 2 * F.col("total"), 1).otherwise(2)
    placed = sound.join(before, "f")
    split = third(F.col("before")) != third(F.col("before") + F.col("equal") - 1)
    inside = F.row_number().over(Window.partitionBy("f").orderBy(key)) - 1
    whole = placed.filter(~split).select("c", third(F.col("before")).alias("third"))
    parts = placed.filter(split).withColumn("place", F.col("before") + inside).select("c", third(F.col("place")).alias("third"))
    medians = exact_quantiles(whole.unionByName(parts), "c", [0.5], ["third"]).agg(*[F.max(F.when(F.col("third") == k, F.col("q")[0])).alias(n) for k, n in enumerate(("low", "middle", "high"))])
    facts = sound.agg(F.min("c").alias("c0"), F.max("c").alias("c1")).crossJoin(F.broadcast(hist.agg(F.count("*").alias("values"))))
    got = spearman(sound, "f", "c", key).crossJoin(medians).crossJoin(facts)
    enough = (F.col("n") >= least_rows) & (F.col("values") >= least_values) & (F.col("c0") < F.col("c1"))
    rising, falling = (F.col("low") < F.col("middle")) & (F.col("middle") < F.col("high")), (F.col("low") > F.col("middle")) & (F.col("middle") > F.col("high"))
    said = F.when(~F.coalesce(enough, F.lit(False)), "insufficient").when(rising, "rising").when(falling, "falling").otherwise("mixed")
    return got.select("n", F.when(said != "insufficient", F.col("rho")).alias("rho"), "low", "middle", "high", said.alias("direction"))


def monotonic_check(df: DataFrame, x: str, y: str, *, rising: bool) -> DataFrame:
    """breaks: neighbouring distinct x whose y goes the wrong way."""
    got = ordered_parts(df.groupBy(x).agg(F.min(y).alias("lo"), F.max(y).alias("hi")), x)
    inside = Window.partitionBy("part").orderBy(x)
    edge = got.groupBy("part").agg(F.max_by("hi", x).alias("last_hi"), F.max_by("lo", x).alias("last_lo"))
    before = Window.orderBy("part")
    edge = edge.select(F.col("part").alias("_part"), F.lag("last_hi").over(before).alias("edge_hi"), F.lag("last_lo").over(before).alias("edge_lo"))
    got = got.join(F.broadcast(edge), F.col("part") == F.col("_part"))
    prev = F.coalesce(F.lag("hi").over(inside), "edge_hi") if rising else F.coalesce(F.lag("lo").over(inside), "edge_lo")
    wrong = (F.col("lo") < F.col("prev")) if rising else (F.col("hi") > F.col("prev"))
    return got.withColumn("prev", prev).agg(F.count("*").alias("scores"), F.count_if(wrong).alias("breaks"))
