"""Default models, scoring, attributions and what-if scenarios."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import scoring as K
from ..functions.features import DTI_BANDS, INCOME_BANDS, LOAN_BANDS, band, safe_ratio, sanitize_inputs
from ..llm.common import written
from .boosting import Boosted, Plan, binned, boost
from .evaluation import direction_summary, exact_quantiles
from .tables import scored_context_join

NUMBERS, CATEGORIES = ("loan_amnt", "annual_inc", "dti", "fico_range_low", "term_months"), ("purpose", "home_ownership")
#: Inputs of the compact models, numbers and categories.
SIX = (("loan_amnt", "annual_inc", "dti", "term_months"), ("purpose", "home_ownership"))
FIVE = (("loan_amnt", "annual_inc", "dti", "term_months"), ("purpose",))
OVERRIDABLE = ("loan_amnt", "annual_inc", "dti", "term_months")
# Fixed ranges of overrides, both ends included (income must be above 0), and the terms on offer.
RANGES = {"loan_amnt": (500, 40_000), "annual_inc": (0, 10_999_200), "dti": (0, 999)}
TERMS = (36, 60)
#: Partitions a core of what a fit keeps, at most.
WAVES = 3


def fill_modes(df: DataFrame, categories: Sequence[str]) -> dict[str, str]:
    """The most frequent value of each category, the smallest of equals."""
    counts = df.unpivot([], list(categories), "feature", "value").filter("value is not null").groupBy("feature", "value").count()
    first = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("count"), "value"))
    return {r["feature"]: r["value"] for r in counts.withColumn("k", first).filter("k = 1").collect()}


def fill_medians(df: DataFrame, numbers: Sequence[str]) -> dict[str, float]:
    """The exact median of each number, of what sanitize_inputs() leaves; 0 where nothing is left."""
    long = sanitize_inputs(df).select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], list(numbers), "feature", "v")
    got = {r["feature"]: r["q"][0] for r in exact_quantiles(long, "v", [0.5], ["feature"]).collect()}  # a row a number
    return {c: got.get(c, 0.0) for c in numbers}


def category_values(df: DataFrame, categories: Sequence[str]) -> dict[str, list[str]]:
    """The values of each category in their order: what is one-hot, a few each."""
    got = df.unpivot([], list(categories), "feature", "value").filter("value is not null").groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("values"))
    found = {r["feature"]: r["values"] for r in got.collect()}
    return {c: found.get(c, []) for c in categories}


@dataclass(frozen=True)
class Filling:
    """What preprocessing learns: modes, exact medians, and the values that are one-hot."""

    modes: dict[str, str]
    medians: dict[str, float]
    values: dict[str, list[str]]

    @classmethod
    def of(cls, df: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> Filling:
        modes = fill_modes(df, categories)
        return cls(modes, fill_medians(df, numbers), category_values(df, categories))

    def filled(self, df: DataFrame) -> DataFrame:
        """Numbers as c_filled, categories in place."""
        number = lambda c, m: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m))
        return sanitize_inputs(df).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.modes.items()} | {f"{c}_filled": number(c, m) for c, m in self.medians.items()})

    def encoded(self, df: DataFrame) -> DataFrame:
        """df with features: the numbers, then a 0 or 1 for each value of each category and for any other."""
        hot = [F.when(F.col(c).isin(values) if v is None else F.col(c) == v, 0.0 if v is None else 1.0).otherwise(1.0 if v is None else 0.0) for c, values in self.values.items() for v in [*values, None]]
        made = F.array(*[F.col(f"{c}_filled") for c in self.medians], *hot)
        return self.filled(df).withColumn("features", made)

    def names(self) -> list[tuple[str, str]]:
        """(encoded column, source column) in the order of the features."""
        return [(c, c) for c in self.medians] + [(f"{c}={v}", c) for c, values in self.values.items() for v in [*values, "<other>"]]


def preprocess(numbers: Sequence[str], categories: Sequence[str]) -> list:
    """For a linear model, on filled columns: standardised numbers, one-hot categories with unknown values in a slot of their own."""
    return [
        VectorAssembler(inputCols=[f"{c}_filled" for c in numbers], outputCol="numbers", handleInvalid="keep"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
        StringIndexer(inputCols=list(categories), outputCols=[f"{c}_index" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories], dropLast=False), VectorAssembler(inputCols=["scaled", *[f"{c}_hot" for c in categories]], outputCol="features"),
    ]


@dataclass
class Model:
    """A fitted model with what filling in needs: a pipeline of Spark ML (logistic) or boosted trees."""

    filling: Filling
    kind: str
    fitted: PipelineModel | None = None
    trees: Boosted | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """df with features, an array in the order of feature_names()."""
        if self.trees is not None:
            return self.filling.encoded(df)
        got = self.fitted.transform(self.filling.filled(df))
        return got.withColumn("features", vector_to_array("features"))

    def scored(self, df: DataFrame) -> DataFrame:
        """df with features and predicted_pd."""
        got = self.transform(df)
        if self.trees is None:
            return got.withColumn("predicted_pd", vector_to_array("probability")[1])
        sent = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-sent.value.margins(rows_of(x, len(sent.value.cuts))))))

        return got.withColumn("predicted_pd", score("features"))

    def feature_names(self) -> list[tuple[str, str]]:
        return self.filling.names()


def rows_of(x: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def fit(df: DataFrame, kind: str = "logistic", *, numbers: Sequence[str] = NUMBERS, categories: Sequence[str] = CATEGORIES, balanced: bool = False, trees: int = 200, hold: bool = True) -> Model:
    """kind: logistic (L2, one retry with more iterations) or trees. Rows without target are left out. A fit reads its inputs a dozen times; with hold Spark keeps these columns for its time, so that what makes them (joins, ranks) runs once."""
    df = df.filter("target is not null").select(*[c for c in dict.fromkeys(("target", *numbers, *categories, "annual_inc", "dti")) if c in df.columns])
    if not hold:
        return _fitted(df, kind, numbers, categories, balanced, trees)
    # Spark leaves a shuffle's partitions as they are in what it keeps; as many as cores need make each pass send the driver less.
    # Trees draw rows by their place, so theirs stay as they are.
    if kind != "trees":
        df = df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fitted(df, kind, numbers, categories, balanced, trees)
    finally:
        df.unpersist()


def _fitted(df: DataFrame, kind: str, numbers: Sequence[str], categories: Sequence[str], balanced: bool, trees: int) -> Model:
    df = df.withColumn("label", F.col("target").cast("double"))
    filling = Filling.of(df, numbers, categories)
    weight = F.lit(1.0)
    if balanced:
        n, pos = df.agg(F.count("*"), F.sum("label")).first()
        weight = F.when(F.col("label") == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(n - pos, 1)))
    train = df.withColumn("weight", weight)
    if kind == "trees":
        return Model(filling, kind, trees=boost(filling.encoded(train), len(numbers), len(filling.names()), Plan(trees=trees)))
    train = filling.filled(train)
    for most in (100, 400):
        fitted = Pipeline(stages=[*preprocess(numbers, categories), LogisticRegression(maxIter=most, regParam=1e-4, standardization=False, weightCol="weight")]).fit(train)
        if len(fitted.stages[-1].summary.objectiveHistory) <= most:
            break
    return Model(filling, kind, fitted=fitted)


def score_batch(model: Model, df: DataFrame, threshold: float) -> DataFrame:
    return model.scored(df).select("loan_id", "target", "predicted_pd").withColumn("predicted_class", K.flag_default(F.col("predicted_pd"), threshold))


def compact_model(df: DataFrame, inputs: int = 6, kind: str = "logistic", **how) -> Model:
    """A model of five or six inputs, of either kind; inputs out of range count as missing."""
    numbers, categories = {5: FIVE, 6: SIX}[inputs]
    return fit(df, kind, numbers=numbers, categories=categories, **how)


def full_refit(df: DataFrame, context: DataFrame, threshold: float, kind: str = "logistic", **how) -> DataFrame:
    """A model of all labeled rows, which it scores, joined with their context under its guards. Scores are a work table: the guards and the join read them, not the joins that made the rows."""
    labeled = df.filter("target is not null")
    return scored_context_join(written(score_batch(fit(labeled, kind, **how), labeled, threshold), "scores"), context, threshold)


def out_of_fold_scores(folds: DataFrame, kind: str = "logistic", **how) -> DataFrame:
    """Each row scored by a model that saw only the other folds, preprocessing included. The folds' models are fitted side by side: each is a chain of short jobs, which leave room for one another's. Spark keeps the columns they need for that time, so joins and ranks that make folds run once, not in each pass of each fit at once; the scores are a work table."""
    needed = dict.fromkeys(("loan_id", "target", "fold", *how.get("numbers", NUMBERS), *how.get("categories", CATEGORIES), "annual_inc", "dti"))
    folds = folds.select(*[c for c in needed if c in folds.columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())
        with ThreadPoolExecutor(max(1, len(numbers))) as pool:
            models = list(pool.map(inheritable_thread_target(folds.sparkSession)(lambda k: fit(folds.filter(F.col("fold") != k), kind, **({"hold": False} | how))), numbers))
        scored = [score_batch(m, folds.filter(F.col("fold") == k), 0.5).withColumn("fold", F.lit(k)) for k, m in zip(numbers, models, strict=True)]
        none = folds.select("loan_id", "target", F.lit(0.5).alias("predicted_pd"), F.lit(1).alias("predicted_class"), "fold")
        return written(reduce(DataFrame.unionByName, scored) if scored else none, "scores")
    finally:
        folds.unpersist()


def linear_contributions(model: Model, df: DataFrame, key: str = "loan_id") -> DataFrame:
    """key, feature (source column), contribution; their sum and the intercept are the margin."""
    coefficients = model.fitted.stages[-1].coefficients.toArray().tolist()
    sources = [s for _, s in model.feature_names()]
    per = F.zip_with("features", F.array(*map(F.lit, coefficients)), lambda a, b: a * b)
    out = [F.struct(F.lit(f).alias("feature"), sum((F.get("per", i) for i, s in enumerate(sources) if s == f), F.lit(0.0)).alias("contribution")) for f in dict.fromkeys(sources)]
    return model.transform(df).select(key, per.alias("per")).select(key, F.explode(F.array(*out)).alias("c")).select(key, "c.*")


def leaf_paths(nodes: list) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Of each leaf its value, and per feature on the way to it: the share of the rows that stay if the feature is unknown, and the interval (low, high] of its values that lead there."""
    todo: list[tuple[int, dict]] = [(0, {})]
    while todo:
        at, path = todo.pop()
        f, threshold, left, right, cover, value = nodes[at]
        if f < 0:
            yield value, path
            continue
        zero, low, high = path.get(f, (1.0, -np.inf, np.inf))
        todo.append((right, path | {f: (zero * nodes[right][4] / cover, max(low, threshold), high)}))
        todo.append((left, path | {f: (zero * nodes[left][4] / cover, low, min(high, threshold))}))


def pattern_values(zeros: Sequence[float]) -> np.ndarray:
    """Row p: the Shapley value of each feature of a leaf of value 1, if the features of the bits of p lead to it and the others don't. A known feature counts as 1 or 0, an unknown one as its zero."""
    m = len(zeros)
    bit = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(bool)
    at = np.where(bit[None], bit[:, None].astype(float), np.asarray(zeros, float)).prod(axis=2)  # pattern, known
    size = bit.sum(axis=1)
    # Of each known set: what it counts for a feature in it, with the rest already known, and against one that isn't.
    share = np.array([1 / (m * math.comb(m - 1, k)) for k in range(m)])
    weight = np.where(bit, share[np.maximum(size - 1, 0)][:, None], -share[np.minimum(size, m - 1)][:, None])
    return at @ weight


def explainer(trees: list[list]) -> tuple[list[tuple], float]:
    """What path_contributions needs of the trees, once a task: the leaves' features with their intervals and the values of each pattern. Leaves of the same features and intervals are taken together; trees of a few cuts share many."""
    leaves, expected = {}, 0.0
    for nodes in trees:
        expected += _mean(nodes, 0)
        for value, path in leaf_paths(nodes):
            if path:
                features = tuple(sorted(path))
                zeros, lows, highs = (tuple(x) for x in zip(*(path[f] for f in features), strict=True))
                made = value * pattern_values(zeros)
                key = (features, lows, highs)
                leaves[key] = leaves[key] + made if key in leaves else made
    return [(*key, made) for key, made in leaves.items()], expected


def path_contributions(trees: list[list], x: np.ndarray, ready: tuple[list[tuple], float] | None = None) -> tuple[np.ndarray, float]:
    """TreeSHAP, leaf by leaf for all rows at once: for each row, a value per feature whose sum with the expected value is the margin. A leaf's features are few (the depth), so the value of each pattern of met splits is worked out once."""
    leaves, expected = ready or explainer(trees)
    columns = np.ascontiguousarray(x.T, dtype=float)
    phi = np.zeros_like(columns)
    for features, lows, highs, values in leaves:
        pattern = np.zeros(columns.shape[1], dtype=np.int64)
        for i, (f, low, high) in enumerate(zip(features, lows, highs, strict=True)):
            pattern |= (~(columns[f] <= low) & ((columns[f] <= high) | (high == np.inf))).astype(np.int64) << i
        for i, f in enumerate(features):
            phi[f] += values[pattern, i]
    return phi.T, expected


#: Cells of a table of attributions.
TABLE = 4096


def contribution_tables(boosted: Boosted) -> tuple[list[tuple], float]:
    """The same sums by bins, once a worker: (features, per feature the stride-weighted interval of each bin, attributions of each cell). Leaves whose features are among another's share its table; where the intervals would make a table of more than TABLE cells, the rest has another one. Their size is bounded by the number of trees and their depth."""
    leaves, expected = explainer(boosted.nodes())
    place = [{float(v): i for i, v in enumerate(c)} for c in boosted.cuts]
    by: dict[tuple, list] = {}
    for features, lows, highs, made in sorted(leaves, key=lambda leaf: (-len(leaf[0]), leaf[0], leaf[1], leaf[2])):
        # A bin b holds values above cut b - 1 and up to cut b, so (low, high] is the bins from low's place + 1 to high's.
        spans = {f: (place[f][lo] + 1 if lo > -np.inf else 0, place[f][hi] + 1 if hi < np.inf else 256) for f, lo, hi in zip(features, lows, highs, strict=True)}
        own = features if features in by else next((g for g in by if set(features) <= set(g)), features)
        groups = by.setdefault(own, [])
        for edges, held in groups:
            more = {f: edges[f] | ({a, b} - {0, 256}) for f, (a, b) in spans.items()}
            if np.prod([len(more.get(f, edges[f])) + 1 for f in own]) <= TABLE:
                edges |= more
                held.append((features, spans, made))
                break
        else:
            groups.append(({f: set(spans[f]) - {0, 256} if f in spans else set() for f in own}, [(features, spans, made)]))
    tables = []
    for own, groups in by.items():
        for edges, held in groups:
            starts = [np.array([0, *sorted(edges[f])]) for f in own]
            shape = tuple(map(len, starts))
            cells = np.zeros((len(own), *shape))
            for features, spans, made in held:
                pattern = np.zeros((1,) * len(own), np.int64)
                for i, f in enumerate(features):
                    d = own.index(f)
                    inside = (starts[d] >= spans[f][0]) & (starts[d] < spans[f][1])
                    pattern = pattern + (inside.astype(np.int64) << i).reshape([-1 if k == d else 1 for k in range(len(own))])
                for i, f in enumerate(features):
                    cells[own.index(f)] += made[:, i][pattern]
            strides = np.cumprod([1, *shape[:0:-1]])[::-1]
            steps = [(np.searchsorted(s, np.arange(256), side="right") - 1) * k for s, k in zip(starts, strides, strict=True)]
            tables.append((own, steps, cells.reshape(len(own), -1)))
    return tables, expected + boosted.base


def table_contributions(tables: list[tuple], bins: np.ndarray) -> np.ndarray:
    """Attributions (feature, row) of binned rows: a look-up a table and feature."""
    phi = np.zeros(bins.shape)
    for own, steps, cells in tables:
        at = sum(step[bins[f]] for f, step in zip(own, steps, strict=True))
        for f, values in zip(own, cells, strict=True):
            phi[f] += values[at]
    return phi


def _mean(nodes: list, at: int) -> float:
    f, _, left, right, cover, value = nodes[at]
    return value if f < 0 else (nodes[left][4] * _mean(nodes, left) + nodes[right][4] * _mean(nodes, right)) / cover


#: What a row's attributions and the expected value may differ from its margin.
ADDITIVITY = 1e-3


def tree_contributions(model: Model, df: DataFrame, key: str = "loan_id") -> DataFrame:
    """key (any column), expected, phi: attributions in margin space per encoded column. Spark deals the rows; a task holds the trees, whose size is bounded by their number and depth. Each row's attributions must add up to its margin by the trees themselves, to ADDITIVITY, or the query fails."""
    sent = df.sparkSession.sparkContext.broadcast(model.trees)

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boosted = sent.value
        width = len(boosted.cuts)
        if not hasattr(boosted, "explained"):  # a worker keeps what is broadcast from task to task
            boosted.explained = contribution_tables(boosted)
        tables, mean = boosted.explained
        for batch in batches:
            bins = binned(rows_of(batch.column("features"), width), boosted.cuts)
            phi = table_contributions(tables, bins).T
            off = np.abs(mean + phi.sum(axis=1) - boosted.margins_of(bins)).max(initial=0.0)
            if not off <= ADDITIVITY:
                raise ValueError(f"attributions miss the margin by {off}")
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), mean)), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(phi).ravel()))], [key, "expected", "phi"])

    got = model.transform(df).select(key, "features")
    out = StructType([got.schema[key], StructField("expected", DoubleType()), StructField("phi", ArrayType(DoubleType()))])
    return got.mapInArrow(explained, out)


def group_contributions(encoded: DataFrame, names: Sequence[tuple[str, str]], key: str = "loan_id") -> DataFrame:
    """Encoded columns' attributions (key, phi) summed per source column, row by row."""
    sources = [s for _, s in names]
    sums = [F.struct(F.lit(f).alias("feature"), sum((F.get("phi", i) for i, s in enumerate(sources) if s == f), F.lit(0.0)).alias("contribution")) for f in dict.fromkeys(sources)]
    return encoded.select(key, F.explode(F.array(*sums)).alias("c")).select(key, "c.*")


def contributions(model: Model, df: DataFrame, key: str = "loan_id") -> DataFrame:
    """key, feature, contribution of either kind of model; with the expected value or the intercept they add up to the margin."""
    return linear_contributions(model, df, key) if model.trees is None else group_contributions(tree_contributions(model, df, key), model.feature_names(), key)


def gain_importance(model: Model) -> DataFrame:
    """Per encoded column with its source: gain (the loss its splits took away), weight (how many they are) and cover (the second-order weight of the rows they cut), and its part of all gain. All from the histograms of the fit; a row an encoded column."""
    got = model.trees.importance()
    whole = sum(g for g, _, _ in got)
    rows = [(n, s, g, w, c, g / whole if whole else 0.0) for (n, s), (g, w, c) in zip(model.feature_names(), got, strict=True)]
    return SparkSession.getActiveSession().createDataFrame(rows, "encoded string, feature string, gain double, weight int, cover double, gain_share double")


def global_importance(contributions: DataFrame, gain: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """feature, mean_abs, rank; with gain (gain_importance()) also gain and encoded, the number of encoded columns; with values (loan_id, feature, value: the numeric inputs) also rho and direction, `category` where a feature has no numeric values."""
    if values is not None:  # read by each feature's direction several times: explained once, met with the values once
        contributions = written(contributions, "contributions")
    got = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    if gain is not None:
        of = gain.groupBy("feature").agg(F.sum("gain").alias("gain"), F.count("*").alias("encoded"))
        got = got.join(of, "feature", "left").withColumns({"gain": F.coalesce("gain", F.lit(0.0)), "encoded": F.coalesce("encoded", F.lit(0))})
    if values is not None:
        said = None
        features = sorted(r["feature"] for r in values.select("feature").distinct().collect())  # a few inputs
        met = written(contributions.filter(F.col("feature").isin(features)).join(values.filter("value is not null"), ["loan_id", "feature"]).select("loan_id", "feature", "value", "contribution"), "directions")
        for feature in features:
            one = direction_summary(met.filter(F.col("feature") == feature).drop("feature"), "value", "contribution").select(F.lit(feature).alias("feature"), "rho", "direction")
            said = one if said is None else said.unionByName(one)
        if said is not None:
            got = got.join(said, "feature", "left").withColumn("direction", F.coalesce("direction", F.lit("category")))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))


def top_contributors(contributions: DataFrame, n: int = 5) -> DataFrame:
    """Per loan and sign, the n largest contributions with their rank."""
    sign = F.when(F.col("contribution") > 0, "raises").when(F.col("contribution") < 0, "lowers")
    w = Window.partitionBy("loan_id", "sign").orderBy(F.desc(F.abs("contribution")), "feature")
    return contributions.withColumn("sign", sign).filter("sign is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def validate_overrides(scenarios: DataFrame, seen: dict[str, list] | None = None) -> DataFrame:
    """scenarios with accepted and the reasons against each: a column that may not be overridden, a value that isn't finite or out of its range, a term that isn't offered, and with seen (category: values in training) a category that the model hasn't seen."""
    seen = seen or {}
    if unknown := sorted(set(scenarios.columns).difference(("scenario", "loan_id", *OVERRIDABLE, *seen))):
        raise ValueError(f"columns that may not be overridden: {unknown}")
    rules = []
    for c, (least, most) in RANGES.items():
        x = F.col(c).cast("double")
        above = x > least if c == "annual_inc" else x >= least
        rules.append(F.when(x.isNotNull() & ~(above & (x <= most) & ~F.isnan(x)), f"{c} out of range"))
    rules.append(F.when(F.col("term_months").isNotNull() & ~F.col("term_months").isin(*TERMS), "term not 36 or 60"))
    rules += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(values)), f"{c} not seen in training") for c, values in seen.items() if c in scenarios.columns]
    reasons = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return scenarios.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def validate_inputs(df: DataFrame, bounds: DataFrame, categories: DataFrame) -> DataFrame:
    """loan_id, reasons, accepted: inputs outside the training bounds (feature, low, high) or of a category value that training hasn't (feature, value). A missing input is accepted: it's filled in."""
    low_high = {r["feature"]: (r["low"], r["high"]) for r in bounds.collect()}  # a row a feature
    rules = [F.when(F.col(c).isNotNull() & ~F.col(c).cast("double").between(lo, hi), f"{c} out of the training range") for c, (lo, hi) in sorted(low_high.items()) if c in df.columns]
    got = df
    for c in sorted(r["feature"] for r in categories.select("feature").distinct().collect()):
        known = categories.filter((F.col("feature") == c) & F.col("value").isNotNull()).select(F.col("value").alias(c), F.lit(True).alias(f"_{c}"))
        got = got.join(known, c, "left")
        rules.append(F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), f"{c} not seen in training"))
    reasons = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return got.select("loan_id", reasons.alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


#: What is recomputed after an override.
DEPENDENT = ("loan_to_income_ratio", "loan_amount_band", "income_band", "dti_band")


def apply_overrides(loans: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each accepted scenario's loan with its overrides in place and what depends on them recomputed, and each such loan as it is (scenario null)."""
    ok = validate_overrides(scenarios).filter("accepted").select("scenario", "loan_id", *[F.col(c).alias(f"new_{c}") for c in OVERRIDABLE])
    changed = loans.join(ok, "loan_id").withColumns({c: F.coalesce(F.col(f"new_{c}").cast(dict(loans.dtypes)[c]), F.col(c)) for c in OVERRIDABLE}).drop(*[f"new_{c}" for c in OVERRIDABLE])
    base = loans.join(ok.select("loan_id").distinct(), "loan_id", "left_semi").withColumn("scenario", F.lit(None).cast("string"))
    made = {
        "loan_to_income_ratio": safe_ratio(F.col("loan_amnt").cast("double"), F.col("annual_inc").cast("double")), "loan_amount_band": band(F.col("loan_amnt"), LOAN_BANDS, right=True),
        "income_band": band(F.col("annual_inc"), INCOME_BANDS, right=True), "dti_band": band(F.col("dti"), DTI_BANDS, right=True), "is_what_if": F.col("scenario").isNotNull(),
    }
    return changed.unionByName(base).withColumns(made)


def what_if(loans: DataFrame, scenarios: DataFrame, score: Column | Model, threshold: float) -> DataFrame:
    """The results: score, class, tier and losses of each scenario and of each loan as it is."""
    got = apply_overrides(loans, scenarios)
    if isinstance(score, Model):
        got = score.scored(got)
    else:
        got = got.withColumn("predicted_pd", score)
    p = F.col("predicted_pd")
    got = K.expected_loss_dataset(got).withColumns({"predicted_class": K.flag_default(p, threshold), "risk_score": K.risk_score(p), "credit_score": K.credit_score(p), "risk_tier": K.tier_label(K.pd_tier(p, threshold))})
    return got.select("loan_id", "scenario", "is_what_if", *OVERRIDABLE, *DEPENDENT, "predicted_pd", "predicted_class", "risk_score", "credit_score", "risk_tier", "expected_loss", "el_lgd_30", "el_lgd_45", "el_lgd_60")


def what_if_inputs(loans: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario, loan_id, input_role (baseline, current), the fields that may be overridden and what depends on them: two rows for each accepted scenario."""
    got = apply_overrides(loans, scenarios)
    columns = [*OVERRIDABLE, *DEPENDENT]
    current = got.filter("is_what_if").select("scenario", "loan_id", F.lit("current").alias("input_role"), *columns)
    base = got.filter("not is_what_if").select("loan_id", F.lit("baseline").alias("input_role"), *columns)
    return current.unionByName(current.select("scenario", "loan_id").join(base, "loan_id").select("scenario", "loan_id", "input_role", *columns))


def what_if_attributions(model: Model, loans: DataFrame, scenarios: DataFrame) -> DataFrame:
    """loan_id, scenario, feature, contribution for each accepted scenario and each loan as it is (scenario null), by a model of either kind."""
    got = apply_overrides(loans, scenarios).withColumn("row", F.struct("loan_id", "scenario"))
    return contributions(model, got, "row").select("row.loan_id", "row.scenario", "feature", "contribution")
