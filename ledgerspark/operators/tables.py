"""Business tables, joins, unions and dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as K
from ..functions.cleaning import COUNTRY
from .policy import eligible, policy_class, policy_table, post_loan

FUNNEL = ("application_id", "application_date", "requested_amount", "state_code", "zip_code", "purpose", "decision")


def project(df: DataFrame, columns: tuple[str, ...], *, strict: bool = False) -> DataFrame:
    """The columns that are there, in the table's order; the key must be, and with strict it must be non-null and unique."""
    if columns[0] not in df.columns:
        raise ValueError(f"{columns[0]} is missing")
    got = df.select(*[c for c in columns if c in df.columns])
    if strict:
        require_grain(got, columns[0])
    return got


def loan_outcome(df: DataFrame, *, strict: bool = False) -> DataFrame:
    """The status, the target and every column that is known only after the loan."""
    return project(df, ("loan_id", "loan_status", "target", *post_loan(df.columns)), strict=strict)


def labeled_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("target").isNotNull())


def grain(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null_keys, duplicate_keys (rows beyond the first of their key). The count of each key combines before the shuffle."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    null = F.col(key).isNull()
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(~null, F.col("n") - 1)), F.lit(0)).alias("duplicate_keys"))


def require_grain(df: DataFrame, key: str) -> None:
    got = grain(df, key).first()
    if got["null_keys"] or got["duplicate_keys"]:
        raise ValueError(f"{key} isn't a key: {got.asDict()}")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Meeting:
    """All guards of a join in one pass: the sides, each with what rules ask of its rows, as one tagged union, grouped by the key. A rule is a condition on a key's group; require() counts the keys that break each, and raises if any does."""

    def __init__(self, key: str = "loan_id"):
        self.key, self.names, self.sides, self.values, self.rules = key, [], [], [], []

    def side(self, name: str, df: DataFrame, bad: Column | None = None, values: Sequence[str] = (), *, unique: bool = True) -> Meeting:
        """A side whose key must be there and unique. bad: rows that break its own rules; values: columns that rules compare."""
        flag = F.lit(False) if bad is None else F.coalesce(bad, F.lit(True))
        made = [F.struct(F.col(c).alias("v")).alias(f"{name} {c}") for c in values]
        self.names.append(name)
        self.sides.append(df.select(F.col(self.key), F.lit(name).alias("_side"), flag.alias("_bad"), *made))
        self.values += [f"{name} {c}" for c in values]
        if unique:
            return self.rule(f"{name}: {self.key} isn't a key", (self.rows(name) > 1) | (F.col(self.key).isNull() & (self.rows(name) > 0)))
        return self

    def rows(self, name: str) -> Column:
        return _quoted(f"rows {name}")

    def rule(self, what: str, broken: Column) -> Meeting:
        self.rules.append((what, broken))
        return self

    def sound(self, name: str, what: str, among: str | None = None) -> Meeting:
        """No bad row of a side; with among, of keys that another side has."""
        broken = _quoted(f"bad {name}") > 0
        return self.rule(f"{name}: {what}", broken if among is None else broken & (self.rows(among) > 0))

    def covers(self, a: str, b: str) -> Meeting:
        """Every key of a is in b."""
        return self.rule(f"{b} lacks ids of {a}", (self.rows(a) > 0) & (self.rows(b) == 0))

    def equal(self, a: str, b: str, columns: Sequence[str]) -> Meeting:
        """Where both have the key, these columns are equal, null with null."""
        both = (self.rows(a) > 0) & (self.rows(b) > 0)
        for c in columns:
            self.rule(f"{a} and {b} differ in {c}", both & ~_quoted(f"{a} {c}").eqNullSafe(_quoted(f"{b} {c}")))
        return self

    def require(self) -> None:
        union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), self.sides)
        names = self.names
        counts = [F.count_if(F.col("_side") == n).alias(f"rows {n}") for n in names] + [F.count_if((F.col("_side") == n) & F.col("_bad")).alias(f"bad {n}") for n in names]
        per = union.groupBy(self.key).agg(*counts, *[F.max(_quoted(v)).alias(v) for v in self.values])
        got = per.agg(*[x for i, (_, broken) in enumerate(self.rules) for x in (F.count_if(broken).alias(f"n{i}"), F.min(F.when(broken, F.coalesce(F.col(self.key).cast("string"), F.lit("null")))).alias(f"e{i}"))]).first()
        if said := [f"{what} ({got[f'n{i}']} ids, such as {got[f'e{i}']})" for i, (what, _) in enumerate(self.rules) if got[f"n{i}"]]:
            raise ValueError("; ".join(said))


def canonical_join(application: DataFrame, borrower: DataFrame, credit: DataFrame, outcome: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row per application with its borrower, credit and target; strict: all sides' keys are checked first, in one pass."""
    if strict:
        Meeting().side("application", application).side("borrower", borrower).side("credit", credit).side("outcome", outcome).require()
    return application.join(borrower, "loan_id", "left").join(credit, "loan_id", "left").join(outcome.select("loan_id", "target"), "loan_id", "left")


def missing_ids(a: DataFrame, b: DataFrame, key: str = "loan_id") -> DataFrame:
    """Ids of a that b doesn't have."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def partition_rows(canonical: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """The canonical rows of these ids (loan_id, target). All must be found, each once, with the same target."""
    met = Meeting().side("ids", ids, values=["target"]).side("canonical rows", canonical, values=["target"], unique=False).covers("ids", "canonical rows").equal("ids", "canonical rows", ["target"])
    met.rule("canonical rows: several of one id", (met.rows("ids") > 0) & (met.rows("canonical rows") > 1)).require()
    return canonical.join(ids.select("loan_id"), "loan_id", "left_semi").select("loan_id", *[c for c in columns if c != "loan_id"])


def unsound_scores(threshold: float | None = None) -> Column:
    """A target that isn't 0 or 1, a probability out of [0, 1], or a class that doesn't follow the threshold."""
    sound = F.coalesce(F.col("target").isin(0, 1), F.lit(False)) & F.coalesce(F.col("predicted_pd").between(0, 1), F.lit(False))
    if threshold is not None:
        sound = sound & F.coalesce(F.col("predicted_class") == K.flag_default(F.col("predicted_pd"), threshold), F.lit(False))
    return ~sound


def scored_context_join(predictions: DataFrame, context: DataFrame, threshold: float) -> DataFrame:
    """predictions (loan_id, target, predicted_pd, predicted_class) with their context, scores and tier. The context may not bring outcomes or scores of its own and must cover every loan."""
    if clash := sorted({"target", "predicted_pd", "predicted_class", "risk_tier"}.intersection(context.columns)):
        raise ValueError(f"context brings {clash}")
    met = Meeting().side("predictions", predictions, unsound_scores(threshold)).sound("predictions", "a target, probability or class out of range")
    met.side("context", context).covers("predictions", "context").require()
    p = F.col("predicted_pd")
    made = {"decision_threshold": F.lit(float(threshold)), "risk_score": K.risk_score(p), "credit_score": K.credit_score(p), "risk_tier": K.tier_label(K.pd_tier(p, threshold))}
    return predictions.join(context, "loan_id", "left").withColumns(made)


def align_predictions(predictions: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """loan_id, target and a column of probabilities for each model. Every model must have exactly these ids (loan_id, target), with these targets and probabilities in [0, 1]; all of it is checked in one pass over all models."""
    met, got = Meeting().side("ids", ids, values=["target"]), ids.select("loan_id", "target")
    for name, df in predictions.items():
        met.side(name, df, unsound_scores(), ["target"]).sound(name, "a target or probability out of range").covers("ids", name).covers(name, "ids").equal("ids", name, ["target"])
        got = got.join(df.select("loan_id", F.col("predicted_pd").alias(name)), "loan_id")
    met.require()
    return got


def accepted_rejected_by(accepted: DataFrame, rejected: DataFrame, by: str = "state_code") -> DataFrame:
    """Applications of either kind by a column, 0 where a side has none."""
    a, r = (x.groupBy(by).agg(F.count("*").alias(n)) for x, n in ((accepted, "accepted"), (rejected, "rejected")))
    return a.join(r, by, "full").select(by, F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


def star_join(facts: DataFrame, dates: DataFrame, states: DataFrame) -> DataFrame:
    """Facts with their date's and their state's dimension."""
    return facts.join(dates, facts["issue_d"] == dates["date"]).join(states, "state_code")


def row_count(df: DataFrame) -> DataFrame:
    """One row with the count; of Parquet files it comes from their footers."""
    return df.agg(F.count("*").alias("rows"))


def set_difference(a: DataFrame, b: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """Distinct rows that only one of two tables has, and which."""
    return a.subtract(b).withColumn("side", F.lit(sides[0])).unionByName(b.subtract(a).withColumn("side", F.lit(sides[1])))


#: Numbers of equal rejected applications that are made at once.
EQUALS = 10_000


def application_funnel(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both files on one schema. A rejected application has no id: it gets one from a digest of its values and its number among equals.

    Equal applications are interchangeable, so they are counted, which combines before the shuffle, and numbered as they
    are made again from their count. No task holds or orders a set of equals, however many those are.
    """
    yes = accepted.select(F.col("loan_id").alias("application_id"), F.col("issue_d").alias("application_date"), F.col("loan_amnt").alias("requested_amount"), "state_code", "zip_code", "purpose", F.lit("accepted").alias("decision"))
    own = F.substring(F.sha2(F.to_json(F.struct(*rejected.columns)), 256), 1, 32)
    counted = rejected.groupBy(*rejected.columns).agg(F.count("*").alias("n")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUALS))))
    first = F.col("block") * EQUALS + 1
    made = counted.withColumn("no", F.explode(F.sequence(first, F.least(first + EQUALS - 1, F.col("n")))))
    no = made.select(F.concat(F.lit("rejected-"), own, F.lit("-"), F.col("no")).alias("application_id"), "application_date", "requested_amount", "state_code", "zip_code", F.col("loan_title").alias("purpose"), F.lit("rejected").alias("decision"))
    return yes.unionByName(no)


def dim_date(*dates: tuple[DataFrame, str]) -> DataFrame:
    one = None
    for df, c in dates:
        d = df.select(F.col(c).cast("date").alias("date")).filter("date is not null").distinct()
        one = d if one is None else one.unionByName(d)
    d = F.col("date")
    return one.distinct().select(d, F.year(d).alias("year"), F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "yyyy-MM").alias("year_month"))


def dim_state(*states: tuple[DataFrame, str]) -> DataFrame:
    one = None
    for df, c in states:
        s = df.select(F.upper(F.col(c)).alias("state_code")).filter("state_code is not null").distinct()
        one = s if one is None else one.unionByName(s)
    return one.distinct().withColumn("country", F.lit(COUNTRY))


def reconcile(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, compared, mismatches: null-safe equality of joined values."""
    right = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in columns])
    got = a.select(key, *columns).join(right, key).agg(F.count("*").alias("compared"), *[F.sum((~F.col(c).eqNullSafe(F.col(f"b_{c}"))).cast("long")).alias(c) for c in columns])
    return got.unpivot("compared", columns, "column", "mismatches")


def ordered_matrix(df: DataFrame, rows: tuple[str, list], cols: tuple[str, list]) -> DataFrame:
    """Every combination of two fixed label lists with the values of df, null where it has none."""
    frame = df.sparkSession.createDataFrame([(r, i, c, j) for i, r in enumerate(rows[1], 1) for j, c in enumerate(cols[1], 1)], f"{rows[0]} string, row_order int, {cols[0]} string, col_order int")
    return frame.join(df, [rows[0], cols[0]], "left")


#: Distinct values up to which a column's are held as a set.
SET = 10_000


def column_profile(df: DataFrame, exact: Sequence[str] | None = None) -> DataFrame:
    """column_name, nulls, distinct_values of every column, in two passes over the table.

    The first has a sketch a column, which all columns fill from the same rows. It tells which columns have few values:
    their sets, SET values each at most or a little more, are counted exactly in the second pass. Of the others those of
    `exact` (all, if it isn't given) are counted exactly too, which makes a copy of each row for each of them; the rest
    show the sketch's estimate (within some 2 %).
    """
    kinds, name = dict(df.dtypes), lambda c: F.col(f"`{c}`")
    seen = df.agg(*[F.approx_count_distinct(name(c), 0.02).alias(c) for c in df.columns]).first()
    value = lambda c: name(c) + F.lit(0.0).cast(kinds[c]) if kinds[c] in ("double", "float") else name(c)  # noqa: E731  one zero

    def distinct(c: str) -> Column:
        if seen[c] <= SET:
            return F.size(F.collect_set(value(c))).cast("long")
        return F.countDistinct(name(c)) if exact is None or c in exact else F.lit(seen[c]).cast("long")

    got = df.agg(*[F.struct((F.count("*") - F.count(name(c))).alias("nulls"), distinct(c).alias("distinct_values")).alias(c) for c in df.columns])
    return got.unpivot([], [name(c) for c in df.columns], "column_name", "v").select("column_name", "v.nulls", "v.distinct_values")


def data_dictionary(df: DataFrame, grain: str = "loan_id") -> DataFrame:
    """A row a column: its type, policy class, whether it may feed a model, the table's grain, and its nulls and distinct values."""
    return F.broadcast(policy_table(df, grain)).join(column_profile(df), "column_name").select("column_name", "dtype", "policy_class", "model_eligible", "grain", "nulls", "distinct_values")


def feature_audit(df: DataFrame, most_values: int = 50) -> DataFrame:
    """A row a column: kind (by its type), missing, distinct values, what is done with it, and why it is left out: its class may not feed a model, or it is a date."""
    kind = lambda t: "date" if t in ("date", "timestamp", "timestamp_ntz") else "category" if t == "string" else "number"
    rows = [(c, kind(t), None if eligible(c) else f"class {policy_class(c)}") for c, t in df.dtypes]
    kinds = df.sparkSession.createDataFrame(rows, "feature_name string, kind string, class_why string")
    got = column_profile(df).withColumnsRenamed({"column_name": "feature_name", "nulls": "missing"}).join(F.broadcast(kinds), "feature_name").crossJoin(df.agg(F.count("*").alias("n")))
    got = got.withColumn("why", F.coalesce("class_why", F.when(F.col("kind") == "date", "date")))
    how = F.when(F.col("why").isNotNull(), "exclude").when(F.col("kind") == "category", "mode + one-hot").otherwise("median + scale")
    return got.select("feature_name", "kind", "missing", (F.col("missing") / F.nullif(F.col("n"), F.lit(0))).alias("missing_rate"), "distinct_values", "why", how.alias("preprocessing"), F.col("why").isNull().alias("used"), ((F.col("kind") == "category") & (F.col("distinct_values") > most_values)).alias("cardinality_concern"))


def share(c: Column) -> Column:
    """A count's part of the sum over all rows of a small result."""
    return c / F.sum(c).over(Window.partitionBy())
