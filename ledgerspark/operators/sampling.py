"""Deterministic splits and samples by exact rank of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import exists, publish

#: Ranges of the hash that split the ranking, and rows of a range beyond which there are more.
RANGES, ROWS, MOST_RANGES = 64, 1_000_000, 1 << 20
#: A split of fewer rows can miss the overall rate by more than the tolerance though it is cut exactly.
LEAST_AUDITED = 1000


def lot(key: Column, seed: int = 42) -> Column:
    """A digest of seed and key as text of 32 hexadecimal digits, for keys of any kind; other engines have the same one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ranked(df: DataFrame, by: str, key: str = "loan_id", seed: int = 42) -> DataFrame:
    """df with `rank` from 1 within each value of `by`, in the order of the digest, then the key, and `n`, its rows. Ranges of the digest's first 32 bits, as many as the rows need, rank their own rows; only their counts meet."""
    ranges = min(MOST_RANGES, max(RANGES, -(-df.count() // ROWS)))
    cut = df.withColumn("_h", lot(F.col(key), seed)).withColumn("_r", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * ranges, 32))
    counts = cut.groupBy(by, "_r").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    counts = counts.select(F.col(by).alias("_by"), F.col("_r").alias("_r2"), (F.sum("_n").over(w.orderBy("_r")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("n"))
    got = cut.join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_r") == F.col("_r2")))
    at = F.row_number().over(Window.partitionBy(by, "_r").orderBy("_h", F.col(key).cast("string")))
    return got.withColumn("rank", F.col("_before") + at).drop("_h", "_r", "_by", "_r2", "_before")


def stratified_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """loan_id, target, split: each class cut at whole ranks."""
    got = ranked(df.filter("target is not null").select("loan_id", "target"), "target", seed=seed)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + validation))
    return got.select("loan_id", "target", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "validation").otherwise("test").alias("split"))


def split_audit(split: DataFrame, labeled: DataFrame | None = None, tolerance: float = 0.005) -> DataFrame:
    """Per split: rows, positives, rate, coverage, within_tolerance; overlap, the ids that are in another split too; and with the labeled rows (loan_id), lost: how many of those no split has, and unknown: how many rows of the split aren't among them."""
    total = split.agg(F.avg("target").alias("overall"), F.count("*").alias("all"))
    several = split.groupBy("loan_id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")
    marked = split.join(several.select("loan_id", F.lit(1).alias("twice")), "loan_id", "left")
    known = marked.withColumn("known", F.lit(1)) if labeled is None else marked.join(labeled.select("loan_id", F.lit(1).alias("known")), "loan_id", "left")
    lost = split.sparkSession.range(1).select(F.lit(0).cast("long").alias("lost")) if labeled is None else labeled.join(split, "loan_id", "left_anti").agg(F.count("*").alias("lost"))
    got = known.groupBy("split").agg(F.count("*").alias("rows"), F.sum("target").alias("positives"), F.avg("target").alias("rate"), F.count("twice").alias("overlap"), (F.count("*") - F.count("known")).alias("unknown"))
    got = got.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(lost))
    return got.select("split", "rows", "positives", "rate", (F.col("rows") / F.col("all")).alias("coverage"), (F.abs(F.col("rate") - F.col("overall")) <= tolerance).alias("within_tolerance"), "overlap", "unknown", "lost")


def class_counts(split: DataFrame) -> DataFrame:
    """Rows of each class in each split."""
    return split.groupBy("split", "target").agg(F.count("*").alias("n"))


def first_n(df: DataFrame, n: int, key: str = "loan_id") -> DataFrame:
    """The n rows of the smallest keys, whole numbers first, in their order, then other keys by their text: each task keeps n at most."""
    return df.orderBy(F.col(key).try_cast("decimal(38,0)").asc_nulls_last(), F.col(key).cast("string")).limit(n)


def stratified_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About n rows, each class by its share (rounded down)."""
    got = ranked(df.filter("target is not null"), "target", seed=seed)
    total = F.broadcast(df.filter("target is not null").agg(F.count("*").alias("_all")))
    return got.crossJoin(total).filter(F.col("rank") <= F.floor(F.col("n") * n / F.col("_all"))).drop("_all", "rank", "n")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return ranked(df.filter("target is not null"), "target", seed=seed).withColumn("fold", F.pmod(F.col("rank"), F.lit(k)).cast("int")).drop("rank", "n")


def reuse_or_create_split(df: DataFrame, path: str, seed: int = 42) -> DataFrame:
    """The split published at path if there is one, else a new one, which is there when it is complete: a write that fails leaves nothing that counts as a split. Either way it must pass the audit: each labeled row with its target in one split, no other rows, all three splits, and rates within the tolerance. Never overwrites."""
    spark = df.sparkSession
    if not exists(spark, path):
        publish(stratified_split(df, seed=seed), path)
    old = spark.read.parquet(path)
    labeled = df.filter("target is not null").select("loan_id", "target")
    if not labeled.exceptAll(old.select("loan_id", "target")).isEmpty() or not old.select("loan_id", "target").exceptAll(labeled).isEmpty():
        raise ValueError(f"the split at {path} isn't one of these rows")
    audit = split_audit(old, labeled.select("loan_id")).collect()
    odd = [r.asDict() for r in audit if r["overlap"] or r["unknown"] or r["lost"] or not r["within_tolerance"] and r["rows"] >= LEAST_AUDITED]
    if odd or {r["split"] for r in audit} != {"train", "validation", "test"}:
        raise ValueError(f"the split at {path} fails its audit: {odd or [r['split'] for r in audit]}")
    return old
