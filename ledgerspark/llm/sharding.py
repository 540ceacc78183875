"""Sharding by rendezvous (highest random weight) hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    """An exponential variate over the weight: the least of all shards wins with a chance in proportion to its weight."""
    return -F.log(unit(key, shard, seed=seed)) / weight


def rendezvous(key: Column, weights: Sequence[float], *, seed: int = 10) -> tuple[Column, Column]:
    """(shard, its score) of a key. Adding a shard changes no other shard's score, so a row moves into the new shard or stays."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    best = F.array_min(F.transform(shards, lambda s: F.struct(_score(key, s["shard"], s["weight"], seed).alias("score"), s["shard"].alias("shard"))))
    return best["shard"], best["score"]


def shard_documents(docs: DataFrame, weights: Sequence[float], *, id_col: str = "doc_id", text_col: str = "text", next_weight: float = 1.0, rows_per_bucket: int = 250_000, seed: int = 10) -> DataFrame:
    """Every row with its shard, its slot in the shard and its shard once one more is there.

    Columns: doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot, grown_shard; more columns of the input,
    of whatever name, aren't read. A null text counts as empty. A null key is a key like another. Repeated rows go to
    one shard and get slots of their own. An empty table gives an empty one.

    Texts may be of any length. Slots: a shard is split by a hash of the key and the text's figures, so that no id's rows
    need to be in one, into buckets of about rows_per_bucket rows, numbered within
    themselves; the buckets' counts, a few rows for each shard, are summed up to the first slot of each. So no task
    orders a whole shard, and no row's text is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    shard, score = rendezvous(F.col("doc_id"), weights, seed=seed)
    n = len(weights)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    buckets = max(8, math.ceil(docs.count() / n / rows_per_bucket))
    rows = (
        rows.withColumns({"shard": shard, "score": score})
        .withColumn("grown_shard", F.when(_score(F.col("doc_id"), F.lit(n), F.lit(float(next_weight)), seed) < F.col("score"), F.lit(n)).otherwise(F.col("shard")))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "size"), F.lit(buckets)))
        .drop("score")
    )
    firsts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    firsts = firsts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("within", within)
        .join(firsts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op10_rendezvous(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 40)
