"""A corpus pipeline of five stages, each an operator of ledgerspark.llm whose decisions take effect on the documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ledgerspark.llm import bpe, langid, mixing, near_dup, pii
from ledgerspark.llm.common import table, written


def _named(c: str, within: str = "") -> Column:
    """A column by its name, whatever characters are in it."""
    return F.col(within + "`" + c.replace("`", "``") + "`")


def _rows(docs: DataFrame) -> DataFrame:
    """Each row's text, and its other columns in one, so that none of their names meets one of an operator."""
    return docs.select(F.struct(*[_named(c) for c in docs.columns if c != "text"]).alias("row"), "text")


def _digest(docs: DataFrame) -> Column:
    """A hash of all values of a row, nulls told from values by their places. Rows of one digest count as copies of one another."""
    value = lambda f: F.to_json(_named(f.name)) if isinstance(f.dataType, MapType) else _named(f.name)
    return F.xxhash64(*[x for f in docs.schema for x in (value(f).isNull(), value(f))])


def _back(docs: DataFrame, rows: DataFrame, **changed) -> DataFrame:
    return rows.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("text") if c == "text" else _named(c, "row.").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with a narrow margin between languages go; a missing lang is filled in.

    Nulls: a null text has no letters and goes; null ids, sources and counts stay as they are. Texts of any length are
    read whole. Repeated rows are judged alike. Where no row has a lang, none is learned and all go. An empty table
    gives an empty one. Other columns, of whatever name, come through.
    """
    learned = langid.dictionaries(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    rows = langid.predict(_rows(docs), learned).filter(~F.col("rejected"))
    return _back(docs, rows, lang=F.coalesce(F.col("row.lang"), F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays.

    Rows that share a doc_id are one document: one of them stays, the same on every run (that of the smallest hash of
    its values). Rows without doc_id can't be named and all stay, as do documents without words, which have no
    duplicates. Other columns, of whatever name, come through. An empty table gives an empty one.
    """
    gone = near_dup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    columns = [_named(c) for c in docs.columns]
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(columns)
    again = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns), _digest(docs)).alias("row")).select(*[_named(c, "row.").alias(c) for c in docs.columns])
    return kept.join(again, "doc_id", "left_anti").select(columns).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, and n_chars follows.

    All rows stay. A null or empty text stays as it is, with its length. Repeated rows are changed alike. The labelers'
    reliabilities and the classifier are estimated on the rows of this stage. An empty table gives an empty one.
    """
    rows = pii.annotate(_rows(docs), with_text=True).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return _back(docs, rows, n_chars=F.length("text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none included.

    A document without words, or with a null text, is taken no times; a null source is a source. The mix knows a
    document by its doc_id; rows that share one, or have none, it knows by a hash of all their values, and decides each
    by itself. Rows alike in every value are decided each by itself too, and as they are interchangeable their copies are
    made from one of them. So reruns agree, however the rows are partitioned. Other columns, of whatever name, come
    through. An empty table gives an empty one.
    """
    keyed = docs.withColumn("mix key", F.col("doc_id").cast("long"))
    again = written(docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"), "mix-again")
    several = not again.isEmpty()
    if several:
        digest, shared = _digest(docs), again.filter("doc_id is not null").withColumn("mix shared", F.lit(True))
        named = docs.filter("doc_id is not null").withColumn("mix digest", digest).join(shared, "doc_id", "left")
        named = named.withColumn("mix key", F.when(F.col("mix shared"), F.col("mix digest")).otherwise(F.col("doc_id").cast("long"))).drop("mix shared", "mix digest")
        keyed = named.unionByName(docs.filter("doc_id is null").withColumn("mix key", digest))
    rows = keyed.select(F.col("mix key").alias("key"), F.struct(*[_named(c) for c in docs.columns if c != "text"]).alias("row"), "text")
    taken = mixing.mix(rows.select(F.col("key").alias("doc_id"), F.col("row.source").alias("source"), "text"))
    taken = written(taken.filter("copies > 0").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").cast("int").alias("copies"), F.max("again").alias("again")), "mix-taken")
    if several:
        alike = rows.groupBy("key").count().filter("count > 1").select("key")
        one = rows.join(alike.hint("merge"), "key", "left_semi").groupBy("key").agg(F.any_value(F.struct("row", "text")).alias("one")).select("key", "one.row", "one.text")
        rows = rows.join(alike.hint("merge"), "key", "left_anti").unionByName(one)
    rows = rows.join(taken.hint("merge"), "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _back(docs, rows)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of the ids and of what they decode to, a row for each row, null and empty texts with no ids. An empty table gives an empty one."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]

#: No SQL expresses compression, sketches or BPE: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
