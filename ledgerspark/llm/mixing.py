"""Mixing sources to target weights by pivotal dependent rounding of fractional copies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, unit, written

#: Copies of a document that a mix takes at most, and documents that one step of the tree pairs off in one group.
CAP = 3
GROUP = 64
#: Rows alike that are numbered at once.
ALIKE = 10_000


def source_targets(sizes: DataFrame, *, cap: float = CAP, cycle: int = 3) -> DataFrame:
    """Per source: source_size, n, target. Sources by code point, null last, weigh 1 .. cycle and again from 1.

    The targets share out the sum of all sizes by weight; a target stops at cap times its source's size and the others
    share the excess. That is one water level: in the order of cap over weight, the sources before some place are
    capped and the rest get level times weight, so running sums find it without a loop. Rows here are sources, one
    each, and the two windows order them whole; documents are only counted.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(cycle)) + 1).cast("double")).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    per = per.withColumn("reached", F.max(F.when(F.col("open"), 1).otherwise(0)).over(by_ratio))
    per = per.withColumn("final", F.max(F.struct(F.when(F.col("open"), -F.row_number().over(by_ratio)).alias("at"), F.col("level").alias("level"))).over(whole)["level"])
    target = F.when(F.col("reached") == 1, F.col("final") * F.col("weight")).otherwise(F.col("most"))
    return per.select("source", "source_size", "n", F.least(target, F.col("most")).alias("target"))


def _paired(items: Column, seed: int) -> Column:
    """Pairs off the items of an array in turn: struct(done, rest), where rest is the one that may still be a fraction.

    An item has mass between 0 and its size. Of two items, one takes from the other until one is empty or full. The
    chance of either way is such that each item's expected mass stays as it was; the sum of the two always does.
    """

    def step(acc: Column, x: Column) -> Column:
        cur = acc["rest"]
        up, down = F.least(cur["full"] - cur["mass"], x["mass"]), F.least(cur["mass"], x["full"] - x["mass"])
        rises = unit(cur["key"], x["key"], seed=seed) * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        cur_ends = F.when(rises, cur["full"] - cur["mass"] <= x["mass"]).otherwise(cur["mass"] <= x["full"] - x["mass"])
        one = lambda of, mass: F.struct(of["key"].alias("key"), of["doc"].alias("doc"), of["full"].alias("full"), mass.alias("mass"))
        # What ends is empty or full to the last bit, however the sums round.
        ended = F.when(cur_ends, one(cur, F.when(rises, cur["full"]).otherwise(F.lit(0.0)))).otherwise(one(x, F.when(rises, F.lit(0.0)).otherwise(x["full"])))
        stays = F.when(cur_ends, one(x, x["mass"] - moved)).otherwise(one(cur, cur["mass"] + moved))
        return F.struct(F.array_append(acc["done"], ended).alias("done"), stays.alias("rest"))

    first = F.struct(F.slice(items, 1, 0).alias("done"), items[0].alias("rest"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), first, step)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP, cycle: int = 3, group: int = GROUP, seed: int = 2) -> DataFrame:
    """Every row with the words that a mix takes of it: doc_id, again, size, source_size, target, copies, taken.

    A source whose target is f times its size takes floor(f) copies of each document; what is left is a fraction of a
    copy, as mass in words, and is rounded. Groups of about `group` documents of a source, dealt by a hash of the key,
    pair off their masses and keep one residual; the residuals meet in the next level's groups, a tree of about
    log(n) / log(group) levels, each a shuffle over the level's items by (source, bucket). A source may hold any share
    of the rows: no group grows with it. The last residual of a source goes to the nearer end, so the taken words
    differ from the target by half a document at most.

    Decided: a null text has size 0 and takes nothing, as does a text without words. A null source is a source. Rows
    repeated with one doc_id are numbered from 1 in `again` and decided each by itself. Reruns agree: the hashes see keys and the seed
    only. More columns aren't read. An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # Rows alike in what counts here are interchangeable: they are counted, which combines before the shuffle, and numbered from their count.
    alike = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    blocks = alike.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / ALIKE)))).withColumn("first", F.col("block") * ALIKE + 1)
    numbers = F.explode(F.sequence("first", F.least(F.col("first") + ALIKE - 1, F.col("rows"))))
    sizes = written(blocks.select("doc_id", "source", "size", numbers.alias("again")).withColumn("again", F.col("again").cast("int")), "mix-sizes")
    targets = written(source_targets(sizes, cap=cap, cycle=cycle).withColumn("source_no", F.xxhash64("source", F.col("source").isNull())), "mix-targets")
    most = targets.agg(F.max("n")).first()[0] or 0

    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select("doc_id", "again", "size", "source_size", "target", "source_no", "n", F.floor(share).alias("whole"), (share - F.floor(share)).alias("part"))
    out = ["doc_id", "again", "size", "source_size", "target"]
    of = lambda copies: [F.col(c) for c in out] + [F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int").alias("copies")]
    sound = joined.filter((F.col("part") <= 0) | (F.col("size") <= 0)).select(*of(F.col("whole")))

    doc = F.struct(*out, "whole")
    items = joined.filter((F.col("part") > 0) & (F.col("size") > 0)).select(
        "source_no", F.col("n").alias("buckets"), F.xxhash64(F.lit(seed), "doc_id", "again").alias("bucket"),
        F.struct(F.xxhash64("doc_id", "again").alias("key"), doc.alias("doc"), F.col("size").cast("double").alias("full"), (F.col("part") * F.col("size")).alias("mass")).alias("item"),
    )
    decided, left = [], most
    for level in range(1, max(1, math.ceil(math.log(max(2, most), group))) + 8):
        left = math.ceil(left / group)
        items = items.withColumn("buckets", F.ceil(F.col("buckets") / F.lit(group))).withColumn("bucket", F.pmod("bucket", "buckets"))
        grouped = items.groupBy("source_no", "bucket").agg(F.max("buckets").alias("buckets"), F.sort_array(F.collect_list("item")).alias("items"))
        step = written(grouped.select("source_no", "bucket", "buckets", _paired(F.col("items"), seed + level).alias("got")), f"mix-level{level}")
        decided.append(step.select(F.explode("got.done").alias("item")))
        items = step.select("source_no", "buckets", "bucket", F.col("got.rest").alias("item"))
        if left <= 1:
            break
    nearer = F.col("item.mass") * 2 >= F.col("item.full")
    decided.append(items.select(F.col("item").withField("mass", F.when(nearer, F.col("item.full")).otherwise(F.lit(0.0))).alias("item")))
    for d in decided:
        sound = sound.unionByName(d.select("item.doc.*", "item.mass").select(*of(F.col("whole") + F.when(F.col("mass") > 0, 1).otherwise(0))))
    return sound.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def op2_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
