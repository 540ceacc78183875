"""Hard negatives by inner product, found on R-trees packed by sort-tile-recursive."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a tree, of one of its leaves, and leaves of a node above them.
ROWS, LEAF, FAN = SHAPE = 8192, 64, 16
#: Bytes of vectors in a group of trees and in a slab of queries, which is what a task holds of each; queries that walk the trees together.
HELD, BATCH = 64 << 20, 256
#: Leaves that a query looks at in its first round on a tree; each further round takes twice as many.
FIRST = 4

BLOCK = "block long, label string, values int, rows int, ids binary, numbers binary, x binary, lows binary, highs binary"
_SHIFT = 1 << 190


def str_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive packing: the order of the rows in which each run of `leaf` rows is a leaf. Rows are sorted by their coordinate of the widest spread and cut into as many slabs as the root (of the coordinates left) of their leaves; each slab is cut by the next coordinate."""
    if not x.shape[1]:
        return np.arange(len(x))
    dims = np.argsort(-x.astype(float).var(axis=0), kind="stable").tolist()
    out, todo = [], [(np.arange(len(x)), 0)]
    while todo:
        at, k = todo.pop()
        pages = math.ceil(len(at) / leaf)
        if pages <= 1:
            out.append(at)
            continue
        slabs = min(pages, math.ceil(pages ** (1 / (len(dims) - k))))
        at = at[np.argsort(x[at, dims[k]], kind="stable")]
        step = leaf * math.ceil(pages / slabs)
        todo += [(at[lo : lo + step], k + 1) for lo in reversed(range(0, len(at), step))]
    return np.concatenate(out)


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        limits = np.iinfo(kind)
        if not x.size or (x.min() >= limits.min and x.max() <= limits.max):
            return x.astype(kind)
    return x


def labelled(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """number, vec_id, label, values, lead (the first coordinate), x (floor(scale * component) as bytes of 64-bit integers; what is beyond them counts as the nearest), written. Rows without id, label or vector, or with a null or a component that isn't finite, are left out."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            lists = batch.column("v")
            ends, raw = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().tobytes()
            x = [raw[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(batch))), batch.column("vec_id"), batch.column("label"), pa.array(np.diff(ends).astype(np.int32)), batch.column("lead"), pa.array(x, pa.binary())], ["number", "vec_id", "label", "values", "lead", "x"])
            at += len(batch)

    v = F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    sound = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    got = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.col(label_col).isNotNull()).filter(sound)
    got = got.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(sound, v).alias("v")).withColumn("lead", F.get("v", F.lit(0)))
    return written(got.mapInArrow(numbered, "number long, vec_id long, label string, values int, lead long, x binary"), "rtree-rows")


def build_trees(rows: DataFrame, shape: tuple[int, int, int] = SHAPE) -> DataFrame:
    """Written trees of at most shape[0] vectors of one label and length. Spark cuts the table into ranges of label, length and first coordinate, so the rows of one label, and copies of one vector, are dealt over as many tasks as their number needs; a task packs what it gets, tree by tree."""

    most, leaf, _ = shape

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, kind = TaskContext.get().partitionId() << 32, [], None

        def out() -> pa.RecordBatch:
            nonlocal number
            x = np.frombuffer(b"".join(r["x"] for r in held), np.int64).reshape(len(held), kind[1])
            ids, numbers = (np.array([r[c] for r in held], np.int64) for c in ("vec_id", "number"))
            by_id = np.lexsort((numbers, ids))
            order = by_id[str_order(x[by_id], leaf)]
            order = np.concatenate([part[np.lexsort((numbers[part], ids[part]))] for part in np.split(order, range(leaf, len(order), leaf))])
            x, starts = x[order], np.arange(0, len(order), leaf)
            low, high = (f.reduceat(x, starts, axis=0) if kind[1] else np.zeros((len(starts), 0), np.int64) for f in (np.minimum, np.maximum))
            number += 1
            binary = [pa.array([y.tobytes()], pa.binary()) for y in (ids[order], numbers[order], _narrow(x), low, high)]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([kind[0]]), pa.array([kind[1]], pa.int32()), pa.array([len(held)], pa.int32()), *binary], ["block", "label", "values", "rows", "ids", "numbers", "x", "lows", "highs"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and ((row["label"], row["values"]) != kind or len(held) == most):
                    yield out()
                    held = []
                kind = (row["label"], row["values"])
                held.append(row)
        if held:
            yield out()

    dealt = rows.repartitionByRange("label", "values", "lead", "number").sortWithinPartitions("label", "values", "lead", "number")
    return written(dealt.mapInArrow(trees, BLOCK), "rtree-trees")


class Tree:
    """A tree in memory. kind: float where all products are whole numbers below 2^53, else object, for whole numbers of any size."""

    def __init__(self, row: dict, kind: type, shape: tuple[int, int, int]):
        n, d = row["rows"], row["values"]
        _, self.leaf, self.fan = shape
        self.label, self.values = row["label"], d
        self.ids, self.numbers = (np.frombuffer(row[c], np.int64) for c in ("ids", "numbers"))
        self.x = np.frombuffer(row["x"], f"<i{len(row['x']) // (n * d) if d else 8}").reshape(n, d).astype(kind)
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(math.ceil(n / self.leaf), d).astype(kind) for c in ("lows", "highs"))
        self.first_ids = self.ids[:: self.leaf]
        at = np.arange(0, len(self.low), self.fan)
        self.node_low, self.node_high = (f.reduceat(b, at, axis=0) if d else b[at] for f, b in ((np.minimum, self.low), (np.maximum, self.high)))


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with anything in each box: coordinate by coordinate, the product with one of the box's two ends."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Best:
    """The k best of each query and window so far: scores in falling order, ties by smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), -math.inf, low.dtype)
        self.ids = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def wanted(self, least: np.ndarray, most: np.ndarray, first_ids: np.ndarray | None = None) -> np.ndarray:
        """(queries, boxes): the best score a box may give some window of a query that it could still change, -inf if none. A box is out of a window, or strictly behind its kth, by score and then by smallest id."""
        out = np.full(most.shape, -math.inf, most.dtype)
        for w in range(self.low.shape[1]):
            lo, hi, kth = self.low[:, w, None], self.high[:, w, None], self.scores[:, w, -1, None]
            cap = np.minimum(most, hi)
            ok = (most >= lo) & (least <= hi) & (cap >= kth) & (lo <= hi)
            if first_ids is not None:
                ok &= (cap > kth) | (first_ids[None, :] <= self.ids[:, w, -1, None])
            out = np.where(ok & (cap > out), cap, out)
        return out

    def add(self, at: np.ndarray, got: np.ndarray, ids: np.ndarray) -> None:
        """got: scores of the queries `at` with rows of these ids; -inf where a row doesn't count."""
        for w in range(self.low.shape[1]):
            inside = np.where((got >= self.low[at, w, None]) & (got <= self.high[at, w, None]), got, -math.inf)
            top = inside.max(axis=1)
            better = np.flatnonzero((top > -math.inf) & (top >= self.scores[at, w, -1]))
            if not len(better):
                continue
            to = at[better]
            scores = np.concatenate([self.scores[to, w], inside[better]], axis=1)
            names = np.concatenate([self.ids[to, w], np.broadcast_to(ids, (len(better), len(ids)))], axis=1)
            if scores.dtype == object:
                order = np.array([sorted(range(len(s)), key=lambda j, s=s, n=n: (-s[j], n[j]))[: self.k] for s, n in zip(scores, names, strict=True)])
            else:
                order = np.lexsort((names, -scores), axis=1)[:, : self.k]
            self.scores[to, w], self.ids[to, w] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def walk(tree: Tree, q: np.ndarray, numbers: np.ndarray, best: Best) -> None:
    """Queries q through a tree, best box first: the boxes of its nodes, then those of leaves below nodes that may matter, are queued by the best score they may give; each round the queries take the next leaves of their queues, twice as many as before, and drop what has fallen behind."""
    above = best.wanted(*intervals(q, tree.node_low, tree.node_high)) > -math.inf
    active = np.flatnonzero(above.any(axis=1))
    nodes = np.flatnonzero(above.any(axis=0))
    leaves = np.concatenate([np.arange(i * tree.fan, min((i + 1) * tree.fan, len(tree.low))) for i in nodes]) if len(nodes) else nodes
    if not len(leaves) or not len(active):
        return
    least, most = intervals(q, tree.low[leaves], tree.high[leaves])
    left = above[:, leaves // tree.fan]
    take = FIRST
    while True:
        queue = np.where(left, best.wanted(least, most, tree.first_ids[leaves]), -math.inf)
        left = queue > -math.inf
        if not left.any():
            return
        order = np.argsort(-queue, axis=1, kind="stable")[:, :take]
        now = np.zeros_like(left)
        np.put_along_axis(now, order, True, 1)
        now &= left
        for j in np.flatnonzero(now.any(axis=0)).tolist():
            at, lo = np.flatnonzero(now[:, j]), leaves[j] * tree.leaf
            part = slice(lo, lo + tree.leaf)
            got = q[at] @ tree.x[part].T
            own = tree.numbers[part][None, :] == numbers[at, None]
            best.add(at, np.where(own, -math.inf, got) if own.any() else got, tree.ids[part])
        left &= ~now
        take *= 2


def search(queries: DataFrame, trees: DataFrame, k: int, *, same: bool, wide: bool, window: tuple[int, int] = (0, 100), shape: tuple[int, int, int] = SHAPE) -> DataFrame:
    """number, w, vec_id, score, exact: for each query (number, label, values, x, positives) the k best rows of its label (same) or of other labels, but itself. positives: null for one window without ends, else for each window w its score p as text; the window is from window[0] to window[1] hundredths of p.

    Groups of trees meet slabs of queries, a task for each meeting, which holds HELD bytes of each side at most (one
    tree at least). With same, groups and slabs are those of one label, so a query moves to its own label's trees only.
    """
    kind = object if wide else np.float64

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, held, waiting = None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            for values in sorted({r["values"] for r in waiting}):
                part = [r for r in waiting if r["values"] == values]
                q = np.frombuffer(b"".join(r["x"] for r in part), np.int64).reshape(len(part), values).astype(kind)
                numbers = np.array([r["number"] for r in part], np.int64)
                width = max(len(r["positives"]) if r["positives"] else 1 for r in part)
                low, high = np.full((len(part), width), math.inf, kind), np.full((len(part), width), -math.inf, kind)
                for i, r in enumerate(part):
                    for w, p in enumerate(map(int, r["positives"] or ())):
                        low[i, w], high[i, w] = -(-window[0] * p // 100), window[1] * p // 100
                    if not r["positives"]:
                        low[i, 0], high[i, 0] = -math.inf, math.inf
                best, labels = Best(low, high, k), np.array([r["label"] for r in part], object)
                for tree in held:
                    at = np.flatnonzero((labels == tree.label) == same) if tree.values == values else ()
                    if len(at) == len(part):
                        walk(tree, q, numbers, best)
                    elif len(at):
                        some = Best(low[at], high[at], k)
                        some.scores, some.ids = best.scores[at], best.ids[at]
                        walk(tree, q[at], numbers[at], some)
                        best.scores[at], best.ids[at] = some.scores, some.ids
                i, w, j = np.nonzero(best.scores > -math.inf)
                if len(i):
                    scores = [int(s) for s in best.scores[i, w, j]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(numbers[i]), pa.array(w.astype(np.int32)), pa.array(best.ids[i, w, j]), pa.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores], pa.int64()),
                        pa.array([(s + _SHIFT).to_bytes(24, "big") if wide else None for s in scores], pa.binary()), pa.array([str(s) for s in scores]),
                    ], ["number", "w", "vec_id", "score", "exact", "said"])

        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["meeting"] != meeting or len(waiting) >= BATCH:
                    yield from answers()
                    waiting = []
                if row["meeting"] != meeting:
                    meeting, held = row["meeting"], []
                if row["ids"] is not None:
                    held.append(Tree(row, kind, shape))
                elif held:
                    waiting.append(row)
        yield from answers()

    spark = trees.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    by = ["label", "values"] if same else []
    sizes = lambda df, rows: df.groupBy(*by).agg(F.sum(rows).alias("rows"), F.sum(8 * F.col("values").cast("long") * rows).alias("bytes"))
    of_trees = sizes(trees, F.col("rows").cast("long")).withColumnsRenamed({"rows": "tree_rows", "bytes": "tree_bytes"})
    of_queries = sizes(queries, F.lit(1).cast("long"))
    both = of_trees.join(of_queries, by) if same else of_trees.crossJoin(of_queries)
    whole = queries.agg(F.count("*").alias("all"))
    slabs = F.greatest(F.lit(1), F.ceil(F.col("bytes") / HELD), F.ceil(F.col("rows") * tasks / F.col("all"))).cast("int")
    groups = F.greatest(F.lit(1), F.ceil(F.col("tree_bytes") / HELD)).cast("int")
    plan = written(both.crossJoin(whole).filter("rows > 0 and tree_rows > 0").select(*by, groups.alias("groups"), slabs.alias("slabs")), "rtree-plan")
    turn = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    planned = lambda df: df.join(plan, by) if same else df.crossJoin(F.broadcast(plan))
    left = planned(trees).withColumn("g", turn("block", "groups")).withColumn("s", part("slabs"))
    right = planned(queries).withColumn("s", turn("number", "slabs")).withColumn("g", part("groups"))
    meeting = F.xxhash64("label", "values", "g", "s") if same else F.xxhash64("g", "s")
    met = left.select(meeting.alias("meeting"), *trees.columns).unionByName(right.select(meeting.alias("meeting"), "number", "label", "values", "x", "positives"), allowMissingColumns=True)
    dealt = met.repartition("meeting").sortWithinPartitions("meeting", F.col("ids").isNull())
    return dealt.mapInArrow(found, "number long, w int, vec_id long, score long, exact binary, said string")


def hard_negatives(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), shape: tuple[int, int, int] = SHAPE
) -> DataFrame:
    """For each row whose id is divisible by `every` (an anchor) and each of its positives, the `positives` best other rows of its label: the first rows of other labels whose score lies from window[0] to window[1] hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * component); the higher come first, of equal ones the smaller id. All rows are in
    the trees and all anchors search all trees of the labels concerned; a positive or negative score has no row where
    its window is empty (a score below zero) or nothing lies in it.

    Decided: rows without id, label or vector, or with a null or a component that isn't finite, take no part. A row
    meets vectors of its own length only. Repeated ids: each row is an anchor and a candidate of its own and doesn't
    find itself. Components of any finite size take part (what leaves 64 bits after scaling counts as the nearest
    integer of 64 bits); a score beyond 64 bits is compared exactly and given as the nearest one of 64 bits. Labels of
    any type are compared by their text. More columns aren't read. An empty table gives an empty one.
    """
    rows = labelled(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale)
    trees = build_trees(rows, shape)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [float(np.abs(np.frombuffer(b, np.int64).astype(float)).max(initial=0.0)) for c in ("lows", "highs") for b in batch.column(c).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([max(ends, default=0.0)])], ["most"])

    most, values = trees.select("lows", "highs").mapInArrow(largest, "most double").agg(F.max("most")).first()[0], trees.agg(F.max("values")).first()[0]
    wide = most is not None and 100 * most * most * (values or 0) >= 2.0**53
    anchors = rows.filter(F.col("vec_id") % every == 0)
    own = search(anchors.withColumn("positives", F.lit(None).cast("array<string>")), trees, positives, same=True, wide=wide, shape=shape)
    order = [F.desc("exact"), F.desc("score"), "vec_id"]
    own = own.withColumn("p", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("p") <= positives)
    own = written(own.select("number", "p", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "said"), "rtree-positives")
    of = own.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "said"))), lambda s: s["said"]).alias("positives"))
    other = search(anchors.join(of, "number"), trees, negatives, same=False, wide=wide, window=window, shape=shape)
    other = other.withColumn("rank", F.row_number().over(Window.partitionBy("number", "w").orderBy(*order))).filter(F.col("rank") <= negatives)
    got = other.withColumn("p", F.col("w") + 1).select("number", "p", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    got = got.join(own.drop("said"), ["number", "p"]).join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number")
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
