"""Second-order boosted trees on binned features: one aggregation of histograms a level."""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature; values of binned features of a partition, about; rows of a block.
BINS, CELLS, BLOCK = 64, 1_000_000, 65_536
#: Binned values (a byte each) of a table that one task holds and grows trees from: between partitions there is nothing to add up then. Of more, each level is a job.
ALONE = 8_000_000
#: Partitions whose histograms the driver adds up itself; those of more are added up in the cluster first.
DIRECT = 32
#: Binned values of a partition beyond which there are more partitions than cores.
MOST_CELLS = 64_000_000
#: Bytes of margins, and of gradients and drawn bins, that a worker remembers between passes. The latter are quickly made again from margins; margins take all trees.
REMEMBERED, DRAWN = 512 << 20, 128 << 20

NODE = np.dtype([("feature", np.int32), ("cut", np.int32), ("value", np.float64), ("cover", np.float64), ("gain", np.float64)])
_fits = itertools.count()


@dataclass(frozen=True)
class Plan:
    """Fixed choices of a fit: those of the published candidate, and the usual regularisation."""

    trees: int = 200
    depth: int = 4
    step: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    ridge: float = 1.0
    least_cover: float = 1.0
    seed: int = 42


@dataclass
class Boosted:
    """Fitted trees. A tree is a full binary tree in an array: node k has the children 2k + 1 (value <= cut) and 2k + 2; feature -1 is a leaf, -2 is not there."""

    base: float
    cuts: list[np.ndarray]
    trees: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features."""
        return self.margins_of(binned(x, self.cuts))

    def margins_of(self, bins: np.ndarray) -> np.ndarray:
        return sum((t["value"][leaves(t, bins)] for t in self.trees), np.full(bins.shape[1], self.base))

    def nodes(self) -> list[list]:
        """Per tree its nodes as [feature, threshold, left, right, cover, value], children by their place."""
        out = []
        for t in self.trees:
            place = {k: i for i, k in enumerate(np.flatnonzero(t["feature"] >= -1).tolist())}
            out.append([[f, float(self.cuts[f][t["cut"][k]]) if f >= 0 else 0.0, place.get(2 * k + 1, -1), place.get(2 * k + 2, -1), float(t["cover"][k]), float(t["value"][k])] for k in place for f in (int(t["feature"][k]),)])
        return out

    def importance(self) -> list[tuple[float, int, float]]:
        """Per feature: the loss that its splits took away (gain), how many they are (weight), and the second-order weight of the rows they cut (cover), in total."""
        n = len(self.cuts)
        all_ = np.concatenate(self.trees) if self.trees else np.zeros(0, NODE)
        cuts = all_[all_["feature"] >= 0]
        total = lambda w: np.bincount(cuts["feature"], w, n)
        return list(zip(total(cuts["gain"]).tolist(), np.bincount(cuts["feature"], minlength=n).tolist(), total(cuts["cover"]).tolist(), strict=True))


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Features by rows: the number of cuts below each value; NaN is above all."""
    return np.stack([np.searchsorted(c, x[:, f], side="left").astype(np.uint8) for f, c in enumerate(cuts)]) if len(cuts) else np.zeros((0, len(x)), np.uint8)


def leaves(tree: np.ndarray, bins: np.ndarray | Packed, steps: int | None = None) -> np.ndarray:
    """The node that each row comes to, after so many steps at most. Rows move node by node, parents first, in bytes all at once."""
    at = np.zeros(bins.shape[1], np.uint8 if len(tree) <= 256 else np.int64)
    for k in np.flatnonzero(tree["feature"] >= 0).tolist():
        if steps is not None and (k + 1).bit_length() > steps:
            break
        right = bins[int(tree["feature"][k])] > tree["cut"][k].astype(np.uint8)
        at += (at == k) * (right.astype(at.dtype) + at.dtype.type(k + 1))
    return at


def packing(sizes: Sequence[int]) -> list[tuple[int, int, int]]:
    """Per feature (column, shift, bits) of the byte that has its bin: features of few bins share a byte of up to 64 values, so that one histogram serves them all."""
    out, room, columns = [(0, 0, 0)] * len(sizes), [], 0
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        bits = max(1, (sizes[f] - 1).bit_length())
        c = next((c for c, used in enumerate(room) if used + bits <= 6), None)
        if c is None:
            room.append(0)
            c = len(room) - 1
        out[f] = (c, room[c], bits)
        room[c] += bits
    return out


@dataclass(frozen=True)
class Packed:
    """Binned rows, several features a byte; [f] gives a feature's bins."""

    columns: np.ndarray
    places: list[tuple[int, int, int]]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.places), self.columns.shape[1]

    def __getitem__(self, f: int) -> np.ndarray:
        c, shift, bits = self.places[f]
        return self.columns[c] >> np.uint8(shift) & np.uint8((1 << bits) - 1)

    def take(self, rows: np.ndarray) -> Packed:
        return Packed(np.take(self.columns, rows, axis=1), self.places)

    @classmethod
    def of(cls, bins: np.ndarray, places: list[tuple[int, int, int]]) -> Packed:
        columns = np.zeros((max((c for c, _, _ in places), default=-1) + 1, bins.shape[1]), np.uint8)
        for f, (c, shift, _) in enumerate(places):
            columns[c] |= bins[f] << np.uint8(shift)
        return cls(columns, places)


def unpacked(hist: np.ndarray, places: list[tuple[int, int, int]], width: int) -> np.ndarray:
    """Histograms by feature and bin from those by column and byte, (..., columns, 64): a feature's are sums over the others of its byte."""
    out = np.zeros((*hist.shape[:-2], len(places), width))
    for f, (c, shift, bits) in enumerate(places):
        by = hist[..., c, :].reshape(*hist.shape[:-2], 64 >> shift + bits, 1 << bits, 1 << shift).sum(axis=(-3, -1))
        out[..., f, : min(width, 1 << bits)] = by[..., :width]
    return out


def quantile_cuts(df: DataFrame, numbers: int, features: int) -> list[np.ndarray]:
    """Per feature its cuts: of the first `numbers` at most BINS - 1 values at about equal steps of their order, of the others, which are 0 or 1, one between them. df: features (array)."""
    names = [f"c{i}" for i in range(numbers)]
    got = df.select(*[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)]).approxQuantile(names, [i / BINS for i in range(1, BINS)], 0.25 / BINS) if names else []
    return [np.unique(np.array(q, float)) if q else np.zeros(1) for q in got] + [np.array([0.5])] * (features - numbers)


_margins: OrderedDict = OrderedDict()
_drawn: OrderedDict = OrderedDict()


def _keep(where: OrderedDict, key: tuple, state: tuple, most: int) -> None:
    where.pop(key, None)
    where[key] = state
    while len(where) > 1 and sum(x.nbytes for _, of in where.values() for x in of) > most:
        where.popitem(last=False)


def _state(key: tuple, plan: Plan, trees: list[np.ndarray], base: float, places: list[tuple[int, int, int]], block: tuple) -> list[np.ndarray]:
    """The bytes of the rows of a block that the next tree draws, and their gradients and hessians, by the trees so far. A worker remembers what it had, so mostly one tree is added; what it has not, it works out anew."""
    if (had := _drawn.get(key)) and had[0] == len(trees):
        return had[1]
    bins, y, w = _rows(block, places)
    done, state = _margins.get(key, (-1, None))
    if state is None or done > len(trees):
        done, state = 0, [np.full(len(y), base)]
    margin = state[0]
    for t in trees[done:]:
        margin = margin + t["value"][leaves(t, bins)]
    _keep(_margins, key, (len(trees), [margin]), REMEMBERED)
    at = np.flatnonzero(np.random.default_rng((plan.seed, len(trees), *key[1:])).random(len(y)) < plan.rows)
    p = 1 / (1 + np.exp(-margin[at]))
    drawn = [bins.take(at).columns, w[at] * (p - y[at]), w[at] * p * (1 - p)]
    _keep(_drawn, key, (len(trees), drawn), DRAWN)
    return drawn


def _rows(block: tuple, places: list[tuple[int, int, int]]) -> tuple[Packed, np.ndarray, np.ndarray]:
    """A block's packed bins, labels and weights; its bytes hold a code a row and the distinct pairs of label and weight."""
    raw, codes, pairs = block
    pairs = np.frombuffer(pairs).reshape(2, -1)
    codes = np.frombuffer(codes, np.uint8 if pairs.shape[1] <= 256 else np.uint32)
    return Packed(np.frombuffer(raw, np.uint8).reshape(-1, len(codes)), places), pairs[0][codes], pairs[1][codes]


def _histograms(plan: Plan, fit: tuple, base: float, places: list[tuple[int, int, int]], trees: list[np.ndarray], partial: np.ndarray, level: int, wanted: list[int]) -> Callable:
    """For each partition the sums of gradients and hessians by (wanted node of the level, column of bytes, byte)."""
    slot = np.full(len(partial), -1)
    slot[wanted] = np.arange(len(wanted))

    def of(part: int, blocks: Iterable[tuple]) -> Iterator[np.ndarray]:
        columns = max((c for c, _, _ in places), default=-1) + 1
        total = np.zeros((2, columns, len(wanted) * 64))
        for k, block in enumerate(blocks):
            bins, g, h = _state((fit, part, k), plan, trees, base, places, block)
            node = np.zeros(len(g), np.int64)
            if level:
                node = slot[leaves(partial, Packed(bins, places), level)]
                own = np.flatnonzero(node >= 0)
                bins, g, h, node = np.take(bins, own, axis=1), g[own], h[own], node[own] * 64
            for c in range(columns):
                key = node + bins[c]
                total[0, c] += np.bincount(key, g, len(wanted) * 64)
                total[1, c] += np.bincount(key, h, len(wanted) * 64)
        yield total.reshape(2, columns, len(wanted), 64).transpose(2, 0, 1, 3)

    return of


def _split(hist: np.ndarray, allowed: np.ndarray, plan: Plan) -> tuple[float, int, int]:
    """(gain, feature, cut) of a node's best split; of equal ones the first feature and the lowest cut. hist: (gradient, hessian) by feature and bin."""
    g, h = hist.cumsum(axis=2)
    whole_g, whole_h = g[:, -1:], h[:, -1:]
    score = lambda a, b: a * a / (b + plan.ridge)
    gain = (score(g, h) + score(whole_g - g, whole_h - h) - score(whole_g, whole_h)) / 2
    gain[(h < plan.least_cover) | (whole_h - h < plan.least_cover) | ~allowed[:, None]] = -1
    at = int(gain.argmax())
    return float(gain.ravel()[at]), at // gain.shape[1], at % gain.shape[1]


def grown(plan: Plan, features: int, sums: Callable[[list[np.ndarray], np.ndarray, int, list[int]], np.ndarray]) -> list[np.ndarray]:
    """The trees. sums(trees, tree, level, wanted) gives the histograms of the wanted nodes of a level of the tree that is growing. Of two siblings the lighter one is summed; the other is their parent less that."""
    trees: list[np.ndarray] = []
    draw = np.random.default_rng(plan.seed)
    size = (1 << plan.depth + 1) - 1
    for _ in range(plan.trees):
        tree = np.zeros(size, NODE)
        tree["feature"] = -2
        tree["feature"][0] = -1
        allowed = np.zeros(features, bool)
        allowed[draw.choice(features, max(1, round(plan.columns * features)), replace=False)] = True
        held: dict[int, np.ndarray] = {}
        wanted, other = [0], {}
        for level in range(plan.depth):
            got = sums(trees, tree, level, wanted)
            now = {k: got[i] for i, k in enumerate(wanted)}
            now |= {k: held[(k - 1) // 2] - now[o] for k, o in other.items()}
            held, wanted, other = now, [], {}
            for k, hist in sorted(now.items()):
                g, h = hist[:, 0].sum(axis=1)
                tree["value"][k], tree["cover"][k] = -plan.step * g / (h + plan.ridge), h
                gain, f, cut = _split(hist, allowed, plan)
                if gain <= 1e-9:
                    continue
                tree[k] = (f, cut, 0.0, h, gain)
                left_g, left_h = hist[:, f, : cut + 1].sum(axis=1)
                for child, (cg, ch) in ((2 * k + 1, (left_g, left_h)), (2 * k + 2, (g - left_g, h - left_h))):
                    tree[child] = (-1, 0, -plan.step * cg / (ch + plan.ridge), ch, 0.0)
                light = 2 * k + 1 + (left_h > h - left_h)
                wanted.append(int(light))
                other[int(4 * k + 3 - light)] = int(light)
            if not wanted:
                break
        trees.append(tree)
        if tree["feature"][0] < 0:
            trees.pop()
            if not allowed.all():
                continue
            break
    return trees


def boost(df: DataFrame, numbers: int, features: int, plan: Plan | None = None) -> Boosted:
    """Boosted trees for rows of features (array of so many doubles, the first of them numbers, the others 0 or 1), label and weight.

    Features are binned once, in blocks of rows that stay with Spark for the time of the fit; it makes them again where
    they are lost. Each level of a tree is one job: tasks sum gradients and hessians by node, feature and bin, and the
    driver, which sees these sums only, takes the best split of each node. Rows of up to ALONE binned values are one
    partition, whose sums are those of the table: its task takes the splits itself, by the same steps, and gives back the
    trees. Each tree sees its own draw of rows and of features.
    """
    plan, spark = plan or Plan(), df.sparkSession
    n, positive, weight = df.agg(F.count("*"), F.sum(F.col("label") * F.col("weight")), F.sum("weight")).first()
    if not n:
        return Boosted(0.0, [np.zeros(1)] * features, [])
    rate = min(max(positive / weight, 1e-6), 1 - 1e-6)
    base, cuts = float(np.log(rate / (1 - rate))), quantile_cuts(df, numbers, features)
    width, places = max((len(c) + 1 for c in cuts), default=1), packing([len(c) + 1 for c in cuts])
    cells = n * max(1, features)
    parts = 1 if cells <= ALONE else min(-(-cells // CELLS), max(spark.sparkContext.defaultParallelism, -(-cells // MOST_CELLS)))
    size = BLOCK if parts == 1 else max(4096, min(BLOCK, n // (8 * parts)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            x = t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), features)
            pairs, codes = np.unique(t.column("label").to_numpy() + 1j * t.column("weight").to_numpy(), return_inverse=True)
            codes = codes.astype(np.uint8 if len(pairs) <= 256 else np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (Packed.of(binned(x, cuts), places).columns.tobytes(), codes.tobytes(), np.stack([pairs.real, pairs.imag]).tobytes())], ["bins", "codes", "pairs"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= size:
                yield out(held)
                held = []
        if held:
            yield out(held)

    rows = df.select("features", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    # Many partitions: the blocks, of bytes, are dealt evenly, a partition a core; few files or joins of few partitions don't keep cores idle.
    made = (rows.coalesce(1) if parts == 1 else rows).mapInArrow(blocks, "bins binary, codes binary, pairs binary")
    data = (made if parts == 1 else made.repartition(parts)).rdd.map(lambda r: (bytes(r[0]), bytes(r[1]), bytes(r[2])))
    fit = (spark.sparkContext.applicationId, next(_fits))
    if cells <= ALONE:

        def alone(part: int, got: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
            own = list(got)
            yield grown(plan, features, lambda *at: unpacked(next(_histograms(plan, fit, base, places, *at)(part, own)), places, width))

        return Boosted(base, cuts, data.mapPartitionsWithIndex(alone).collect()[0])

    def summed(*at) -> np.ndarray:
        each = data.mapPartitionsWithIndex(_histograms(plan, fit, base, places, *at))
        return unpacked(sum(each.collect()) if parts <= DIRECT else each.treeReduce(np.add, 2), places, width)

    data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Boosted(base, cuts, grown(plan, features, summed))
    finally:
        data.unpersist()
