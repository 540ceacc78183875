"""Exact top-k search by integer inner product on a bit-sliced index."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of an index block, about, and queries of a query block; rows of a group of index blocks and blocks of a slab of queries: what a task holds of each.
ROWS, QUERIES = 16_384, 128
GROUP_ROWS, SLAB = 131_072, 256

BLOCK = "block long, rows int, ids binary, numbers binary, values int, lows binary, bits binary, slices binary"


def slices_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attributes (rows by dims) as lows, bits (of each dim) and slices: one bitmap for each bit of each attribute less its low, in words of 64 rows."""
    low = x.min(axis=0)
    bits = np.array([(hi - lo).bit_length() for lo, hi in zip(low.tolist(), x.max(axis=0).tolist(), strict=True)], np.int64)
    words = -(-len(x) // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    over = x.view(np.uint64) - low.view(np.uint64)  # modulo 2^64, so that any two integers of 64 bits have their difference
    at = 0
    for d in range(x.shape[1]):
        for b in range(bits[d]):
            packed = np.packbits(over[:, d] >> np.uint64(b) & np.uint64(1) == 1, bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return low, bits, out.view(np.uint64)


def weighted_sum(low: np.ndarray, bits: np.ndarray, slices: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps of sum(q * x), low bit first, as many as the sum has, and the constant to add to them.

    q * x is q * low plus |q| times the slices, or for q < 0 plus |q| times their complement, less a constant. Each set
    bit of |q| adds the attribute's slices at its own weight; full adders take three bitmaps of one weight to one of it
    and one of the next, all triples at once, until each weight has one.
    """
    at: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    constant, first = 0, 0
    for d, v in enumerate(q.tolist()):
        own = slices[first : first + bits[d]]
        first += int(bits[d])
        constant += v * int(low[d])
        if v < 0:
            own, constant = ~own, constant + v * ((1 << int(bits[d])) - 1)
        size, shift = abs(v), 0
        while size:
            if size & 1:
                for b in range(len(own)):
                    at[shift + b].append(own[b : b + 1])
            size, shift = size >> 1, shift + 1
    out: list[np.ndarray] = []
    while at:
        planes = np.concatenate(got) if (got := at.pop(len(out), None)) else None
        while planes is not None and len(planes) > 1:
            if len(planes) == 2:
                a, b = planes[:1], planes[1:]
                planes, carry = a ^ b, a & b
            else:
                m = len(planes) // 3
                a, b, c = planes[:m], planes[m : 2 * m], planes[2 * m : 3 * m]
                ab = a ^ b
                planes, carry = np.concatenate([ab ^ c, planes[3 * m :]]), (a & b) | (ab & c)
            at[len(out) + 1].append(carry)
        out.append(planes[0] if planes is not None else np.zeros(slices.shape[1], np.uint64))
    return out, constant


def scores(planes: list[np.ndarray], constant: int, at: np.ndarray, *, wide: bool) -> np.ndarray:
    """The sums at these positions: 64-bit integers, or whole numbers of any size where wide."""
    out = np.full(len(at), constant, object if wide else np.int64)
    for w, plane in enumerate(planes):
        bit = (plane[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        out = out + (bit.astype(object) * (1 << w) if wide else bit << w)
    return out


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(planes: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest sums, ties to the lower position.

    From the highest slice down: rows that are ahead for certain, and rows that are level so far. If ahead and the level
    ones with this bit are more than k, only those stay level; otherwise they go ahead. What is level at the end has one
    and the same sum, and fills up in order of position.
    """
    ahead, level = np.zeros_like(valid), valid
    for plane in reversed(planes):
        on = level & plane
        if int(np.bitwise_count(ahead | on).sum()) > k:
            level = on
        else:
            ahead, level = ahead | on, level & ~plane
    sure = _positions(ahead)
    return np.concatenate([sure, _positions(level)[: max(0, k - len(sure))]])


def quantised(vectors: DataFrame, *, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """number, vec_id, v: floor(scale * component) as integers of 64 bits (what is beyond them counts as the nearest one), written, with a number for each row. Vectors that are null or hold a null or a component that isn't finite are left out, as are rows without id."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(batch))), *batch.columns], ["number", *batch.schema.names])
            at += len(batch)

    x = F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    sound = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    got = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, x).alias("v"))
    return written(got.mapInArrow(numbered, "number long, vec_id long, v array<long>"), "top-k-rows")


def build_index(rows: DataFrame) -> DataFrame:
    """Written blocks of about ROWS vectors of one length, each sorted by id: their ids and numbers, and the slices of their attributes."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        number = TaskContext.get().partitionId() << 32

        def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            nonlocal number
            ids, numbers, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(ids, kind="stable")
            low, bits, slices = slices_of(x[order])
            number += 1
            binary = [pa.array([y.tobytes()], pa.binary()) for y in (ids[order], numbers[order], low, bits, slices)]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(ids)], pa.int32()), *binary[:2], pa.array([x.shape[1]], pa.int32()), *binary[2:]], ["block", "rows", "ids", "numbers", "values", "lows", "bits", "slices"])

        for batch in batches:
            ids, numbers, lists = batch.column("vec_id").to_numpy(), batch.column("number").to_numpy(), batch.column("v")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                where = np.flatnonzero(sizes == n)
                x = flat[starts[where][:, None] + np.arange(n)] if n else np.zeros((len(where), 0), np.int64)
                for lo in range(0, len(where), ROWS):
                    part = where[lo : lo + ROWS]
                    held.setdefault(n, []).append((ids[part], numbers[part], x[lo : lo + ROWS]))
                    if sum(len(p[0]) for p in held[n]) >= ROWS:
                        yield out(held.pop(n))
        for parts in held.values():
            yield out(parts)

    return written(rows.mapInArrow(blocks, BLOCK), "bit-slices")


class Block:
    """An index block in memory."""

    def __init__(self, row: dict):
        self.ids, self.numbers, self.low, self.bits = (np.frombuffer(row[c], np.int64) for c in ("ids", "numbers", "lows", "bits"))
        self.values, words = row["values"], -(-row["rows"] // 64)
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(-1, words)
        self.whole = np.packbits(np.arange(words * 64) < row["rows"], bitorder="little").view(np.uint64)
        self.first, self.last = int(self.numbers.min()), int(self.numbers.max())

    def best(self, number: int, q: np.ndarray, k: int, *, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the block's k best rows but the one of this number."""
        valid = self.whole
        if self.first <= number <= self.last and len(own := np.flatnonzero(self.numbers == number)):
            valid = valid.copy()
            valid[own >> 6] &= ~(np.uint64(1) << (own & 63).astype(np.uint64))
        planes, constant = weighted_sum(self.low, self.bits, self.slices, q)
        at = top(planes, valid, k)
        return self.ids[at], scores(planes, constant, at, wide=wide)


def search(queries: DataFrame, index: DataFrame, k: int, *, wide: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (number, vec_id, v), the k rows of the index with the largest inner product, ties to the smaller id, but for the row of the query's own number. A query meets vectors of its own length only.

    Groups of index blocks meet slabs of query blocks, a task for each such meeting: it holds a group of about
    GROUP_ROWS rows and a slab of SLAB * QUERIES queries at most, and gives k rows a query. So each index block moves
    once for each slab and each query once for each group, not once for each block of the other side; groups and slabs
    are made smaller only as far as all cores have work. A rank over each query then picks the k of all groups. wide: scores
    may leave 64 bits; they are ordered as whole numbers and given as the nearest integer of 64 bits.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, len(batch), QUERIES):
                part = batch.slice(lo, QUERIES)
                columns = [pa.array([block])] + [pa.array([part.column(c).to_pylist()], t) for c, t in (("number", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64())), ("v", pa.list_(pa.list_(pa.int64()))))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "query_numbers", "query_ids", "vectors"])
                block += 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["meeting"] != meeting:
                    meeting, held = row["meeting"], []
                if row["slices"] is not None:
                    held.append(Block(row))
                    continue
                out: list[list] = [[], [], [], [], []]
                for number, query, v in zip(row["query_numbers"], row["query_ids"], row["vectors"], strict=True):
                    of = [b.best(number, np.array(v, np.int64), k, wide=wide) for b in held if b.values == len(v)]
                    if not of:
                        continue
                    ids, got = (np.concatenate(x) for x in zip(*of, strict=True))
                    best = np.array(sorted(range(len(ids)), key=lambda j: (-got[j], ids[j]))[:k], np.int64) if wide else np.lexsort((ids, -got))[:k]
                    keys = [(s + (1 << 190)).to_bytes(24, "big") for s in got[best].tolist()] if wide else [None] * len(best)
                    narrow = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in got[best].tolist()]
                    for column, x in zip(out, ([number] * len(best), [query] * len(best), ids[best].tolist(), narrow, keys), strict=True):
                        column += x
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["number", "query_id", "vec_id", "score", "exact"])

    packs = written(queries.mapInArrow(packed, "block long, query_numbers array<long>, query_ids array<long>, vectors array<array<long>>"), "query-blocks")
    blocks, rows, values = index.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.octet_length("slices")), F.lit(0))).first()
    n = packs.count()
    if not blocks or not n:
        return packs.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    tasks = 2 * index.sparkSession.sparkContext.defaultParallelism
    of_queries = packs.agg(F.sum(8 * F.aggregate("vectors", F.lit(0).cast("long"), lambda a, v: a + F.size(v)))).first()[0]
    slabs = max(math.ceil(n / SLAB), round(math.sqrt(tasks * of_queries / max(1, values))), 1)
    groups = min(blocks, max(math.ceil(rows / GROUP_ROWS), math.ceil(tasks / slabs)))
    slabs = min(n, max(slabs, math.ceil(tasks / groups)))
    turn = lambda parts: F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND((1 << 32) - 1), F.lit(parts))
    left = index.withColumns({"g": turn(groups), "s": F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))})
    right = packs.withColumns({"s": turn(slabs), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    both = left.unionByName(right, allowMissingColumns=True).withColumn("meeting", F.col("g") * slabs + F.col("s")).drop("g", "s", "block")
    dealt = both.repartitionByRange(groups * slabs, "meeting").sortWithinPartitions("meeting", F.col("slices").isNull())
    hits = dealt.mapInArrow(found, "number long, query_id long, vec_id long, score long, exact binary")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("exact"), F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_products(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, every: int = 20) -> DataFrame:
    """For each row whose id is divisible by `every`: the k other rows of the largest integer inner product.

    All rows are indexed and searched. A query with fewer others gets all of them. Repeated ids: each row is a query of
    its own and has its own k rows, under the one query_id; it doesn't find itself, but the other rows of its id.
    Components of any finite size take part: what leaves 64 bits after scaling counts as the nearest integer of 64
    bits, and scores are exact; one that leaves 64 bits is ranked by its exact value and given as the nearest
    integer. Rows left out: see quantised(). More columns aren't read. An empty table gives an empty one.
    """
    rows = quantised(vectors, id_col=id_col, vector_col=vector_col, scale=scale)
    size = F.greatest(*[F.abs(f("v").cast("double")) for f in (F.array_max, F.array_min)])
    most, values = rows.agg(F.max(size), F.max(F.size("v"))).first()
    wide = most is not None and most * most * values >= 2.0**62
    return search(rows.filter(F.col("vec_id") % every == 0), build_index(rows), k, wide=wide)


def op7_bit_sliced_top_k(spark, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))
