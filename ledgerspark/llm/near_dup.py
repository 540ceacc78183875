"""Near-duplicate documents by HyperMinHash sketches, banded, with links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .components import components

#: Words of a shingle and least similarity in hundredths.
WIDTH, SIMILAR = 5, 75
#: A band has one register from each of ROWS hash functions: its bucket of that number, of BANDS buckets.
BANDS, ROWS = 70, 6
REGISTERS = BANDS * ROWS
#: Of a register's 16 bits, these hold the mantissa; the others count leading zeros.
MANTISSA = 10
#: The lower bits of a band's key say which band it is.
BAND_BITS = 7
#: Rows of a bucket that one group compares at once; a larger bucket is compared in pairs of such blocks.
BLOCK = 2048
#: Bytes of text hashed in one go, and words that a worker remembers.
CHUNK, MEMORY = 2_000_000, 150_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class _Words(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Per text, its distinct shingles as ascending 64-bit hashes. bytes.lower() and split() know exactly A-Z and the six blanks."""
    if len(_words) > MEMORY:
        _words.clear()
    split = [t.lower().split() if t else [] for t in texts]
    ends = np.cumsum([len(w) for w in split])
    flat = np.fromiter((h for w in split for h in map(_words.__getitem__, w)), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0)
    with np.errstate(over="ignore"):
        n = max(0, len(flat) - WIDTH + 1)
        run = np.zeros(n, dtype=np.uint64)
        for k in range(WIDTH):
            run += _mix(flat[k : n + k], k) * _MIX[k]
    run, out, start = _mix(run), [], 0
    for end in ends.tolist():
        if end - start >= WIDTH:
            out.append(np.unique(run[start : end - WIDTH + 1]))
        elif end > start:
            out.append(_mix(np.array([xxhash.xxh64_intdigest(flat[start:end].tobytes(), seed=end - start)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        start = end
    return out


_DONORS = np.random.default_rng(5).integers(0, BANDS, (16, BANDS))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash, once for each of ROWS hash functions: a hash's upper bits choose one of BANDS buckets; the least of a bucket's second hashes is kept as its count of leading zeros and MANTISSA bits after its first one. Registers stand band by band.

    An empty bucket takes the register of another of its function, tried in an order that is the same for all sets and
    then of the next full one, so that also a set of few shingles agrees with another in about the share that both have
    in common.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, doc = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    out = np.zeros((len(sets), BANDS, ROWS), dtype=np.uint16)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    for r in range(ROWS):
        h = _mix(flat, 0x5851F42D4C957F2D + 2 * r)
        bucket = ((h >> np.uint64(32)) * np.uint64(BANDS) >> np.uint64(32)).astype(np.int64)
        least = np.full(len(sets) * BANDS, empty)
        np.minimum.at(least, doc * BANDS + bucket, _mix(h, 0x2545F4914F6CDD1D))
        part, bits = np.frexp((least >> np.uint64(11)).astype(np.float64))
        own = ((np.minimum(53 - bits, 63) << MANTISSA) | np.floor((part * 2 - 1) * (1 << MANTISSA)).clip(0).astype(np.int64)).astype(np.uint16).reshape(-1, BANDS)
        full = (least != empty).reshape(-1, BANDS)
        have = full.copy()
        for donor in _DONORS:
            if have.all():
                break
            take = ~have & full[:, donor]
            own = np.where(take, own[:, donor], own)
            have |= take
        for i in np.flatnonzero(~have.all(axis=1) & full.any(axis=1)):
            at = np.flatnonzero(have[i])
            own[i] = own[i, at[np.searchsorted(at, np.arange(BANDS)) % len(at)]]
        out[:, :, r] = own
    return out.reshape(len(sets), REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the share that would be equal by chance (the sketch's published approximation)."""
    equal = (a == b).mean(axis=-1)
    d = np.maximum(na, nb) / np.maximum(1, np.minimum(na, nb))
    chance = 0.169919487159739 / (1 << MANTISSA) * 4 * d / (1 + d) ** 2
    return (equal - chance) / (1 - chance)


def _least_estimate(n: np.ndarray) -> np.ndarray:
    """Pairs of a similarity of 0.75 or more stay above it but for one in some 10^7: 5.5 standard deviations below, of as many registers as differ from each other."""
    return SIMILAR / 100 - 5.5 * np.sqrt(SIMILAR / 100 * (1 - SIMILAR / 100) / np.clip(n * ROWS, 1, REGISTERS))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about CHUNK bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column("text").cast(pa.large_binary()).buffers()[1] or b"\0" * 8, dtype=np.int64)[: len(batch) + 1]) if len(batch) else np.empty(0)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > CHUNK:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(batch):
            yield batch.slice(start)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def tiny_keys(s: np.ndarray) -> tuple[int | None, list[int]]:
    """Keys by which a set of 3 to 6 shingles and the larger sets similar to it meet for certain: own, a hash of the whole set, and those of the set without one shingle (4 to 7) or without two (8). At these sizes, sets as similar as that are one inside the other, with one more, or two more than six."""
    n = len(s)
    if not 3 <= n <= 8:
        return None, []
    h = _mix(s, 0x6A09E667F3BCC909)
    with np.errstate(over="ignore"):
        whole = h.sum(dtype=np.uint64)
        fewer = whole - (h if n < 8 else (h[:, None] + h)[np.triu_indices(n, 1)]) if n > 3 else h[:0]
    return (int(whole.view(np.int64)) if n <= 6 else None), fewer.view(np.int64).tolist()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        sets = shingle_sets(_texts(batch))
        own, fewer = zip(*map(tiny_keys, sets), strict=True) if sets else ((), ())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array([r.tobytes() for r in sketches(sets)], pa.binary()), pa.array(own, pa.int64()), pa.array(fewer, pa.list_(pa.int64())),
        ], ["doc_id", "n", "print", "sketch", "own", "fewer"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        raw = [s.tobytes() for s in shingle_sets(_texts(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["id", "print", "set"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per band of a sketch: the key is a hash of the band's registers, and its number in the lower bits."""
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(len(batch), BANDS, ROWS).astype(np.uint64)
        band = np.arange(BANDS, dtype=np.uint64)
        key = np.broadcast_to(band, (len(batch), BANDS))
        for r in range(ROWS):
            key = _mix(key + regs[:, :, r] * np.uint64(0x9E3779B97F4A7C15), r)
        key = (key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | band).view(np.int64)
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids)], ["key", "id"])


def _similar(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets are similar enough to x, exactly."""
    sizes = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    hit = np.concatenate([[0], np.cumsum(x[np.searchsorted(x, flat).clip(0, len(x) - 1)] == flat)])
    ends = np.cumsum(sizes)
    both = hit[ends] - hit[ends - sizes]
    return 100 * both >= SIMILAR * (len(x) + sizes - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows dealt and sorted by (key, i, j): links of a bucket between different components.

    A pair is looked at in the first of the buckets that both are in, if its sizes and its estimate allow the
    similarity, and there held against each other on full sets.
    """
    rest: pa.Table | None = None

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        ids, n, comp, block, band = (t.column(c).to_numpy() for c in ("id", "n", "component", "block", "band"))
        regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint16).reshape(len(ids), REGISTERS)
        bands = regs.reshape(len(ids), BANDS, ROWS)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("set").to_pylist()]
        found: list[np.ndarray] = []
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            left = np.arange(lo, hi)[block[lo:hi] == i[lo]]
            right = np.arange(lo, hi)[block[lo:hi] == j[lo]] if i[lo] != j[lo] else left
            for x in left:
                y = right[right > x] if i[lo] == j[lo] else right
                y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= SIMILAR * np.maximum(n[y], n[x]))]
                y = y[estimate(regs[x], regs[y], n[x], n[y]) >= _least_estimate(np.minimum(n[x], n[y]))]
                y = y[(bands[y] == bands[x]).all(axis=2).argmax(axis=1) == band[lo]]
                if len(y):
                    y = y[_similar(sets[x], [sets[k] for k in y])]
                    found.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
        if found:
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))
        if len(cuts):
            yield from links(t.slice(0, cuts[-1] + 1))
            t = t.slice(cuts[-1] + 1)
        rest = t
    if rest is not None and len(rest):
        yield from links(rest)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sketches: those whose estimate is high enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(len(batch), REGISTERS) for c in ("xs", "ys"))
        xn, yn = (batch.column(c).to_numpy() for c in ("xn", "yn"))
        yield batch.filter(pa.array(estimate(x, y, xn, yn) >= _least_estimate(np.minimum(xn, yn)))).select(["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("xset").to_pylist(), batch.column("yset").to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = int((y[np.searchsorted(y, x).clip(0, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both) > 0)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _sets_of(ids: DataFrame, docs: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """(id, set) of the documents with these ids (doc_id); no other text is read into a set. chosen: of ids with several texts, the print of the one that counts."""
    got = docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "id long, print binary, set binary")
    if chosen is not None:
        got = got.join(chosen.select(F.col("doc_id").alias("id"), F.col("print").alias("of")), "id", "left").filter("of is null or of = print")
    return written(got.dropDuplicates(["id"]).select("id", "set"), "near-sets", "none")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xset")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("yset")).hint("merge"), "b")
    return written(both.mapInArrow(_confirmed, "a long, b long"), "near-links")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id, n_shingles, component_id and kept (it is its component's smallest id).

    Texts with one shingle set are one class, found by a hash of the set that combines before the shuffle; its smallest
    id stands for it from here on, so any number of copies costs one sketch. Two classes meet in a bucket if a band of
    their sketches agrees; sets of so few shingles that bands may miss them also meet by tiny_keys(), exactly. First each
    class is held against the smallest id of each of its buckets, then in buckets that still hold several components
    against one drawn by lot in each; so large groups of copies link up with a few pairs a class. Buckets that hold
    several components even then are compared in blocks, in memory, pairs of different components only: any link that
    is left would join two of those. All three rounds estimate on sketches, then confirm on full sets. No bucket is
    capped or sampled. A bucket's least id and its count combine before the shuffle and come to its rows by a join,
    which Spark splits where a bucket is large.

    Decided: a text that is null, empty or blank has no shingles and no links. Rows of one doc_id are one document; if
    their texts differ, the one whose set has the smallest hash counts for all of them, on every run. A row without
    doc_id can't be named: n_shingles is given, its component_id is null and it is kept. More columns aren't read. An
    empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = written(docs.mapInArrow(_sketched, "doc_id long, n long, print binary, sketch binary, own long, fewer array<long>"), "near-sketches")
    several = drawn.filter("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("print"), F.max("print").alias("last")).filter("print <> last")
    several = written(several.select("doc_id", "print"), "near-several")
    chosen = None if several.isEmpty() else several
    if chosen is not None:
        one = drawn.join(chosen, ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id"]).drop("doc_id")
        again = drawn.select("doc_id").join(chosen, "doc_id").join(one, "print")
        drawn = written(drawn.join(chosen, "doc_id", "left_anti").unionByName(again), "near-sketches")
    linked = drawn.filter("n > 0 and doc_id is not null")
    classes = linked.groupBy("print").agg(F.min("doc_id").alias("id"))
    firsts = linked.join(classes.select(F.col("id").alias("doc_id"), "print"), ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id"])
    firsts = written(firsts.select(F.col("doc_id").alias("id"), "n", "sketch", "own", "fewer"), "near-classes")

    bands = firsts.mapInArrow(_banded, "key long, id long")
    shared = bands.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("key", "first")
    met = written(bands.join(shared.hint("merge"), "key"), "near-buckets")
    tiny = firsts.filter("own is not null").select("own", F.col("id").alias("a")).join(firsts.select(F.explode("fewer").alias("own"), F.col("id").alias("b")), "own")
    tiny = written(tiny.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "near-tiny")
    needed = met.select("id").unionByName(tiny.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    sets = _sets_of(needed.withColumnRenamed("id", "doc_id"), docs, chosen)
    x, y = (firsts.select(F.col("id").alias(i), F.col("n").alias(f"{v}n"), F.col("sketch").alias(f"{v}s")) for i, v in (("a", "x"), ("b", "y")))
    close = F.lit(100) * F.least("xn", "yn") >= F.lit(SIMILAR) * F.greatest("xn", "yn")

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        sized = pairs.distinct().join(x.select("a", "xn"), "a").join(y.select("b", "yn"), "b").filter(close)
        return written(sized.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").mapInArrow(_near, "a long, b long"), name)

    def mixed(of: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components, with their count of rows; of buckets with the same rows, the one of the first band."""
        placed = met.join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id")).alias("who")).filter("lo <> hi")
        first = several.groupBy("who", "rows").agg(F.min(F.struct(band, "key")).alias("first")).select("first.key", "rows")
        return placed.join(first, "key")

    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1).cast("int").alias("band")
    stars = likely(met.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")), "near-stars").unionByName(tiny)
    of = written(components(_links(stars, sets)), "near-components")

    others = written(mixed(of), "near-mixed")
    drawn_by_lot = others.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("lot"), "id", "component")).alias("lead"))
    others = others.join(drawn_by_lot, "key").filter(F.col("component") != F.col("lead.component"))
    leads = others.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()
    leads = likely(leads.join(stars, ["a", "b"], "left_anti"), "near-leads")
    as_links = lambda of: of.select(F.col("id").alias("a"), F.col("component").alias("b"))
    of = written(components(as_links(of).unionByName(_links(leads, sets))), "near-components")

    left = written(mixed(of), "near-left")
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int")
    dealt = left.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.join(firsts.select("id", "n", "sketch").hint("merge"), "id").join(sets.hint("merge"), "id")
    dealt = dealt.select("key", band, "id", "n", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sketch", "set")
    more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared, "a long, b long")
    final = components(as_links(of).unionByName(more))

    of_class = classes.join(final.withColumnRenamed("component", "of"), "id", "left").select("print", F.coalesce("of", "id").alias("component_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = drawn.select("doc_id", "n", "print").join(of_class, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
