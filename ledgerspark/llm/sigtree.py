"""Exact Jaccard join of documents' shingle sets by signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .components import components
from .near_dup import _chunks, _texts, shingle_sets

#: Least similarity in hundredths.
SIMILAR = 80
#: Tokens of a range of hashes, about, and most ranges; tokens that a task collects before it deals them out.
RANGE, MOST_RANGES, HELD = 1 << 22, 1 << 16, 1 << 22
#: Rows and bytes of sets of a block, which is what a task holds of a group of documents at once.
BLOCK, BLOCK_BYTES = 1024, 64 << 20
#: Children of a node; bits of a signature for each token of its set, in powers of two, and their least and most.
FAN, BITS, LEAST_BITS, MOST_BITS = 8, 8, 512, 1 << 17
#: Ids up to this number (some 32 MB) are sent to all tasks to pick their texts or sets; more of them meet those in a merge join.
SENT = 1_000_000
#: Bytes of bitmaps laid side by side at once.
SIDE = 16 << 20


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        sets = shingle_sets(_texts(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())], ["doc_id", "n", "print"])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in shingle_sets(_texts(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(prints, pa.binary())], ["doc_id", "text", "print"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "block")), pa.array([s.tobytes() for s in shingle_sets(_texts(batch))], pa.binary())], ["id", "key", "block", "set"])


def signature(s: np.ndarray) -> np.ndarray:
    """A set's bitmap in 64-bit words: a bit for the lower bits of each token's hash. Half as many bits are the OR of both halves."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * len(s) - 1).bit_length()))
    row = np.zeros(bits, bool)
    row[(s >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(row).view(np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("set").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([int(x[0].view(np.int64)) for x in sets], pa.int64()), pa.array([signature(x).tobytes() for x in sets], pa.binary())], ["id", "n", "lead", "signature"])


def dealt_tokens(docs: DataFrame, bits: int) -> DataFrame:
    """part, owners, counts, tokens: of each range of hashes (their upper `bits` bits), whose tokens are in it (prints of sets, 16 bytes each), how many of each, and the tokens' next 32 bits; a row for some millions of tokens of a task, not one for each token."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in held])
            flat = np.concatenate(held)
            part = (flat >> np.uint64(64 - bits)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            doc, part = np.repeat(np.arange(len(held)), sizes)[order], part[order]
            tokens = (flat[order] >> np.uint64(32 - bits)).astype(np.uint32)
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in held), np.dtype("V16"))
            starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))
            counts, owners = np.diff(np.append(starts, len(part))).astype(np.uint32), prints[doc[starts]]
            cuts = np.flatnonzero(np.concatenate([[True], part[starts][1:] != part[starts][:-1]]))
            rows: list[list] = [[], [], [], []]
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)], strict=True):
                a, b = int(starts[lo]), int(starts[hi]) if hi < len(starts) else len(tokens)
                for column, x in zip(rows, (int(part[a]), owners[lo:hi].tobytes(), counts[lo:hi].tobytes(), tokens[a:b].tobytes()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], ["part", "owners", "counts", "tokens"])

        total = 0
        for batch in _chunks(batches):
            for s in shingle_sets(_texts(batch)):
                if len(s) > 3:  # smaller sets are similar to none but themselves
                    held.append(s)
                    total += len(s)
            if total >= HELD:
                yield from out()
                held, total = [], 0
        if held:
            yield from out()

    return docs.mapInArrow(dealt, "part int, owners binary, counts binary, tokens binary")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows dealt and sorted by range: for each owner its tokens that another owner has too, as numbers that sort by how many have them: count (16 bits, 65 535 for more), range, token."""

    def out(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        owners = np.concatenate([np.frombuffer(r["owners"], np.dtype("V16")) for r in rows])
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
        tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint32) for r in rows])
        rows.clear()
        upper, lower = owners.view(np.uint64).reshape(-1, 2).T
        order, one = np.lexsort((lower, upper)), np.zeros(len(owners), bool)
        one[order] = np.concatenate([[True], (np.diff(upper[order]) != 0) | (np.diff(lower[order]) != 0)])  # copies have the same tokens
        keep = np.repeat(one, counts)
        owners, counts, tokens = owners[one], counts[one], tokens[keep]
        key = np.sort(tokens.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(owners), dtype=np.uint64), counts))
        del tokens, keep
        token = key >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, len(token)))
        many = np.repeat(many, many)
        again = many > 1
        who = (key[again] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        said = np.minimum(many[again], 65_535).astype(np.uint64) << np.uint64(48) | np.uint64(part << 32) | token[again]
        order = np.argsort(who, kind="stable")
        who, said = who[order], said[order]
        cuts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
        for lo in range(0, len(cuts), 4096):
            mine = cuts[lo : lo + 4096]
            ends = np.append(cuts, len(who))[lo + 1 : lo + 1 + len(mine)]
            yield pa.RecordBatch.from_arrays([
                pa.array([owners[w].tobytes() for w in who[mine]], pa.binary()), pa.array([said[a:b].tobytes() for a, b in zip(mine, ends, strict=True)], pa.binary()),
            ], ["print", "tokens"])

    part, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["part"] != part:
                yield from out(part, rows)
            part = row["part"]
            rows.append(row)
    if rows:
        yield from out(part, rows)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, parts (its repeated tokens) -> key, id: a row for each repeated token of its prefix. In the order of how many sets have a token, those that only one has come first, and two sets that are similar share one of their first n - 0.8 n + 1."""
    for batch in batches:
        keys, ids = [], []
        for i, n, parts in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            own = np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in parts]))
            length = n + (-SIMILAR * n // 100) + 1 - (n - len(own))
            if length > 0:
                keys.append(own[:length].view(np.int64))
                ids.append(np.full(len(keys[-1]), i, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]))], ["key", "id"])


class SignatureTree:
    """Sets in a hierarchy of nodes. A set's signature is a bitmap with a bit for each hash of a token; a node has the OR of those below it, their least and greatest size, the most tokens of a set beyond its bits (slack), and their least and greatest component."""

    def __init__(self, at: np.ndarray, maps: list[np.ndarray], words: int, n: np.ndarray, lead: np.ndarray, component: np.ndarray):
        near = np.floor(np.log(n[at]) / np.log(100 / SIMILAR))
        self.at = at = at[np.lexsort((n[at], lead[at], near))]  # of like sizes those with the same least token, as similar sets mostly have
        folded = np.stack([np.bitwise_or.reduce(maps[i].reshape(-1, words), axis=0) for i in at])
        slack = n[at] - np.bitwise_count(folded).sum(axis=1).astype(np.int64)
        self.levels = [(folded, n[at], n[at], slack, component[at], component[at])]
        while len(self.levels) < 2 or len(self.levels[-1][0]) > 1:
            maps, least, most, slack, lo, hi = self.levels[-1]
            cut = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(slack, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def raised(self, height: int) -> None:
        while len(self.levels) < height:
            self.levels.append(self.levels[-1])


def may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes (i of a level, j of another) may hold a link between different components.

    A set x has at least as many tokens that y lacks as x has bits that y's lack, so two sets share at most their bits
    in common and the smaller slack. For nodes: the common bits of the two ORs, the smaller of both greatest slacks.
    """
    maps_a, least_a, most_a, slack_a, lo_a, hi_a = (x[i] if k else x for k, x in enumerate(a))
    maps_b, least_b, most_b, slack_b, lo_b, hi_b = (x[j] if k else x for k, x in enumerate(b))
    largest, smaller = np.maximum(least_a, least_b), np.minimum(most_a, most_b)
    ok = (100 * smaller >= SIMILAR * largest) & ~((lo_a == hi_a) & (lo_b == hi_b) & (lo_a == lo_b))
    at = np.flatnonzero(ok)
    common, step = np.zeros(len(at), np.int64), max(1, SIDE // (8 * max(1, maps_a.shape[1])))
    for lo in range(0, len(at), step):
        part = at[lo : lo + step]
        common[lo : lo + step] = np.bitwise_count(maps_a[i[part]] & maps_b[j[part]]).sum(axis=1)
    shared = np.minimum(np.minimum(slack_a, slack_b)[at] + common, smaller[at])
    ok[at] = ((100 + SIMILAR) * shared >= SIMILAR * (least_a + least_b)[at]) & (100 * shared >= SIMILAR * largest[at])
    return ok


def leaf_pairs(a: SignatureTree, b: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaf nodes that may hold a link: both trees are gone down together, level by level. Of one tree with itself, each pair once."""
    height = max(len(a.levels), len(b.levels))
    a.raised(height)
    b.raised(height)
    i = j = np.zeros(1, np.int64)
    for level in range(height - 1, 0, -1):
        ok = may_link(a.levels[level], b.levels[level], i, j)
        i, j = i[ok], j[ok]
        if level == 1 or not len(i):
            break
        left, right = (at[:, None] * FAN + np.arange(FAN) if len(t.levels[level - 1][0]) > 1 else at[:, None] for at, t in ((i, a), (j, b)))
        i = np.repeat(left, right.shape[1], axis=1).ravel()
        j = np.tile(right, (1, left.shape[1])).ravel()
        there = (i < len(a.levels[level - 1][0])) & (j < len(b.levels[level - 1][0]))
        there &= (i <= j) if a is b else True
        i, j = i[there], j[there]
    return i, j


def _similar(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets are similar enough to x, exactly."""
    sizes, flat = np.array([len(y) for y in others]), np.concatenate(others)
    hit = np.concatenate([[0], np.cumsum(x[np.searchsorted(x, flat).clip(0, len(x) - 1)] == flat)])
    ends = np.cumsum(sizes)
    both = hit[ends] - hit[ends - sizes]
    return 100 * both >= SIMILAR * (len(x) + sizes - both)


def tree_links(maps: list[np.ndarray], n: np.ndarray, lead: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of `left` with `right` (the same array: with each other) of different components.

    Trees narrow down to pairs of leaves, then a set's signature is held against those of its leaves' sets. With sets,
    what is left is held against full sets, and the links given are enough that all components that any link joins are
    joined; without, all pairs are given that may be links. Signatures are of like lengths in one tree: sets whose
    signatures differ by more than one halving can't be similar.
    """
    component, out, words = component.copy(), [], np.array([len(m) for m in maps])
    for short in np.unique(words).tolist():
        same = [x[words[x] == short] for x in (left, right)]
        longer = [x[words[x] == 2 * short] for x in (left, right)]
        meetings = [(same[0], same[0])] if left is right else [(same[0], same[1]), (longer[0], same[1])]
        for x, y in [*meetings, (same[0], longer[1])]:
            if len(x) and len(y):
                a = SignatureTree(x, maps, short, n, lead, component)
                _meet(a, a if x is y else SignatureTree(y, maps, short, n, lead, component), component, sets, out)
    return out


def _meet(a: SignatureTree, b: SignatureTree, component: np.ndarray, sets: list[np.ndarray] | None, out: list[tuple[int, int]]) -> None:
    i, j = leaf_pairs(a, b)
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    starts = np.searchsorted(i, np.arange(len(a.levels[1][0]) + 1))
    maps, sizes, _, slack = b.levels[0][:4]
    for k, x in enumerate(a.at.tolist()):
        leaves = j[starts[k // FAN] : starts[k // FAN + 1]]
        if not len(leaves):
            continue
        y = (leaves[:, None] * FAN + np.arange(FAN)).ravel()
        y = y[(y < len(b.at)) & ((y > k) if a is b else True)]
        y = y[component[b.at[y]] != component[x]]
        own, n, _, spare = (v[k] for v in a.levels[0][:4])
        y = y[100 * np.minimum(sizes[y], n) >= SIMILAR * np.maximum(sizes[y], n)]
        if len(y):
            shared = np.minimum(np.minimum(slack[y], spare) + np.bitwise_count(maps[y] & own).sum(axis=1).astype(np.int64), np.minimum(sizes[y], n))
            y = b.at[y[(100 + SIMILAR) * shared >= SIMILAR * (sizes[y] + n)]]
        if len(y) and sets is None:
            out += [(x, int(q)) for q in y]
        elif len(y):
            y = y[_similar(sets[x], [sets[q] for q in y])]
            joined, first = np.unique(component[y], return_index=True)
            out += [(x, int(q)) for q in y[first]]
            joined = np.append(joined, component[x])
            component[np.isin(component, joined)] = joined.min()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows dealt and sorted by (key, i, j): pairs of block i with block j of a group, by their trees. Rows bring full sets, or n, lead and signature."""
    held: list[dict] = []

    def links() -> pa.RecordBatch:
        if "set" in held[0]:
            sets = [np.frombuffer(r["set"], np.uint64) for r in held]
            maps, n, lead = [signature(x) for x in sets], np.array([len(x) for x in sets]), np.array([x[0].view(np.int64) for x in sets])
        else:
            sets, maps = None, [np.frombuffer(r["signature"], np.uint64) for r in held]
            n, lead = (np.array([r[c] for r in held], np.int64) for c in ("n", "lead"))
        component, block = (np.array([r[c] for r in held], np.int64) for c in ("component", "block"))
        left = np.flatnonzero(block == held[0]["i"])
        right = left if held[0]["i"] == held[0]["j"] else np.flatnonzero(block == held[0]["j"])
        got = tree_links(maps, n, lead, component, left, right, sets)
        a, b = ([held[p[k]]["id"] for p in got] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["key"], row["i"], row["j"]) != (held[0]["key"], held[0]["i"], held[0]["j"]):
                yield links()
                held.clear()
            held.append(row)
    if held:
        yield links()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("xset", "yset")]
        yield batch.filter(pa.array([bool(_similar(x, [y])[0]) for x, y in zip(*sets, strict=True)], pa.bool_())).select(["a", "b"])


def picked(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of these ids (each once), with what else ids has. A few ids, up to SENT, are sent to all tasks; more meet the rows in a merge join."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids.hint("merge"), key)


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id that links of a similarity of 0.8 or more reach.

    Texts with one shingle set are one class from the start. Which classes can meet at all is found exactly: tokens are
    dealt by ranges of their hash, in bulk, each range says which tokens several classes have, and each class keeps
    those in its prefix (the rarest first). So a passage that many documents share brings none of them together, as
    long as a fifth of each is its own. Classes with a common prefix token are a group, and a group is joined by
    signature trees (tree_links), in three rounds so that no set is copied about: each class with its set in its largest
    group only; then of each group one class of each component; then the groups that hold several components even so, in
    full and in pairs of blocks, by signatures alone, an eighth of the sets, and only pairs of classes that these let
    through meet with their sets. Nothing is capped or sampled.

    Decided: a text that is null, empty or blank has no shingles and no links. Rows of one doc_id are one document; if
    their texts differ, the one whose set has the smallest hash counts for all of them, on every run. A row without
    doc_id can't be named: n_shingles is given and its component_id is null. doc_id is a whole number, or text of one.
    More columns aren't read. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.filter("doc_id is not null")
    again = written(named.groupBy("doc_id").count().filter("count > 1"), "join-again")
    single = again.isEmpty()
    if not single:
        some = named.join(again, "doc_id", "left_semi").mapInArrow(_printed, "doc_id long, text string, print binary")
        named = named.join(again, "doc_id", "left_anti").unionByName(some.groupBy("doc_id").agg(F.min_by("text", "print").alias("text")))
    drawn = written(named.mapInArrow(_sized, "doc_id long, n long, print binary"), "join-sizes")
    classes = written(drawn.filter("n > 0").groupBy("print").agg(F.min("doc_id").alias("id"), F.first("n").alias("n")), "join-classes")

    total = drawn.agg(F.sum("n")).first()[0] or 0
    wanted = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE))
    bits = min(MOST_RANGES - 1, max(1, wanted - 1)).bit_length()
    dealt = dealt_tokens(named, bits).repartition(1 << bits, "part").sortWithinPartitions("part")
    repeats = dealt.mapInArrow(_repeated, "print binary, tokens binary").groupBy("print").agg(F.collect_list("tokens").alias("parts"))
    prefixes = repeats.join(classes, "print").select("id", "n", "parts").mapInArrow(_prefixes, "key long, id long")
    prefixes = written(prefixes, "join-prefixes")
    sizes = prefixes.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    met = written(prefixes.join(sizes.hint("merge"), "key"), "join-groups")

    def cut(rows: DataFrame) -> DataFrame:
        """rows (key, id, component) with the block of each and the blocks of its group: as many as the group's rows and bytes need."""
        sized = rows.join(classes.select("id", "n"), "id")
        parts = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("parts"), F.count("*").alias("rows")).filter("rows > 1").select("key", "parts")
        return rows.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("id"), "parts").cast("int"))

    def links(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return written(dealt.mapInArrow(_joined, "a long, b long"), "join-links")

    def within(rows: DataFrame) -> DataFrame:
        """Full sets of rows that are in a block, each block for itself."""
        return links(rows.select("key", F.col("block").alias("i"), F.col("block").alias("j"), "block", "id", "component", "set"))

    def mixed(of: DataFrame) -> DataFrame:
        """key, id, component of the groups that hold several components; of groups with the same rows, one."""
        placed = met.join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id")).alias("who"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum")).filter("lo <> hi")
        return placed.join(several.groupBy("who", "sum", "rows").agg(F.min("key").alias("key")).select("key"), "key")

    largest = met.groupBy("id").agg(F.max(F.struct("rows", "key")).alias("top")).select(F.col("top.key").alias("key"), "id", F.col("id").alias("component"))
    first = written(cut(largest).select("key", "id", "block"), "join-first")
    alone = written(met.select("id").distinct().join(first.select("id"), "id", "left_anti").withColumns({"key": F.lit(None).cast("long"), "block": F.lit(None).cast("int")}), "join-alone")  # no other class has their group as its largest
    places = written(first.unionByName(alone).withColumnRenamed("id", "doc_id"), "join-places")
    sets = written(picked(named, places, "doc_id").select("doc_id", "key", "block", "text").mapInArrow(_sets, "id long, key long, block int, set binary"), "join-sets", "none")
    of = written(components(within(sets.filter("key is not null").withColumn("component", F.col("id")))), "join-components")

    as_links = lambda of: of.select(F.col("id").alias("a"), F.col("component").alias("b"))
    full = sets.select("id", "set")
    heads = written(cut(mixed(of).groupBy("key", "component").agg(F.min("id").alias("id"))), "join-heads")
    some = picked(full, written(heads.select("id").distinct(), "join-ids"))
    of = written(components(as_links(of).unionByName(within(heads.join(some.hint("merge"), "id")))), "join-components")

    rest = written(cut(mixed(of)), "join-rest")
    maps = picked(full, written(rest.select("id").distinct(), "join-ids")).mapInArrow(_signatures, "id long, n long, lead long, signature binary")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component")
    near = links(rest.join(maps.hint("merge"), "id"))
    near = written(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-pairs")
    some = written(picked(full, written(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "join-ids")), "join-sets", "none")
    near = near.join(some.select(F.col("id").alias("a"), F.col("set").alias("xset")).hint("merge"), "a").join(some.select(F.col("id").alias("b"), F.col("set").alias("yset")).hint("merge"), "b")
    final = components(as_links(of).unionByName(near.mapInArrow(_confirmed, "a long, b long")))

    of_class = classes.join(final.withColumnRenamed("component", "of"), "id", "left").select("print", F.coalesce("of", "id").alias("component_id"))
    out = drawn.join(of_class, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if not single:
        out = docs.select("doc_id").join(out, "doc_id")
    nameless = docs.filter("doc_id is null").mapInArrow(_sized, "doc_id long, n long, print binary")
    return out.unionByName(nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def op13_signature_trees(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
