"""Token ids in files of directly addressable codes: any token is read without decoding a block."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import chunks
from .common import table, written

#: Bits of an id that each level holds, and bits of a continuation bitmap between two entries of its rank directory.
CHUNK_BITS, RANK_EVERY = 8, 512
#: A segment ends with the document that brings it to this many ids.
SEGMENT = 1 << 20
#: Segments up to which their offsets, some 24 bytes each, are broadcast when documents are read back.
OFFSETS = 200_000
#: Ranges or segments that a search by position names to the reader of the files.
NAMED = 1000
#: Pieces of text whose ids a worker remembers.
MEMORY = 700_000
MAGIC = b"DAC1"


def pack(ids: np.ndarray) -> bytes:
    """Ids as levels of one byte each, low bits first. A level's bitmap says which of its ids go on in the next; its directory has the count of set bits before every RANK_EVERY-th."""
    rest, levels = ids.astype(np.uint32), []
    while len(rest) or not levels:
        more = rest >> CHUNK_BITS != 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        per = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(per) - per).astype(np.uint32).tobytes()))
        rest = rest[more] >> CHUNK_BITS
    head = np.array([len(levels), *(x for n, *parts in levels for x in (n, *map(len, parts)))], np.uint32)
    return MAGIC + head.tobytes() + b"".join(p for _, *parts in levels for p in parts)


class Packed:
    """A packed segment: ids by position, alone or as a range, in the same few steps wherever they stand."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        count = int(np.frombuffer(blob, np.uint32, 1, 4)[0])
        head = np.frombuffer(blob, np.uint32, 4 * count, 8).reshape(count, 4).tolist()
        at, self.levels = 8 + 16 * count, []
        for _, values, bits, ranks in head:
            self.levels.append((np.frombuffer(blob, np.uint8, values, at), np.frombuffer(blob, np.uint8, bits, at + values), np.frombuffer(blob, np.uint32, ranks // 4, at + values + bits)))
            at += values + bits + ranks
        self.count = head[0][0]

    def __len__(self) -> int:
        return self.count

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at these positions, in any order."""
        at = np.asarray(at, np.int64)
        out, where = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (values, bits, ranks) in enumerate(self.levels):
            out[where] |= values[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            on = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            at, where = at[on], where[on]
            if not len(at):
                break
            # Set bits before a position: the directory's count, whole bytes since then, and the byte's own lower bits.
            first = at // RANK_EVERY * (RANK_EVERY // 8)
            inside = np.arange(RANK_EVERY // 8)
            lowest, highest = int(first.min()), int(first.max()) + RANK_EVERY // 8
            if len(at) * 16 > highest - lowest:
                sums = np.concatenate([[0], np.cumsum(np.bitwise_count(bits[lowest:highest]), dtype=np.int64)])
                byte = (at >> 3) - lowest
                whole = sums[byte] - sums[first - lowest]
            else:
                near = bits[np.minimum(first[:, None] + inside, len(bits) - 1)]
                whole = np.where(inside < ((at >> 3) - first)[:, None], np.bitwise_count(near), 0).sum(axis=1, dtype=np.int64)
            own = np.bitwise_count(bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8))
            at = ranks[at // RANK_EVERY].astype(np.int64) + whole + own.astype(np.int64)
        return out

    def range(self, start: int, stop: int) -> np.ndarray:
        return self.get(np.arange(start, stop))


@lru_cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_WITHIN_BLANKS = re.compile(r"\s (?:\s|\Z)").search
_BEFORE = [c + " " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]


def _uncut(text: str | None) -> bool:
    return not text or ((not text.isascii() or any(x in text for x in _BEFORE)) and _WITHIN_BLANKS(text) is not None)


class ByteBpe:
    """Ids by the tokenizers library, asked once for each distinct piece of text.

    A text is cut before each space that has something else than white space on one side at least. The file's splitter
    puts a border there whatever stands around, so the pieces' ids in a row are the text's. A text with another kind of
    space isn't cut, but goes to the library whole. New pieces go to the library joined into longer texts, from which
    each one's ids are told by the length of their tokens. Ids are kept in 16 bits if the vocabulary allows.
    """

    def __init__(self, path: str):
        self.library = _library(path)
        #: Pieces without the space before them; and texts' beginnings, which have none.
        self.known: dict[str, bytes] = {}
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.length[i] = len(token)  # byte-level: a character of a token is a byte of text

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, found: set[str]) -> None:
        """Makes all these pieces known; others are forgotten when they are too many."""
        if len(self.known) > MEMORY:
            self.known = {p: self.known[p] for p in found if p in self.known}
        new = found.difference(self.known)
        alone = [p for p in new if not p or p[0].isspace() or "<|" in p]
        self.known.update(zip(alone, self._alone([" " + p for p in alone]), strict=True))
        joined = list(new.difference(alone))
        groups = [joined[i : i + 2000] for i in range(0, len(joined), 2000)]
        for group, e in zip(groups, self.library.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(p.encode()) + 1 for p in group]), "left") + 1
            if ends[-1] != len(ids):
                raise AssertionError("tokens don't end where pieces do")
            raw, ends = ids.tobytes(), (ends * self.kind.itemsize).tolist()
            self.known.update((p, raw[i:j]) for p, i, j in zip(group, [0, *ends], ends, strict=False))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        firsts, split = [], []
        for t in texts:
            first, *rest = [t or ""] if _uncut(t) else t.split(" ")
            firsts.append(first)
            split.append(rest)
        self.learn(set().union(*split))
        return [first + b"".join(map(self.known.__getitem__, rest)) for first, rest in zip(self._alone(firsts), split, strict=True)]


@lru_cache(maxsize=2)
def _bytes(path: str) -> ByteBpe:
    return ByteBpe(path)


SEGMENTS = "part long, segment long, doc_ids array<long>, counts array<long>, codes binary"


def write_tokens(docs: DataFrame, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", bytes_per_part: int = 32_000_000) -> DataFrame:
    """The ids of all texts, each with end_id after it, in ascending doc_id order, as a written table of packed segments.

    Texts are dealt into ranges of doc_id and sorted there; each task encodes its range and packs about SEGMENT ids at
    a time, whole documents only. The segments go through Spark's writer into the shared folder, so a task that is
    repeated after a lost executor leaves nothing twice. Columns: part (the range), segment (in it), doc_ids, counts
    (ids of each document), codes (the file format: see pack()).

    Null and empty texts have the end id alone. Rows without doc_id come first, rows of one doc_id follow each other in
    the order of a hash of their texts, which also deals them into ranges, so that no id makes a range too large. More columns aren't read. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bpe = TaskContext.get().partitionId(), _bytes(path)
        end = np.array(end_id, bpe.kind).tobytes()
        segment, ids, counts, parts, total = 0, [], [], [], 0

        def out() -> pa.RecordBatch:
            codes = pack(np.frombuffer(b"".join(parts), bpe.kind))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([segment]), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([codes], pa.binary())], ["part", "segment", "doc_ids", "counts", "codes"])

        for batch in chunks(batches):
            for doc, x in zip(batch.column("doc_id").to_pylist(), bpe.encode(batch.column("text").to_pylist()), strict=True):
                ids.append(doc)
                counts.append(len(x) // bpe.kind.itemsize + 1)
                parts += [x, end]
                total += counts[-1]
                if total >= SEGMENT:
                    yield out()
                    segment, ids, counts, parts, total = segment + 1, [], [], [], 0
        if ids:
            yield out()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // bytes_per_part))
    by = F.col("doc_id").asc_nulls_first(), F.col("h")
    dealt = docs.repartitionByRange(int(ranges), *by).sortWithinPartitions(*by, "text")
    return written(dealt.mapInArrow(packed, SEGMENTS), "tokens", "none")


def _firsts(files: DataFrame) -> DataFrame:
    """part, segment, inside, n, before: the ids of a segment, those before it in its range, and those before its range."""
    counts = files.select("part", "segment", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # One row a range is ordered whole; a range's segments only among themselves.
    parts = counts.groupBy("part").agg(F.sum("n").alias("of")).select("part", (F.sum("of").over(Window.orderBy("part")) - F.col("of")).alias("before"))
    return counts.select("part", "segment", "n", (F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")).alias("inside")).join(parts, "part")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), read back from written segments by the documents' addresses, some documents in a row at a time. Segments stay where they are: their offsets come to them as a broadcast, up to OFFSETS of them."""
    firsts = _firsts(files)
    firsts = written(firsts.select("part", "segment", (F.col("inside") + F.col("before")).alias("first")), "token-offsets")
    firsts = F.broadcast(firsts) if firsts.count() <= OFFSETS else firsts.hint("merge")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, counts = Packed(row["codes"]), np.array(row["counts"])
                ends = np.cumsum(counts)
                for lo in range(0, len(counts), 200):
                    at = range(lo, min(lo + 200, len(counts)))
                    first = int(ends[lo] - counts[lo])
                    raw = codes.range(first, int(ends[at[-1]])).astype("<u4").tobytes()
                    ids = [raw[4 * (int(ends[k] - counts[k]) - first) : 4 * (int(ends[k]) - first)] for k in at]
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k] for k in at], pa.int64()), pa.array([row["first"] + int(ends[k] - counts[k]) for k in at], pa.int64()), pa.array([int(counts[k]) for k in at], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.join(firsts, ["part", "segment"]).mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(files: DataFrame, positions: DataFrame, *, position_col: str = "position") -> DataFrame:
    """position, token: the id at each asked position among all ids of written segments, 0 being the first of the lowest doc_id.

    A position finds its segment by the segments' offsets, and the id by its address in it; no block is decoded. Only
    segments that are asked are read where they lie in at most NAMED ranges: their names are pushed down to the files.
    What a segment is asked comes to it as one list of distinct positions, no longer than the segment. A position
    given several times has one row; one that is null, negative or past the end has none. More columns aren't read.
    """
    cell = lambda c: F.floor(c / F.lit(SEGMENT)).cast("long")
    first, end = F.col("inside") + F.col("before"), F.col("inside") + F.col("before") + F.col("n")
    spots = _firsts(files).filter("n > 0").select("part", "segment", first.alias("first"), end.alias("end"), F.explode(F.sequence(cell(first), cell(end - 1))).alias("cell"))
    asked = positions.select(F.col(position_col).cast("long").alias("position")).filter("position >= 0").distinct()
    met = asked.withColumn("cell", cell(F.col("position"))).join(spots, "cell").filter("position >= first and position < end")
    wanted = written(met.groupBy("part", "segment").agg(F.min("first").alias("first"), F.collect_list("position").alias("positions")), "tokens-asked")
    named = [r["part"] for r in wanted.select("part").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        segments = [r["segment"] for r in wanted.select("segment").distinct().limit(NAMED + 1).collect()]
        files = files.filter(F.col("part").isin(named))
        files = files.filter(F.col("segment").isin(segments)) if len(segments) <= NAMED else files

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                at = row.column("positions").flatten().to_numpy()
                got = Packed(row.column("codes")[0].as_py()).get(at - row.column("first")[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got.astype(np.int64))], ["position", "token"])

    return files.select("part", "segment", "codes").join(wanted, ["part", "segment"]).select("first", "positions", "codes").mapInArrow(fetched, "position long, token long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
