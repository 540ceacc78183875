"""BPE encoding and decoding with a lexicon of frequent words as a minimal acyclic transducer."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_file, table, with_columns, written
from .lexicon import LONGEST, Lexicon, automaton

#: Words in the lexicon at most: what the driver compiles and every executor gets is bounded by it.
LEXICON_WORDS = 131_072
#: Bytes of text in one go, and pieces that a worker remembers or counts before it passes them on.
CHUNK, MEMORY = 4_000_000, 200_000
#: Below this code point, and but for these characters, our own rules are those of the library, as the tests show; other pieces go through its normaliser and splitter.
OWN = 0x180
_ODD = re.compile(f"[\x1c-\x1f\x85\xa0{chr(OWN)}-\U0010ffff]")


def _byte_names() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary file of words with ends: lower case, split at blanks and between kinds of characters, merged by rank."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text("utf-8"))
        model = file["model"]
        self.path, self.ids, self.end = path, model["vocab"], model["end_of_word_suffix"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.names = _byte_names()
        self.tokens = [b""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        for token, i in [*self.ids.items(), *self.added.items()]:
            self.tokens[i] = token.encode()
        of = {k: "".join(re.escape(chr(c)) for c in range(OWN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[^ \t\n\x0b\x0c\r{of['L']}{of['N']}]+").findall

    @property
    @lru_cache  # noqa: B019  one object a worker
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def words(self, piece: str) -> list[bytes | int]:
        """The words of a piece without a space or new line, in UTF-8, and the ids of added tokens."""
        if "<|" in piece and len(parts := self.at_added.split(piece)) > 1:
            return [x for p in parts if p for x in ([self.added[p]] if p in self.added else self.words(p))]
        if not _ODD.search(piece):
            return [w.encode() for w in self.split(piece.lower())]
        of = {n: b for b, n in enumerate(self.names)}
        return [bytes(of[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def merge(self, word: bytes) -> list[int]:
        """Exactly: the pair of least rank, the leftmost of these, is merged until no pair has a rank."""
        parts: list[str | None] = [self.names[b] for b in word]
        parts[-1] += self.end
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        rank = self.ranks.get
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair)) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j < 0 or rank((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := rank((parts[i], parts[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [self.ids[p] for p in parts if p is not None]


@lru_cache
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(text: str | None) -> list[str]:
    """A text cut at spaces and new lines, which no word crosses."""
    return text.replace("\n", " ").split(" ") if text else []


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about `limit` bytes of a column; a longer value is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(batch):
            yield batch.slice(start)


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """(word in UTF-8, count) over all whole texts. Tasks count pieces first and split each distinct one once; they pass their counts on when they hold MEMORY pieces."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = vocabulary(path), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words: Counter[bytes] = Counter()
            for piece, n in seen.items():
                for w in vocab.words(piece):
                    if isinstance(w, bytes):
                        words[w] += n
            seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in chunks(batches):
            for text in batch.column("text").to_pylist():
                seen.update(pieces(text))
            if len(seen) > MEMORY:
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ship_lexicon(docs: DataFrame, path: str, *, most: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of all texts, at most `most` (words of one count all or none), into a file of the shared folder, from where executors map it (or fetch it first, where they don't see that folder as one of theirs); its address.

    Which words are in it bears on speed alone: other words are merged, with the same ids.
    """
    spark, vocab = docs.sparkSession, vocabulary(path)
    counts = written(count_words(docs, path).filter(F.length("word").between(1, LONGEST)), "word-counts")
    # How many words occur n times, from the most frequent down: as many whole steps as fit, so no task sorts or sends words that stay out.
    least, room = None, most
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect():
        if (room := room - r["words"]) < 0:
            break
        least = r["n"]
    words = [bytes(r["word"]) for r in counts.filter(F.col("n") >= least).select("word").collect()] if least else []
    address = shared_file(spark, "lexicon.bin", automaton(words, [vocab.merge(w) for w in words]))
    if not address.startswith("file:"):
        spark.sparkContext.addFile(address)
    return address


@lru_cache(maxsize=1)  # a worker that outlives a query forgets its lexicon and pieces with the next one
def _shipped(address: str) -> Lexicon:
    return Lexicon(address.removeprefix("file:") if address.startswith("file:") else SparkFiles.get(address.rsplit("/", 1)[1]))


class Encoder:
    """Pieces to ids: remembered pieces first, then the lexicon for all new words at once, then exact merges."""

    def __init__(self, vocab: WordBpe, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon
        self.known: dict[str, bytes] = {"": b""}
        self.merged: dict[bytes, bytes] = {}

    def learn(self, found: set[str]) -> None:
        """Makes all these pieces known; others are forgotten when they are too many."""
        if len(self.known) > MEMORY:
            self.known = {p: self.known[p] for p in found if p in self.known} | {"": b""}
        if len(self.merged) > MEMORY:
            self.merged.clear()
        new = {p: self.vocab.words(p) for p in found if p not in self.known}
        words = list({w for x in new.values() for w in x if isinstance(w, bytes)})
        ids: dict[bytes | int, bytes] = {i: np.uint32(i).tobytes() for i in self.vocab.added.values()}
        at, starts, mapped = self.lexicon.find(words), self.lexicon.starts, memoryview(self.lexicon.ids).cast("B")
        known = np.maximum(at, 0)
        for w, k, first, last in zip(words, at.tolist(), starts[known].tolist() if len(starts) > 1 else known.tolist(), starts[known + 1].tolist() if len(starts) > 1 else known.tolist(), strict=True):
            if k >= 0:
                ids[w] = bytes(mapped[4 * first : 4 * last])
            elif (got := self.merged.get(w)) is not None:
                ids[w] = got
            else:
                ids[w] = self.merged[w] = np.array(self.vocab.merge(w), np.uint32).tobytes()
        self.known |= {p: b"".join([ids[w] for w in x]) for p, x in new.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [pieces(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, x)) for x in split]


@lru_cache(maxsize=1)
def _encoder(path: str, name: str) -> Encoder:
    return Encoder(vocabulary(path), _shipped(name))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon: str | None = None, most: int = LEXICON_WORDS) -> DataFrame:
    """Every row's doc_id, ids (little-endian unsigned 32-bit, as binary) and n_tokens, as the tokenizers library gives them without special tokens.

    Null and empty texts have no ids. Texts of any length are encoded whole; a worker holds one slice of texts, its
    known pieces (at most some MEMORY) and the mapped lexicon. Rows may repeat. More columns aren't read. An empty
    table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name = lexicon or ship_lexicon(docs, path, most=most)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, name)
        for batch in chunks(batches):
            ids = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(encoded, f"doc_id {kind}, ids binary, n_tokens long")


def decode_ids(ids: bytes | None, vocab: WordBpe) -> bytes:
    return b" ".join(map(vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Rows with ids, and their decoded text: the tokens with a space between, as the library gives it for a file without a decoder. Null ids give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in chunks(batches, "ids"):
            texts = [decode_ids(x, vocab) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(decoded, with_columns(rows.schema, "decoded string"))


def digests(docs: DataFrame, path: str, *, with_ids: bool = False, most: int = LEXICON_WORDS) -> DataFrame:
    """Every row's doc_id, n_tokens, ids_sha256 and decoded_sha256, and its ids if asked for: encoded and decoded again in one pass, so that no decoded text leaves its task. Cases as in encode()."""
    docs = docs.select("doc_id", "text")
    name = ship_lexicon(docs, path, most=most)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, name)
        for batch in chunks(batches):
            ids = encoder.encode(batch.column("text").to_pylist())
            sha = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, (decode_ids(x, encoder.vocab) for x in ids))]
            out = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *sha, *([pa.array(ids, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(digested, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op1_bpe_lexicon(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
