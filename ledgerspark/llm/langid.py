"""Language by compression: a text belongs to the language whose dictionary makes it smallest."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import chunks
from .common import table, with_columns

#: Bytes of a language's dictionary, bytes of a text that goes into one and texts tried for one: the bounds of the fit.
DICTIONARY, LONGEST_SAMPLE, SAMPLES = 32_000, 2_000, 120
#: Slices of a longer text, where a language has too few short ones.
SLICES = 16
#: Texts too short for the sample are first thinned out in so many parts of a language, so that no task meets all of them.
SPREAD = 100
#: A text is compressed in blocks, so that its own earlier words don't stand in for the dictionary's.
BLOCK, LEVEL = 2_000, 5
#: The best language must save this share of the second's size, or the text is rejected.
MARGIN = 0.003


def mark_ranges() -> list[tuple[int, int]]:
    """The code points of Unicode's marks, as first and last of each run."""
    out: list[tuple[int, int]] = []
    for c in range(0x300, 0xE01F0):
        if unicodedata.category(chr(c))[0] == "M":
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


# Vowel signs and other marks belong to the letters before them; few texts have any, so only those are cut by the longer pattern.
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in mark_ranges())
_HIGH, _HAS_MARKS = re.compile("[\u0300-\U0010ffff]+"), re.compile(f"[{_MARKS}]")
_NO_LETTERS, _NO_LETTERS_OR_MARKS = re.compile(r"[\W\d_]+"), re.compile(rf"(?:[^\w{_MARKS}]|[\d_])+")


def normal(text: str | None) -> bytes:
    """Letters in lower case with one space between runs of them: neither capitals nor symbols tell languages apart."""
    marked = text and any(map(_HAS_MARKS.search, _HIGH.findall(text)))
    kept = (_NO_LETTERS_OR_MARKS if marked else _NO_LETTERS).sub(" ", text.lower()).strip() if text else ""
    return kept.encode() if any(c.isalpha() for c in kept[:64]) or any(map(str.isalpha, kept)) else b""


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """Per language, for every label there is, sample texts in a row, up to about DICTIONARY bytes. labelled: key, text, lang; the sample is the texts whose keys hash lowest, of those not too long; what these leave open is filled from the others."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64(F.lit(9), "key")
    by_hash = Window.partitionBy("lang").orderBy("h", "text")
    small = rows.filter(F.octet_length("text").between(40, LONGEST_SAMPLE)).select("lang", "text", h.alias("h")).withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= SAMPLES)
    before = F.sum(F.octet_length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0)) - F.octet_length("text")
    picked = small.withColumn("before", before).filter(F.col("before") < DICTIONARY).orderBy("lang", "k").select("lang", "text")
    out: dict[str, list[bytes]] = {r["lang"]: [] for r in rows.select("lang").distinct().collect()}
    for r in picked.collect():  # at most DICTIONARY + LONGEST_SAMPLE bytes a language
        out[r["lang"]].append(normal(r["text"]))
    if open_ := sorted(lang for lang, x in out.items() if sum(map(len, x)) < DICTIONARY // 2):
        few = rows.sparkSession.createDataFrame([(lang,) for lang in open_], "lang string")
        for r in others(rows.join(few, "lang", "left_semi")).collect():
            if sum(map(len, out[r["lang"]])) < DICTIONARY:
                out[r["lang"]].append(normal(r["text"]))
    return {lang: b" ".join(x) for lang, x in sorted(out.items())}


def others(rows: DataFrame) -> DataFrame:
    """lang, text: from texts too long for the sample, slices spread over each whole text, together about DICTIONARY characters a language; then texts too short for it, up to DICTIONARY bytes."""
    n, bytes_ = F.length("text"), F.octet_length("text")
    width = DICTIONARY // SLICES
    slices = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(F.col("text"), F.floor(i * n / SLICES).cast("int") + 1, F.least(F.lit(width), F.ceil(n / SLICES).cast("int"))))
    h = F.xxhash64(F.lit(9), "key", "text").alias("h")
    lowest = lambda df, most, *by: df.withColumn("k", F.row_number().over(Window.partitionBy("lang", *by).orderBy("h"))).filter(F.col("k") <= most)
    # Chosen by hash alone, a few rows a language from each task; only then are their texts picked out and cut.
    long = rows.filter(bytes_ > LONGEST_SAMPLE).select("lang", "text", h)
    chosen = lowest(long.select("lang", "h").distinct(), SAMPLES)
    chosen = chosen.withColumn("share", F.ceil(F.lit(width) / F.max("k").over(Window.partitionBy("lang"))).cast("int"))
    texts = long.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"])
    cut = F.transform(slices, lambda p: F.substring(p, F.lit(1), F.col("share")))
    short = lowest(rows.filter(bytes_ < 40).select("lang", "text", h).distinct().withColumn("b", F.pmod("h", F.lit(SPREAD))), 2 * DICTIONARY // SPREAD, "b").drop("k", "b")
    short = lowest(short, DICTIONARY).select("lang", F.lit(True).alias("short"), "k", "text")
    got = texts.select("lang", F.lit(False).alias("short"), "k", F.array_join(cut, " ").alias("text")).unionByName(short)
    order = Window.partitionBy("lang").orderBy("short", "k").rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn("before", F.sum(F.octet_length("text")).over(order) - F.octet_length("text")).filter(F.col("before") < 2 * DICTIONARY).orderBy("lang", "short", "k").select("lang", "text")


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.of = {}
        for lang, content in dictionaries.items():
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if own:
                own.precompute_compress(level=LEVEL)
            self.of[lang] = zstandard.ZstdCompressor(**plain, **({"dict_data": own} if own else {})).compress

    def sizes(self, content: bytes) -> list[tuple[int, str]]:
        blocks = [content[i : i + BLOCK] for i in range(0, len(content), BLOCK)]
        return sorted((sum(len(compress(b)) for b in blocks), lang) for lang, compress in self.of.items())


def predict(docs: DataFrame, learned: dict[str, bytes], *, margin: float = MARGIN) -> DataFrame:
    """docs (text and any others) with lang_pred, score and rejected.

    score is the share of the second smallest size that the smallest saves, 1 if there is one language only. A text
    without letters is `und`, score 0, rejected; so is every text if no language was learned. A text whose score is
    below the margin keeps its language but is rejected. Ties go to the first language by name. Texts are taken whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Compressors(sent.value)
        for batch in chunks(batches):
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                content = normal(text)
                first, *others = of.sizes(content) if content and of.of else [(0, "und")]
                langs.append(first[1])
                scores.append(0.0 if first[1] == "und" or not content else 1 - first[0] / others[0][0] if others else 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predicted, with_columns(docs.schema, "lang_pred string, score double")).withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < margin))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """Every row's doc_id, held_out, lang_pred, score and rejected.

    Languages are learned from labelled rows that aren't held out (crc32 of the id as text, modulo 4, isn't 2), within
    the bounds above; every whole text is classified, by itself alone. Null and empty texts are `und`. A null id hashes
    as an empty one. A label none of whose texts has letters can't be learned and isn't predicted; one with less than 8
    bytes of samples is compared without a dictionary. Rows may repeat. More columns aren't read. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learned = dictionaries(rows.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))
    out = predict(rows.select("doc_id", "text"), learned, margin=margin)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
