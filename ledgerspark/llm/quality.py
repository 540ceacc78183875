"""Quality rules: repeated text, and the distance of a document's histograms from its language's."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

SYMBOLS = "#*$%&|<>"
#: Character classes by patterns that don't overlap and take none of the symbols; what none takes is the last class.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{N}", "blank": r"[\x20\x09-\x0D]", "mark": r"[.,;:!?'\"()\-]"}


#: Words of all languages' lists up to which a driver list of them is small.
KNOWN = 4096


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. Histograms of texts shorter than the guards say nothing and are not held against them."""

    window: int = 8
    least_words: int = 20
    most_repeated: int = 30
    common_words: int = 24
    guard_chars: int = 200
    guard_words: int = 50
    most_char_distance: float = 0.25
    #: Quartile distances above the median that a language's texts of like length may lie, and the texts needed to tell; with fewer, most_word_distance holds.
    word_spread: float = 5.0
    least_texts: int = 30
    most_word_distance: float = 0.80


def counted_words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _let(x: Column, body) -> Column:
    """body(x), with x worked out once however often body names it."""
    return F.get(F.transform(F.array(x), body), 0)


def window_hashes(words: Column, window: int) -> Column:
    """A hash of each `window` words in a row, by their first. Hashes of windows are made from those of windows of half the width, a few steps a word; the last window - 1 hashes mean nothing."""

    def widened(h: Column, width: int) -> Column:
        if width == window:
            return h
        step = min(width, window - width)
        return _let(F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda x, y: F.xxhash64(x, y)), lambda v: widened(v, width + step))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: widened(h, 1))


def repeated_words(words: Column, window: int) -> Column:
    """Words covered by windows of `window` words that occur twice or more, the first included.

    The windows' hashes are put in order with their places, so equal ones stand side by side; each place next to an
    equal one starts a repeated window, and places in order cover min(window, distance to the next) words each. That
    takes n log n steps in the text's length, however much of it repeats, and only where some hash occurs twice.
    """
    n = F.size(words)

    def covered(ordered: Column) -> Column:
        pairs = F.zip_with(F.slice(ordered, F.lit(1), n - window), F.slice(ordered, F.lit(2), n - window), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        places = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        return F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-1 - window).alias("last")), lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(window), i - acc["last"])).alias("sum"), i.alias("last")), lambda acc: acc["sum"])

    def of(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < n - window + 1, _let(ordered, covered)).otherwise(F.lit(0))

    return F.when(n > window, _let(F.slice(window_hashes(words, window), F.lit(1), n - window + 1), of)).otherwise(F.lit(0)).cast("long")


def class_counts(text: Column) -> tuple[dict[str, Column], Column]:
    """How many characters of each class a text has, and the characters of no class. Each class is taken out, in runs, of what the ones before left."""
    counts = {}
    for name, pattern in CLASSES.items():
        left = F.regexp_replace(text, f"(?:{pattern})+", "")
        counts[name], text = F.length(text) - F.length(left), left
    return counts, text


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of counts; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        F.struct(F.lit(0.0).alias("d"), total(a).alias("na"), total(b).alias("nb")),
        lambda s, v: F.struct((s["d"] + _part(v["x"] / F.nullif(s["na"], F.lit(0.0)), v["y"] / F.nullif(s["nb"], F.lit(0.0)))).alias("d"), s["na"].alias("na"), s["nb"].alias("nb")),
        lambda s: F.sqrt(F.greatest(s["d"], F.lit(0.0))),
    )


def _part(p: Column, q: Column) -> Column:
    side = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0) * x)
    return (side(p, q) + side(q, p)) / 2


def measured(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, lang, text -> the base figures of each text and its class counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "lang", text.alias("text"), counted_words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    classes, rest = class_counts(F.col("text"))
    return split.select(
        "doc_id", "lang", "words",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - classes["blank"]).cast("long").alias("word_chars"),
        (F.length(rest) - F.length(F.translate(rest, SYMBOLS, ""))).cast("long").alias("n_symbols"),  # no symbol is of a class
        F.aggregate(F.array(lines), F.lit(0), lambda s, x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), rules.window).alias("n_repeat_words"),
        F.array(*[c.cast("double") for c in classes.values()], F.length(rest).cast("double")).alias("classes"),
    )


def common_words(docs: DataFrame, rules: Rules) -> DataFrame:
    """lang, common, ref_words: per language, from all its whole texts, its most common words, and how often each and how often others occur. Null is a language too. One row a language, each of a fixed size."""
    words = written(docs.select("lang", F.explode(counted_words(F.col("text"))).alias("word")).groupBy("lang", "word").count(), "quality-words")
    totals = words.groupBy("lang").agg(F.sum("count").alias("all"))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = words.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rules.common_words)
    top = top.groupBy(F.col("lang").alias("of")).agg(F.sort_array(F.collect_list(F.struct("k", "word", "count"))).alias("top"))
    out = totals.join(top, F.col("lang").eqNullSafe(F.col("of")))
    counts = F.transform("top", lambda t: t["count"].cast("double"))
    rest = F.col("all") - F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)
    return out.select(F.col("lang").alias("ref_lang"), F.transform("top", lambda t: t["word"]).alias("common"), F.array_append(counts, rest).alias("ref_words"))


def word_histogram(text: Column, common: Column) -> Column:
    """How often each word of a list is in a text whose words stand between spaces of their own: taking one out shortens the text by its count."""
    return F.transform(common, lambda w: (F.length(text) - F.length(F.replace(text, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2.0))


def spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def nearest_language(got: DataFrame, refs: DataFrame, text: Callable[[Column], Column]) -> DataFrame:
    """got with labelled, and with lang of rows that have none set to that of the nearest reference by words, of equal ones the first by name. text: the spaced words of a row that are in a reference's list. The references come to the rows as one row."""
    every = refs.agg(F.sort_array(F.collect_list(F.struct("ref_lang", "common", "ref_words"))).alias("refs"))

    def away(r: Column) -> Column:
        counts = word_histogram(text(r["common"]), r["common"])
        return F.struct(distance(F.array_append(counts, F.col("n_words") - F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)), r["ref_words"]).alias("d"), r["ref_lang"].alias("lang"))

    none = got.filter("lang is null").crossJoin(every).withColumn("lang", F.array_min(F.transform("refs", away))["lang"]).drop("refs").withColumn("labelled", F.lit(False))
    return got.filter("lang is not null").withColumn("labelled", F.lit(True)).unionByName(none)


def word_limits(measured: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(limit_lang, limit_band, own_limit) and (all_band, all_limit): the median word distance of a language's texts of like length, and of all texts of that length, plus word_spread times what lies between it and the lower quartile.

    The lower half tells the spread, because junk is far off and only lengthens the upper one. Copies, which have the same length and distance, count once. Counts of distances in
    thousandths give the quartiles, the same on every run; a group has 1000 of them at most.
    """
    cells = measured.filter((F.col("n_words") >= rules.guard_words) & F.col("word_distance").isNotNull())
    cells = cells.select("lang", "band", "n_words", "word_distance").distinct().groupBy("lang", "band", F.floor(F.col("word_distance") * 1000).alias("cell")).agg(F.count("*").alias("n"))

    def limits(counts: DataFrame, *keys: str) -> DataFrame:
        group = Window.partitionBy(*keys)
        upto, total = F.sum("n").over(group.orderBy("cell")), F.sum("n").over(group)
        at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("cell"))) / 1000
        got = counts.withColumns({"upto": upto, "total": total}).filter(F.col("total") >= rules.least_texts)
        return got.groupBy(*keys).agg((at(0.5) + rules.word_spread * (at(0.5) - at(0.25))).alias("limit"))

    own = limits(cells, "lang", "band").select(F.col("lang").alias("limit_lang"), F.col("band").alias("limit_band"), F.col("limit").alias("own_limit"))
    every = limits(cells.groupBy("band", "cell").agg(F.sum("n").alias("n")), "band")
    return own, every.select(F.col("band").alias("all_band"), F.col("limit").alias("all_limit"))


def chance_distance(n: Column, bins: int) -> Column:
    """What a text of n words drawn from the reference itself may be away from it by chance: the mean of the chi-square law and two deviations. No limit is lower, so that many near copies of one text don't narrow a language to it."""
    return F.sqrt(bins / (8 * math.log(2) * n)) + 2 / F.sqrt(16 * math.log(2) * n)


def judge(docs: DataFrame, rules: Rules | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row's doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    kept: not base_failed, and neither histogram is farther from the reference of the row's language than the limits; a
    histogram of a text shorter than its guard doesn't count. The words' limit follows the spread of distances among all
    texts of the language and of like length (word_limits); where these are few, among those of all languages. The reference of a language is made from all its texts. A
    row without a language is held against the language whose reference is nearest, and goes into no reference and no
    limit; where no row has a language, null is the one they share. Null and empty texts have no words and fail. Rows may repeat, ids be null. More
    columns aren't read. An empty table gives an empty one.

    Texts are read twice: once for the words of each language, once to be measured; the characters' reference is the mean
    of what was measured, each text's shares counting alike. References are tables with a row a language, of every language
    there is; they are joined by language, as broadcasts only where Spark finds their files small.
    """
    rules = rules or Rules()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    refs = written(common_words(rows.filter("lang is not null"), rules), "quality-references")
    named = not refs.isEmpty()
    if not named:
        refs = written(common_words(rows, rules), "quality-references")
    got = measured(rows, rules)
    # Few known words in all: a hash set of them leaves the common words of a text, before the join. Many: the text's own language's list does, after it. The counts are the same.
    known: list[str] = []
    if (refs.agg(F.sum(F.size("common"))).first()[0] or 0) <= KNOWN:
        known = sorted({w for r in refs.select("common").collect() for w in r["common"]})
        got = got.withColumn("words", F.filter("words", lambda w: w.isin(known)) if known else F.array().cast("array<string>"))
    if known:
        got = got.withColumn("common_text", spaced(F.col("words"))).drop("words")
    in_list = lambda common: F.col("common_text") if known else spaced(F.filter("words", lambda w: F.array_contains(common, w)))
    got = nearest_language(got, refs, in_list) if named else got.withColumn("labelled", F.lit(True))
    got = got.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").drop("ref_lang").withColumn("common_text", in_list(F.col("common")))
    got = written(got.withColumn("hist", word_histogram(F.col("common_text"), F.col("common"))).drop("common_text", "common", "words"), "quality-measured")
    got = got.withColumn("hist", F.array_append("hist", F.col("n_words") - F.aggregate("hist", F.lit(0.0), lambda s, v: s + v)))
    chars = F.aggregate("classes", F.lit(0.0), lambda s, v: s + v)
    classes = got.filter("labelled").groupBy(F.col("lang").alias("class_lang")).agg(F.array(*[F.avg(F.get("classes", i) / F.nullif(chars, F.lit(0.0))) for i in range(len(CLASSES) + 1)]).alias("ref_classes"))
    got = got.join(written(classes, "quality-classes"), F.col("lang").eqNullSafe(F.col("class_lang")), "left")
    got = got.withColumns({
        "char_distance": F.when(F.col("n_words") > 0, distance(F.col("classes"), F.col("ref_classes"))),
        "word_distance": F.when(F.col("n_words") > 0, distance(F.col("hist"), F.col("ref_words"))),
        "base_failed": (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")),
    })
    got = got.withColumn("band", F.floor(2 * F.log2(F.nullif(F.col("n_words"), F.lit(0)))))
    own, every = word_limits(got.filter("labelled"), rules)
    got = got.join(written(own, "quality-limits"), F.col("lang").eqNullSafe(F.col("limit_lang")) & (F.col("band") == F.col("limit_band")), "left").join(F.broadcast(every), F.col("band") == F.col("all_band"), "left")
    limit = F.greatest(F.coalesce("own_limit", "all_limit", F.lit(rules.most_word_distance)), chance_distance(F.col("n_words"), rules.common_words))
    odd_chars = (F.col("word_chars") >= rules.guard_chars) & (F.col("char_distance") > rules.most_char_distance)
    odd_words = (F.col("n_words") >= rules.guard_words) & (F.col("word_distance") > limit)
    kept = ~F.col("base_failed") & ~F.coalesce(odd_chars, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", kept.alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
