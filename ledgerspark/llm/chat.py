"""Preference formatting: a chosen and a rejected conversation as one prompt and two masked completions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, with_columns

#: The turn template: fixed strings around a turn's role and text.
BEFORE_ROLE, BEFORE_TEXT, AFTER_TEXT = "<|", "|>\n", "<|end|>\n"


def conversations_as_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array of (role, text) in the order of turn, then role, then text. A conversation is one training example and so one row. Rows without a conversation are left out; null roles and texts count as empty; repeated rows are turns like others, texts of any length are taken whole. More columns, of whatever name, aren't read. An empty table gives an empty one."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), one.alias("t"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return got.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escaped(text: Column) -> Column:
    """A role or text in which nothing reads as a mark of the template: a backslash goes between `<` and a `|` or backslash after it. Taking these out again, `<|` first, gives the text back."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def rendered(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(BEFORE_ROLE), escaped(t["role"]), F.lit(BEFORE_TEXT), escaped(t["text"]), F.lit(AFTER_TEXT))
    return F.array_join(F.transform(turns, one), "")


def answer_spans(turns: Column, role: str) -> Column:
    """(start, end) in code points of the rendered turns: what a turn of this role says and its end mark. These count for the loss; all else is masked."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(escaped(t["role"])) + len(BEFORE_ROLE + BEFORE_TEXT)
        end = first + F.length(escaped(t["text"])) + len(AFTER_TEXT)
        span = F.struct(first.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def shared_turns(a: Column, b: Column) -> Column:
    """How many leading turns two conversations have in common."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_preferences(pairs: DataFrame, *, answers: str = "assistant") -> DataFrame:
    """pairs (pair_id, chosen, rejected: arrays of (role, text)) -> pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, tied.

    The longest common prefix of turns is the prompt, rendered once; the rest of each side is its completion, with the
    spans of it that count for the loss. A side that ends in the prompt has an empty completion; two equal sides are
    tied and have two. No common turn: the prompt is empty. A null side counts as one without turns.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    got = pairs.select("pair_id", F.coalesce("chosen", none).alias("a"), F.coalesce("rejected", none).alias("b"))
    got = got.withColumn("prompt_turns", shared_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    got = got.select("pair_id", "prompt_turns", F.slice("a", 1, F.col("prompt_turns")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return got.select(
        "pair_id", "prompt_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"),
        answer_spans(F.col("a"), answers).alias("chosen_spans"), answer_spans(F.col("b"), answers).alias("rejected_spans"),
        ((F.size("a") == 0) & (F.size("b") == 0)).alias("tied"),
    )


def next_ids(ids: DataFrame, parts: int = 64) -> DataFrame:
    """conv_id, next_id: the next higher id there is; the highest one's is the lowest. ids: conv_id, each once. Ranges of ids have their own lead; where a range ends, the first id of the next one follows, of at most `parts` that are ordered together."""
    edges = sorted(set(ids.approxQuantile("conv_id", [i / parts for i in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("conv_id"))) if edges else F.lit(0)
    cut = ids.select("conv_id", part.alias("part"))
    heads = cut.groupBy("part").agg(F.min("conv_id").alias("head"))
    after = F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy()))
    heads = F.broadcast(heads.select(F.col("part").alias("of"), after.alias("after")))
    own = F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id"))
    return cut.withColumn("own", own).join(heads, F.col("part") == F.col("of")).select("conv_id", F.coalesce("own", "after").alias("next_id"))


def crossed(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations, one for each: it is chosen; rejected is its own beginning and then what the conversation of the next id says from there on (next_ids()).

    The beginning is a share of 0 to 3 quarters of the turns, by the id, so prompts of all lengths occur, and sides of
    different lengths. Of a single conversation both sides are the same.
    """
    nxt = conversations.select(F.col("conv_id").alias("next_id"), F.col("turns").alias("others"))
    pairs = conversations.join(next_ids(conversations.select("conv_id")), "conv_id").join(nxt, "next_id")
    own = F.floor(F.size("turns") * F.pmod("conv_id", F.lit(4)) / 4).cast("int")
    rest = F.slice("others", own + 1, F.size("others"))
    return pairs.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), own), rest).alias("rejected"))


def tokenised(rows: DataFrame, path: str, *, masked: int = -100) -> DataFrame:
    """Rows of format_preferences() with prompt_ids, and for either side ids and labels: the label of a token is its id inside the spans that count and `masked` elsewhere. path: a byte-level vocabulary.

    What lies between two borders of spans is encoded by itself, so no token is half masked. Null texts have no ids.
    """
    from .token_files import _bytes

    names = ["prompt_ids", "chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bytes(path)
        ids = lambda texts: [np.frombuffer(x, bpe.kind).tolist() for x in bpe.encode(texts)]
        for batch in batches:
            out = {"prompt_ids": ids(batch.column("prompt").to_pylist())}
            for side in ("chosen", "rejected"):
                pieces, counts = [], []
                for text, spans in zip(batch.column(side).to_pylist(), batch.column(f"{side}_spans").to_pylist(), strict=True):
                    text = text or ""
                    borders = [0, *(x for s in spans or [] for x in (s["start"], s["end"])), len(text)]
                    pieces += [text[i:j] for i, j in zip(borders, borders[1:], strict=False)]
                    counts.append(len(borders) - 1)
                got, at = ids(pieces), 0
                out[f"{side}_ids"], out[f"{side}_labels"] = [], []
                for n in counts:
                    own = got[at : at + n]
                    out[f"{side}_ids"].append([i for x in own for i in x])
                    out[f"{side}_labels"].append([i if k % 2 else masked for k, x in enumerate(own) for i in x])
                    at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[c], pa.list_(pa.int32())) for c in names)], [*batch.schema.names, *names])

    return rows.mapInArrow(encoded, with_columns(rows.schema, ", ".join(f"{c} array<int>" for c in names)))


def op6_preference_format(spark, sf_dir: str) -> DataFrame:
    got = format_preferences(crossed(conversations_as_turns(table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return got.select(
        F.col("pair_id").alias("conv_id"), "prompt_turns", sha("prompt").alias("prompt_sha256"), sha("chosen").alias("chosen_sha256"), sha("rejected").alias("rejected_sha256"),
        spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"), "tied",
    )


_SPANS_SQL = """array_to_string(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant'
    THEN concat(coalesce(list_sum(list_transform({0}[1:i - 1], lambda x: length(x.said))), 0) + {0}[i].head, ':', list_sum(list_transform({0}[1:i], lambda x: length(x.said)))) END), lambda x: x IS NOT NULL), ',')"""

OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         replace(replace(coalesce(role, ''), '<\', '<\\'), '<|', '<\|') AS erole, replace(replace(coalesce(text, ''), '<\', '<\\'), '<|', '<\|') AS etext
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({{'role': role, 'text': text, 'said': '<|' || erole || '|>' || chr(10) || etext || '<|end|>' || chr(10), 'head': length(erole) + 5}} ORDER BY turn, role, text) AS turns
  FROM t GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id FROM c),
pairs AS (
  SELECT c.conv_id, c.turns AS a, list_concat(c.turns[1:len(c.turns) * (c.conv_id % 4) // 4], o.turns[len(c.turns) * (c.conv_id % 4) // 4 + 1:]) AS b
  FROM c JOIN n USING (conv_id) JOIN c o ON o.conv_id = n.next_id),
p AS (
  SELECT *, coalesce(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text)[1] - 1, least(len(a), len(b))) AS k FROM pairs),
r AS (SELECT conv_id, k, a[1:k] AS p, a[k + 1:] AS a, b[k + 1:] AS b FROM p)
SELECT conv_id, CAST(k AS INTEGER) AS prompt_turns, sha256(array_to_string(list_transform(p, lambda x: x.said), '')) AS prompt_sha256,
       sha256(array_to_string(list_transform(a, lambda x: x.said), '')) AS chosen_sha256, sha256(array_to_string(list_transform(b, lambda x: x.said), '')) AS rejected_sha256,
       {_SPANS_SQL.format("a")} AS chosen_spans, {_SPANS_SQL.format("b")} AS rejected_spans, len(a) = 0 AND len(b) = 0 AS tied
FROM r
"""
