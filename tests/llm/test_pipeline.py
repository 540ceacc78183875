"""The pipeline's stages, each against a plain version of its decisions."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from ledgerspark.llm import mixing, pii
from ledgerspark.llm.common import written
from tests.llm.test_near_dup import brute


def test_stages(spark, docs, sf):
    columns = docs.columns
    one = written(C.language(spark, docs, sf), "test")
    assert one.columns == columns and one.count() > 0.9 * docs.count() and one.exceptAll(docs).isEmpty()

    two = written(C.near_dedup(spark, one, sf), "test")
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {i for i, (_, _, kept) in brute(rows).items() if kept} and two.columns == columns

    three = written(C.personal_data(spark, two, sf), "test")
    assert three.columns == columns and three.count() == two.count()
    old = {r.doc_id: r.text for r in two.collect()}
    for r in three.collect():
        assert r.n_chars == len(r.text)
        assert (r.text == old[r.doc_id]) or any(f"<{k}>" in r.text for k in pii.KINDS)
        assert bool(pii.base_spans(old[r.doc_id])) <= (r.text != old[r.doc_id])

    four = written(C.mix(spark, three, sf), "test")
    want = Counter({r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies})
    assert Counter(r.doc_id for r in four.collect()) == want and four.columns == columns

    five = C.tokens(spark, four, sf)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in four.collect()}
    for r in five.collect():
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
    assert five.count() == four.count()


def test_odd_rows(spark, odd, none, sf):
    for docs in (odd, none):
        for name, stage in C.STAGES:
            out = written(stage(spark, docs, sf), "test")
            assert name == "tokens" or out.columns == docs.columns
            docs = out
    assert C.run(spark, sf).count() > 0


def test_columns_of_any_name(spark, docs, sf):
    some = docs.limit(60).withColumnsRenamed({}).withColumn("my col", docs["doc_id"] + 1).withColumn("a:b", docs["source"]).withColumn("x`y.z", docs["n_chars"]).withColumn("row", docs["lang"])
    here = some
    for name, stage in C.STAGES:
        out = written(stage(spark, here, sf), "test")
        assert name == "tokens" or out.columns == some.columns
        here = out if name != "tokens" else here
    rows = {r["doc_id"]: r for r in some.collect()}
    assert here.count() and all(r["my col"] == rows[r["doc_id"]]["my col"] and r["a:b"] == rows[r["doc_id"]]["a:b"] and r["x`y.z"] == rows[r["doc_id"]]["x`y.z"] for r in here.collect())


def test_mix_is_the_same_however_rows_are_dealt(spark, sf):
    """Rows without id or with one that others have too, alike in size and source, and rows alike in all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None if i % 2 else 7, f"w{i} and some more words of it {i * i}", "en", "s1", None) for i in range(80)]
    rows += [(7, "two words", "en", "s2", None), (7, "three words here", "en", "s1", None)] + [(None, "all the same", "en", "s2", 3)] * 30 + [(100 + i, f"own words {i}", "en", "s2", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    taken = [Counter(tuple(r) for r in C.mix(spark, d, sf).collect()) for d in (docs.coalesce(1), docs.repartition(7), docs.repartition(5, "text").sortWithinPartitions("n_chars"))]
    assert taken[0] == taken[1] == taken[2]
    for row, n in taken[0].items():
        assert n <= 3 * rows.count(row)
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in ("s1", "s2")}
    got = {s: sum(n * len(r[1].split()) for r, n in taken[0].items() if r[3] == s) for s in ("s1", "s2")}
    total = sum(sizes.values())
    assert abs(got["s1"] - min(total / 3, 3 * sizes["s1"])) <= 5 and abs(got["s1"] + got["s2"] - total) <= 8
