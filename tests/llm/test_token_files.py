import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
@pytest.mark.parametrize("most", [2, 256, 257, 50257, 1 << 31])
def test_codes_give_back_any_id(n, most):
    x = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    p = T.Packed(T.pack(x))
    assert len(p) == n and (p.range(0, n) == x).all()
    at = np.random.default_rng(1).integers(0, n, 40) if n else np.empty(0, int)
    assert (p.get(at) == x[at]).all() and all(p.get([k])[0] == x[k] for k in at[:5])


def test_pieces_equal_library():
    rng = random.Random(3)
    texts = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "a\n \nb", "a\n ", "<|endoftext|> x y<|endoftext|>", "don't 's 1 2"]
    texts += ["".join(rng.choice(" \n\tab1.'é\xa0　日") for _ in range(30)) for _ in range(2000)]
    texts += ["".join(rng.choice([chr(rng.randrange(1, 0x200)), rng.choice(" \n'sStTdD.1")]) for _ in range(40)) for _ in range(2000)]
    bpe = T.ByteBpe(PATH)
    got = bpe.encode(texts)
    assert [np.frombuffer(g, bpe.kind).tolist() for g in got] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_files_round_trip(docs, odd, none):
    for df in (docs, odd, none):
        start, want = 0, []
        for r in df.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect():
            ids = [*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 2]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in T.read_documents(T.write_tokens(df, PATH)).collect()), key=lambda r: r[1])
        assert got == want


def test_tokens_by_position(spark, docs, none, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 1000)  # of positions only: workers pack as they are
    files = T.write_tokens(docs, PATH, bytes_per_part=20_000)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(T.read_documents(files).collect(), key=lambda r: r.start)])
    at = [0, 1, 1, 999, 1000, len(ids) - 1, len(ids), -1, None, *np.random.default_rng(8).integers(0, len(ids), 300).tolist()]
    asked = spark.createDataFrame([(p, "x") for p in at], "position long, token string")
    want = {p: int(ids[p]) for p in at if p is not None and 0 <= p < len(ids)}
    got = T.tokens_at(files, asked).collect()
    assert len(got) == len(want) and {r.position: r.token for r in got} == want
    monkeypatch.setattr(T, "NAMED", 1)
    assert {r.position: r.token for r in T.tokens_at(files, asked).collect()} == want
    assert T.tokens_at(T.write_tokens(none, PATH), asked).count() == 0 and T.tokens_at(files, asked.limit(0)).count() == 0


def test_one_position_names_its_range(spark, docs):
    files = T.write_tokens(docs, PATH, bytes_per_part=20_000)
    plan = T.tokens_at(files, spark.createDataFrame([(5,)], "position long"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(part," in plan


def test_offsets_too_many_to_broadcast(docs, monkeypatch):
    files = T.write_tokens(docs, PATH)
    rows = lambda: sorted((r.doc_id, r.start, r.n_tokens, r.ids) for r in T.read_documents(files).collect())
    want = rows()
    monkeypatch.setattr(T, "OFFSETS", 0)
    assert rows() == want


def test_hot_id_is_dealt_over_ranges(spark):
    """Rows of one id, a third of all, still round-trip, in the order of their hashes."""
    df = spark.createDataFrame([(i if i % 3 else 7, f"text {i} " * 20) for i in range(600)], "doc_id long, text string")
    start, want = 0, []
    for r in df.orderBy("doc_id", F.xxhash64("text"), "text").collect():
        ids = [*LIBRARY.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = T.read_documents(T.write_tokens(df, PATH, bytes_per_part=20_000))
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got.collect()), key=lambda r: r[1]) == want


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from ledgerspark.llm.common import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
