import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerspark.llm import bpe
from ledgerspark.llm.lexicon import LONGEST, Lexicon, compile_lexicon

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({"".join(random.Random(i).choice("abc") for _ in range(1 + i % 6)).encode() for i in range(800)})
    out = [[len(w), *w[:2]] for w in words]
    compile_lexicon(words, out, tmp_path / "x")
    lex = Lexicon(tmp_path / "x")
    assert [lex.output(k).tolist() for k in lex.find(words)] == out
    assert (lex.find([b"", b"d", b"abcabcabc", b"x" * (LONGEST + 1)]) == -1).all()
    # No two states accept the same endings: each has its own mark of arcs and end.
    marks = {}
    for key, to in zip(lex.keys.tolist(), lex.to.tolist(), strict=True):
        marks.setdefault(key >> 8, []).append((key & 255, to))
    signs = [(int(lex.final[s]), tuple(marks.get(s, []))) for s in range(len(lex.final))]
    assert len(set(signs)) == len(signs)


@pytest.mark.parametrize("known", [[], ["the", "of", "a", "ing", "é"]])
def test_encoder_equals_library(tmp_path, known):
    rng = random.Random(1)
    texts = ["", " ", "a<|endoftext|>b <|startoftext|>", "Ωmega ΣΑΣ İstanbul ß", "don't I'LL we've x's 'tis", "a\x1cb\x85c\xa0d", "é é", "１２ ①② ½", "日本語 テキスト", "x" * 3000, "<|endoftext"]
    texts += [f"{chr(i)}a{chr(i)} {chr(i) * 2}" for i in range(1, 0x260)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(32, 127), rng.randrange(1, 0xD7FF)])) for _ in range(50)) for _ in range(300)]
    vocab = bpe.WordBpe(PATH)
    words = [w.encode() for w in known]
    compile_lexicon(words, [vocab.merge(w) for w in words], tmp_path / "x")
    got = bpe.Encoder(vocab, Lexicon(tmp_path / "x")).encode(texts)
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
    assert [bpe.decode_ids(g, vocab).decode() for g in got] == [LIBRARY.decode(w.ids, skip_special_tokens=False) for w in want]


def expect(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_equals_library(docs, odd, none):
    for df in (docs, odd, none):
        want = sorted((r.doc_id is None, r.doc_id or 0, *expect(r.text)) for r in df.select("doc_id", "text").collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH, most=500).collect())
        assert got == want


def test_encode_then_decode(docs):
    coded = bpe.decode(bpe.encode(docs.limit(20), PATH, most=50), PATH)
    for r in coded.join(docs, "doc_id").collect():
        ids = LIBRARY.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
