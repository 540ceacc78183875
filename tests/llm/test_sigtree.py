"""The Jaccard join against all pairs that share a shingle."""

import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerspark.llm import sigtree as S
from tests.llm.test_near_dup import shingles


def brute(rows, similar=80):
    """doc_id -> (size of its set, smallest id that links reach)."""
    sets = {i: shingles(t) for i, t in rows}
    top, with_token = {i: i for i in sets}, defaultdict(list)

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in sorted(sets):
        both = defaultdict(int)
        for s in sets[i]:
            for j in with_token[s]:
                both[j] += 1
            with_token[s].append(i)
        for j, n in both.items():
            if 100 * n >= similar * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in S.jaccard_join(df).collect()}


def test_documents_equal_brute_force(spark, docs, sf):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in S.op13_signature_trees(spark, sf).collect()} == want
    assert sum(i != c for i, (_, c) in want.items()) > 3


@pytest.mark.parametrize("block", [1024, 4])
def test_groups_around_the_limit(spark, monkeypatch, block):
    """Chains of edits, large groups of near copies in one block and in many, and a passage that most documents share."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng, rows = random.Random(8), []
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    for g in range(8):
        base = [rng.choice(vocab) for _ in range(rng.choice((9, 30, 90, 200)))]
        for k in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(words[: len(words) - rng.randint(0, len(words) // 8)])
            if k % 5 == 0:
                base = words
    rows += [passage + [rng.choice(vocab) for _ in range(rng.randint(5, 90))] for _ in range(80)] + [passage] * 30 + [passage[k:] for k in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_few_shingles(spark):
    rng, rows = random.Random(9), []
    for i in range(150):
        w = [f"w{i}-{k}" for k in range(rng.randint(1, 14))]
        rows += [w, w[: rng.randint(max(1, len(w) - 2), len(w))], w[rng.randint(0, 2) :], [*w, f"x{i}"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd, none):
    got = S.jaccard_join(odd).collect()
    assert len(got) == odd.count()
    want = brute([(r.doc_id, r.text) for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert sorted(r.n_shingles for r in got if r.doc_id is None)[0] == 0 and all(r.component_id is None for r in got if r.doc_id is None)
    assert S.jaccard_join(none).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    for rows in ([(1, a), (1, b), (2, a), (3, b)], [(3, b), (2, a), (1, b), (1, a)]):
        got = sorted(tuple(r) for r in S.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
        assert len(got) == 4 and got[0] == got[1] == (1, 1) and sorted(c for _, c in got[2:]) in ([1, 2], [1, 3])


def test_no_pair_of_nodes_with_a_link_is_pruned():
    """Trees find all links of random sets, of any size and with saturated signatures."""
    rng = np.random.default_rng(10)
    for bits in (8, 1):
        S.BITS, kept = bits, S.BITS
        try:
            sets = []
            for _ in range(40):
                base = rng.integers(0, 1 << 63, rng.integers(4, 600)).astype(np.uint64)
                sets += [np.unique(np.where(rng.random(len(base)) < rng.uniform(0, 0.12), rng.integers(0, 1 << 63, len(base)).astype(np.uint64), base)) for _ in range(6)]
            at, own = np.arange(len(sets)), np.arange(len(sets))
            facts = [S.signature(x) for x in sets], np.array([len(x) for x in sets]), np.array([x[0].view(np.int64) for x in sets]), own
            top = list(range(len(sets)))
            maybe = {frozenset(p) for p in S.tree_links(*facts, at, at)} | {frozenset(p) for p in S.tree_links(*facts, at[:100], at[100:])}
            assert maybe >= {frozenset((a, b)) for a in at.tolist() for b in range(a) if S._similar(sets[a], [sets[b]])[0]} and len(maybe) < len(sets) ** 2 / 4
            for a, b in S.tree_links(*facts, at, at, sets) + S.tree_links(*facts, at[:100], at[100:], sets):
                assert S._similar(sets[a], [sets[b]])[0]
                top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
            for a in at:
                for b in at[:a]:
                    assert top[a] == top[b] or not S._similar(sets[a], [sets[b]])[0]
        finally:
            S.BITS = kept
