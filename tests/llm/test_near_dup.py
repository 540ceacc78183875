import random

import numpy as np
from pyspark.sql import functions as F

from ledgerspark.llm import near_dup as N
from ledgerspark.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (n, component, kept), all pairs that share a shingle compared."""
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}


def test_documents_equal_brute_force(docs):
    assert near(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_near_copies_equal_brute_force(spark):
    """Chains and large groups around the threshold, and a passage that all share."""
    rng, rows = random.Random(2), []
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(60)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(words[: rng.randint(48, 60)])
    rows += [passage + [rng.choice(vocab) for _ in range(rng.randint(5, 60))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd, none):
    got = N.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = brute([(r.doc_id, r.text) for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert N.near_duplicates(none).count() == 0


def test_very_short_texts_equal_brute_force(spark):
    """Bands may miss pairs of a few shingles; their own keys don't."""
    rng, rows = random.Random(5), []
    for i in range(300):
        w = [f"w{i}-{k}" for k in range(rng.randint(7, 12))]
        rows += [w, w[: rng.randint(max(5, len(w) - 2), len(w))], w[rng.randint(0, 2) :], [*w, f"x{i}"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_tiny_keys_meet_whatever_is_similar():
    rng = np.random.default_rng(7)
    for n in range(1, 10):
        for m in range(n, 10):
            for both in range(n + 1):
                x = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
                (own, _), (_, fewer) = N.tiny_keys(np.sort(x[:n])), N.tiny_keys(np.sort(np.concatenate([x[:both], x[n:]])))
                similar = 100 * both >= 75 * (n + m - both) and m > n
                assert (own in fewer if own is not None else False) == (similar and n <= 6 and both == n), (n, m, both)
                assert n > 6 or not similar or both == n


def test_one_id_with_several_texts(spark):
    """One text, the same on every run, counts for all rows of an id."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, b), (3, a), (3, b + " c"), (3, None), (4, "x y z"), (4, "x y z"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, N.near_duplicates(df).collect()))
    assert got == sorted(map(str, N.near_duplicates(df.orderBy(F.desc("text")).repartition(5)).collect())) and len(got) == len(rows)
    of = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect() if r.doc_id is not None}
    assert of[3] in ((36, 1, False), (37, 2, False), (0, 3, True)) and of[1] == (36, 1, True) and of[4] == (1, 4, True)


def test_a_hot_bucket_of_texts_from_one_template(spark):
    """Many texts that share most words but aren't similar enough, and a few that are."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"t{i}-{k}" for k in range(rng.randint(8, 10))])) for i in range(700)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 700, 7)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_sketches_estimate():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n in (3, 40, 2000):
        for share in (0.5, 0.75, 0.95):
            k = int(2 * n * share / (1 + share))
            a, b = np.unique(base[:n]), np.unique(np.concatenate([base[:k], base[n : 2 * n - k]]))
            both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = N.sketches([a, b])
            assert N.estimate(s[0], s[1], np.array(n), np.array(n)) >= both - 5.5 * (both * (1 - both) / min(n, N.REGISTERS)) ** 0.5 - 0.01


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    top = {x: x for ab in links for x in ab}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in top if x not in loops}
