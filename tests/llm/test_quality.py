import math
import random
import re

from pyspark.sql import functions as F

from ledgerspark.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words, seen, covered = WORD.findall(text), {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_rules_equal_brute_force(spark, docs, odd, none):
    x = "a b c d e f g h i j"
    more = spark.createDataFrame([(-3, " ".join([x] * 3) + " k l m", "xx"), (-5, x + " z " + x + "\n\n" + x + "\n" + x, None), (-6, " ".join(f"w{i % 900}" for i in range(2000)), "en")], "doc_id long, text string, lang string")
    for df in (docs.select("doc_id", "text", "lang").unionByName(more), odd, none):
        key = lambda r: tuple((v is None, v) for v in r)
        want = sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=key)
        rows = Q.judge(df).collect()
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=key) == want
        assert all(not r.kept for r in rows if r.base_failed)


def test_distance(spark):
    a, b = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(Q.distance(F.col("a"), F.col("b")), Q.distance(F.col("a"), F.col("a"))).first()
    p, q = [x / 4 for x in a], [x / 4 for x in b]
    want = math.sqrt(sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q, strict=True)) / 2)
    assert abs(got[0] - want) < 1e-12 and got[1] == 0


def test_prose_stays_and_symbols_go(docs):
    rows = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert sum(r.kept for r in rows.values()) > 0.8 * sum(not r.base_failed for r in rows.values())
    assert not any(r.kept for r in rows.values() if r.word_chars >= 200 and r.n_symbols > 0.3 * r.word_chars)


def prose(rng, vocabulary, n):
    return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))


def invented(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(n)]


def test_word_distance_alone_rejects_other_languages_and_gibberish(spark):
    rng = random.Random(6)
    words = {lang: invented(rng, 2000) for lang in ("aa", "bb")}
    rows = [(i, prose(rng, words[lang], rng.randint(70, 400)), lang) for i, lang in enumerate(["aa"] * 400 + ["bb"] * 200)]
    rows += [(1000 + i, prose(rng, words["bb"], 150), "aa") for i in range(10)] + [(2000 + i, " ".join(invented(rng, 150)), "aa") for i in range(10)]
    rows += [(3000 + i, rows[0][1], "aa") for i in range(600)]  # copies must not narrow the limit to themselves
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(not r.base_failed and r.char_distance <= 0.25 for r in got.values())
    assert not any(got[i].kept for i in (*range(1000, 1010), *range(2000, 2010)))
    assert sum(got[i].kept for i in range(600)) >= 0.98 * 600


def test_every_language_has_a_reference(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(invented(rng, 60)), f"x-{i % 260}") for i in range(780)] + [(-1, " ".join(invented(rng, 60)), None)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 781 and all(r.char_distance is not None and r.word_distance is not None for r in got)
    assert any(r.word_distance > 0 for r in got)


def brute_kept(rows, rules):
    """doc_id -> (char distance, word distance, kept), by plain Python."""
    from collections import Counter, defaultdict

    def js(a, b):
        na, nb = sum(a), sum(b)
        d = 0.0
        for x, y in zip(a, b, strict=True):
            p, q = x / na, y / nb
            d += sum(u * math.log2(2 * u / (u + v)) for u, v in ((p, q), (q, p)) if u) / 2
        return math.sqrt(max(d, 0.0))

    def classes(t):
        kinds = [lambda c: c.islower() and c.isalpha() and re.match(r"[a-zà-öø-ÿß]", c), lambda c: re.match(r"[A-ZÀ-ÖØ-Þ]", c), str.isdigit, lambda c: c in " \t\n\r\x0b\x0c", lambda c: c in ".,;:!?'\"()-"]
        out = [0] * 6
        for c in t:
            out[next((k for k, f in enumerate(kinds) if f(c)), 5)] += 1
        return out

    facts = {i: (*base(t), WORD.findall(t)) for i, t, _ in rows}
    named = [(i, t, lang) for i, t, lang in rows if lang is not None] or rows
    words = defaultdict(Counter)
    for i, _, lang in named:
        words[lang].update(facts[i][6])
    refs = {}
    for lang, c in words.items():
        common = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: rules.common_words]]
        refs[lang] = (common, [c[w] for w in common] + [sum(c.values()) - sum(c[w] for w in common)])

    def word_distance(i, lang):
        c = Counter(facts[i][6])
        own = [c[w] for w in refs[lang][0]]
        return js([*own, facts[i][0] - sum(own)], refs[lang][1])

    judged = {i: lang if lang in refs else min(refs, key=lambda x, i=i: (word_distance(i, x), x)) for i, _, lang in rows if facts[i][0]}
    shares = defaultdict(list)
    for i, t, lang in named:
        if t:
            k = classes(t)
            shares[lang].append([x / sum(k) for x in k])
    means = {lang: [sum(col) / len(x) for col in zip(*x, strict=True)] for lang, x in shares.items()}
    dist = {i: (js(classes(t), means[judged[i]]), word_distance(i, judged[i])) for i, t, _ in rows if facts[i][0]}
    band = lambda i: math.floor(2 * math.log2(facts[i][0]))
    cells = {(lang, band(i), facts[i][0], dist[i][1]) for i, _, lang in named if facts[i][0] >= rules.guard_words}

    def limit(ds):
        ds = sorted(math.floor(d * 1000) for d in ds)
        at = lambda share: next(c for k, c in enumerate(ds, 1) if k >= share * len(ds)) / 1000
        return at(0.5) + rules.word_spread * (at(0.5) - at(0.25)) if len(ds) >= rules.least_texts else None

    out = {}
    for i, _, _ in rows:
        n, chars, *_, failed, _ = facts[i]
        if failed:
            out[i] = False
            continue
        own = limit([d for lang, b, _, d in cells if lang == judged[i] and b == band(i)])
        every = limit([d for _, b, _, d in cells if b == band(i)])
        least = math.sqrt(rules.common_words / (8 * math.log(2) * n)) + 2 / math.sqrt(16 * math.log(2) * n)
        most = max(next(x for x in (own, every, rules.most_word_distance) if x is not None), least)
        out[i] = not (chars >= rules.guard_chars and dist[i][0] > rules.most_char_distance) and not (n >= rules.guard_words and dist[i][1] > most)
    return out


def test_verdicts_equal_brute_force_and_gibberish_without_a_language_goes(spark):
    rng = random.Random(12)
    words = {lang: invented(rng, 1500) for lang in ("aa", "bb", "cc")}
    rows = [(i, prose(rng, words[lang], rng.randint(60, 300)), lang if rng.random() < 0.7 else None) for i, lang in enumerate(["aa"] * 150 + ["bb"] * 150 + ["cc"] * 20)]
    rows += [(1000 + i, " ".join(invented(rng, rng.randint(100, 200))), None) for i in range(30)] + [(2000 + i, prose(rng, words["bb"], 150), "aa") for i in range(10)]
    rows += [(3000 + i, prose(rng, words["aa"], 120).upper(), "aa") for i in range(5)] + [(4000, "", None), (4001, "a b c", "zz")]
    rows = [(i, t, lang) for i, t, lang in rows]
    rules = Q.Rules()
    for part in (rows, [(i, t, None) for i, t, _ in rows[:200]]):
        got = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(part, "doc_id long, text string, lang string")).collect()}
        assert got == brute_kept(part, rules)
        if part is rows:
            assert sum(got[i] for i in range(1000, 1030)) <= 3
            prose_ids = [i for i, _, lang in rows if i < 300 and lang is None]
            assert sum(got[i] for i in prose_ids) >= 0.95 * len(prose_ids)
