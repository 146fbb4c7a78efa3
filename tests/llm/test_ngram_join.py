"""The shingle join against all pairs, and its pieces."""

import random
import re

import numpy as np

from tidemark.llm.components import components
from tidemark.llm.ngram_join import bands, entries, join_near_duplicates, op1_ngram_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    """{doc_id: (sizes of its sets, component)} by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, j in {(i, j) for w in where.values() for i in w for j in w if i < j}:
        (d, s), (e, t) = sets[i], sets[j]
        if 100 * len(s & t) >= 80 * len(s | t):
            a, b = sorted((root(d), root(e)))
            parent[b] = a
    return sorted((d, len(s), root(d)) for d, s in sets)


def result(frame):
    return sorted(map(tuple, frame.collect()))


def test_join_matches_all_pairs_of_the_table(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = result(op1_ngram_join(spark, tiny))
    assert got == brute(docs)
    assert len({c for _, _, c in got}) < len(docs)


def family(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(words))
            if rng.random() < 0.5:
                words[k] = f"new{rng.randrange(10**6)}"
            elif rng.random() < 0.5:
                del words[k]
            else:
                words.insert(k, f"add{rng.randrange(10**6)}")
        yield " ".join(words)


def test_join_matches_all_pairs_of_edited_families(spark):
    rng = random.Random(7)
    texts = []
    passage = " ".join(f"shared{k}" for k in range(30))
    for size in (3, 5, 6, 8, 9, 10, 12, 14, 20, 33, 60, 120, 250):
        for f in range(4):
            base = [f"w{rng.randrange(4 if f == 3 else 5000)}" for _ in range(size)]
            texts += family(rng, base, 9, max(1, size // 25) + f)
    texts += [f"{passage} " + " ".join(f"own{k}x{j}" for j in range(25)) for k in range(120)]
    texts += family(rng, [f"hot{k}" for k in range(90)], 60, 3)
    rng.shuffle(texts)
    docs = list(enumerate(texts, 1))
    assert result(join_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_join_of_odd_rows(spark):
    ten = "a b c d e f g h i j"
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (None, ten), (10, ten), (4, f"{ten} k"), (11, "z " * 200_000), (12, "Z\n" * 90_000), (13, "x"), (13, ten)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS cls", "2 AS n", "3 AS a", "4 AS label")
    got = sorted(map(tuple, join_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (None, 6, None), (10, 6, 4), (4, 7, 4), (11, 1, 11), (12, 1, 11), (13, 1, 4), (13, 6, 4)], key=str)
    assert join_near_duplicates(docs.filter("false")).count() == 0


def test_linked_sets_always_share_an_entry():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, len(s) // 9 + 1))
        add = rng.integers(0, 1 << 63, int(rng.integers(0, max(1, len(s) // 10))), dtype=np.uint64)
        t = np.unique(np.concatenate([rng.permutation(s)[drop:], add]))
        both = len(np.intersect1d(s, t))
        if 100 * both < 80 * (len(s) + len(t) - both):
            continue
        a, b = [[set(entries([x], role)[0].tolist()) for role in (0, 1)] for x in (s, t)]
        assert a[0] & b[0] or a[0] & b[1] or a[1] & b[0]


def test_bands_can_pay_for_every_difference():
    for b in bands()[:60]:
        assert b.plain + 2 * b.loose == b.differ + 1 + b.slack
        assert b.differ >= (2 * b.hi) // 9


def test_components_by_rounds_and_in_one_task(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5040)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    want = sorted((x, root(x)) for x in parent)
    links = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == want
    assert sorted(map(tuple, components(links, small=0).collect())) == want
    assert components(links.filter("false")).count() == 0
