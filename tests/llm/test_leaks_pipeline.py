"""Benchmark leaks against all windows, and the pipeline against plain steps."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm.decontamination import RADIUS, Index, find_leaks, op8_decontamination, without_leaks
from tidemark.llm.pii import base_spans
from tidemark.llm.quality_rules import op7_quality_rules

import corpus_pipeline

from .test_ngram_join import brute as groups


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs, items):
    """{(doc_id, item_id): best similarity} over all windows."""
    out = {}
    for d, t in docs:
        w = words(t)
        all_of = bag(w)
        for i, x in items:
            v = words(x)
            own = bag(v)
            if not own or not any(s in all_of for s in own):
                continue
            for a in range(max(len(w) - len(v), 0) + 1):
                win = bag(w[a : a + len(v)])
                both = sum((win & own).values())
                s = both / (sum(win.values()) + sum(own.values()) - both)
                if s >= 0.8:
                    out[d, i] = max(s, out.get((d, i), 0))
    return out


def test_leaks_match_all_windows(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    got = op8_decontamination(spark, tiny).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == brute(docs, items)
    assert got and len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_leaks_of_edited_and_odd_texts(spark):
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"b{k}w{rng.integers(40)}" for _ in range(n))) for k, n in enumerate((3, 5, 9, 20, 40, 70))] + [(90, None), (91, " "), (None, "an item without an id stands here too")]
    docs = [(1, None), (2, ""), (None, "x " + items[4][1]), (3, items[5][1] + " tail"), (3, "other")]
    for k in range(60):
        w = words(items[k % 6][1])
        for _ in range(k // 20):
            w[rng.integers(len(w))] = "edited"
        docs.append((10 + k, " ".join([*(f"p{j}" for j in range(k)), *(x.upper() for x in w), *(f"q{j}" for j in range(3 * k))])))
    docs += [(99, " ".join(words(items[3][1]) * 2000)), (98, "An item without an ID stands here too, though")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS similarity", "3 AS item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS doc_id")
    want = brute([x for x in docs if x[0] != 99], items)
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(d, b).collect()}
    assert got.pop((99, 3)) == 1.0
    assert got == want
    dirty = {k for k, _ in want} | {99}
    kept = without_leaks(d, b).collect()
    assert Counter(r.doc_id for r in kept if r.doc_id != 3) == Counter(x for x, _ in docs if x not in dirty and x != 3)
    assert [r.text for r in kept if r.doc_id == 3] == ["other"] and kept[0].similarity == 2
    assert find_leaks(d.filter("false"), b).count() == find_leaks(d, b.filter("false")).count() == 0


def test_the_multi_index_finds_all_within_its_radius():
    rng = np.random.default_rng(2)
    index = Index([(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(50)])
    for _ in range(200):
        k = int(rng.integers(50))
        bits = np.unpackbits(index.prints[k])
        bits[rng.choice(128, int(rng.integers(0, RADIUS + 1)), replace=False)] ^= 1
        own = np.packbits(bits)[None]
        far = np.bitwise_count(index.prints ^ own).sum(1)
        assert set(index.candidates(own, 30)[1].tolist()) == set(np.flatnonzero(far <= RADIUS).tolist())
    assert not len(index.candidates(own, 31)[0])


def test_pipeline_stage_by_stage(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    state = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in op7_quality_rules(spark, tiny).collect() if r.kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality_rules":
            state = {d: t for d, t in state.items() if d in good}
        elif name == "near_duplicates":
            state = {d: state[d] for d, _, c in groups(state.items()) if d == c}
        elif name == "benchmark_leaks":
            dirty = {d for d, _ in brute(state.items(), items)}
            state = {d: t for d, t in state.items() if d not in dirty}
        elif name == "personal_data":
            got = {r.doc_id: r for r in out.collect()}
            assert got.keys() == state.keys() and out.columns == docs.columns
            assert all(got[d].text == t for d, t in state.items() if not base_spans(t) and "<" not in got[d].text)
            assert not any(base_spans(r.text) for r in got.values()) and all(len(r.text) == r.n_chars for r in got.values() if "<" in r.text)
            state = {d: r.text for d, r in got.items()}
        else:
            sizes = {d: len(x.ids) + 1 for d, x in zip(state, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(list(state.values()), add_special_tokens=False), strict=True)}
            got = Counter()
            for r in out.collect():
                got[r.doc_id] += r.length
            assert got == sizes
            break
        assert {r.doc_id: r.text for r in out.collect()} == state and out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, tiny).count() == out.count()


def test_anchors_of_items_that_share_a_prompt(spark):
    prompt = " ".join(f"prompt{j}" for j in range(20))
    items = [(k, f"{prompt} " + " ".join(f"q{k}w{j}" for j in range(20))) for k in range(300)]
    index = Index(items)
    shared = find_leaks(spark.createDataFrame([(1, f"x {prompt} y " * 50), (2, "a " + items[7][1] + " b")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in shared] == [(2, 7)]
    assert len(index.shingle) == len(set(index.shingle.tolist()))  # no anchor is one of the prompt's shingles
    # A window meets few items, whatever their number.
    rng = np.random.default_rng(1)
    sizes = Index([(k, " ".join(f"i{k}w{j}" for j in range(15 + k % 45))) for k in range(3000)])
    prints = rng.integers(0, 256, (200, 16), dtype=np.uint8)
    own = int(np.searchsorted(sizes.sizes, 30))
    key = (own * 16 + np.arange(16)) * 256 + prints
    met = [len({int(p) for x in row for p in sizes.places[np.searchsorted(sizes.keys, x) : np.searchsorted(sizes.keys, x, "right")]}) for row in key]
    assert np.mean(met) < 0.015 * 3000


def test_a_benchmark_in_several_indexes(spark, monkeypatch):
    from tidemark.llm import decontamination

    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    items = [(k, " ".join(f"b{k}w{j}" for j in range(12))) for k in range(30)]
    docs = spark.createDataFrame([(k, f"x {items[k][1]} y" if k % 3 else "clean") for k in range(30)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, b).collect()) == [(k, k) for k in range(30) if k % 3]
    assert sorted(r.doc_id for r in without_leaks(docs, b).collect()) == list(range(0, 30, 3))


LONG = " ".join(f"word{j}" for j in range(40))
CLASH = ["host", "lines", "n_words", "kept", "base_failed", "spans", "candidates", "th", "cls", "rep", "k0", "a", "row", "n", "c1", "_rid", "sid", "content"]


def test_stages_keep_rows_and_columns(spark, tiny):
    """Extra columns of any name, repeated rows, a doc_id on unlike texts, nulls, empty and long texts, an empty table."""
    other = " ".join(f"other{j}" for j in range(50))
    rows = [(1, LONG, "s"), (1, other, "s"), (2, f"{LONG} more", None), (3, None, "s"), (4, "", "s"), (None, LONG, "s"), (5, LONG, "s"), (5, LONG, "s"), (6, f"{other[::-1]} jane@example.com", "t"), (7, " ".join(f"z{j}" for j in range(200_000)), "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "cast(0 AS int) AS n_chars", *(f"'mine' AS `{c}`" for c in CLASH))
    want = {
        "quality_rules": {(1, LONG), (1, other), (2, f"{LONG} more"), (None, LONG), (5, LONG), (6, rows[8][1]), (7, rows[9][1])},
        "near_duplicates": {(1, LONG), (1, other), (3, None), (4, ""), (None, LONG), (6, rows[8][1]), (7, rows[9][1])},
        "benchmark_leaks": {(d, t) for d, t, _ in rows},
        "personal_data": {(d, t) if d != 6 else (6, f"{other[::-1]} <EMAIL>") for d, t, _ in rows},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert {(r.doc_id, r.text) for r in got} == want[name] and all(r[c] == "mine" for r in got for c in CLASH)
        assert len(got) == {"quality_rules": 8, "near_duplicates": 7}.get(name, len(rows))
        assert stage(spark, docs.filter("false"), tiny).count() == 0
    packed = corpus_pipeline.packing(spark, docs, tiny)
    assert packed.filter("piece = 0").count() == len(rows) and corpus_pipeline.packing(spark, docs.filter("false"), tiny).count() == 0
