"""Language identification by held-out accuracy, personal data against plain patterns, line removal by brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import pii
from tidemark.llm.language_id import fit, op3_language_id, predict
from tidemark.llm.line_dedup import MIN_WORDS, op6_line_dedup, remove_spans, repeated_units


def test_languages_of_the_table(spark, tiny):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = op3_language_id(spark, tiny).collect()
    assert {r.doc_id for r in got} == set(lang) and len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_languages_of_odd_rows(spark):
    rows = [(1, "the cat and the dog of the house", "en"), (2, "der hund und die katze im haus", "de"), (3, None, "en"), (4, "123 ...", "en"), (5, "", None), (None, "die katze und der hund", "de"), (6, "und die " * 50_000, None), (7, "the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS bucket")
    got = {r.doc_id: (r.lang_pred, round(r.score, 3)) for r in predict(docs, fit(docs), "doc_id").collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert (got[None][0], got[6][0], got[7][0]) == ("de", "de", "en")
    empty = fit(docs.filter("false"))
    assert {r.lang_pred for r in predict(docs, empty, "doc_id").collect()} == {"und"}
    assert predict(docs.filter("false"), fit(docs), "doc_id").count() == 0


def naive_bayes(rows, texts, bits=15):
    """Languages and scores by plain multinomial naive Bayes over the operator's hash of n-grams."""
    import math

    def grams(text):
        chars = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or ""]
        for k in (1, 2, 3):
            for at in range(len(chars) - k + 1):
                own = chars[at : at + k]
                if any(c != " " for c in own):
                    h = 0x27D4EB2F * k & 0xFFFFFFFF
                    for c, m in zip(own, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                        h = (h ^ ord(c)) * m & 0xFFFFFFFF
                        h ^= h >> 15
                    yield h >> (32 - bits)

    count, docs = {}, {}
    for text, lang in rows:
        docs[lang] = docs.get(lang, 0) + 1
        own = count.setdefault(lang, {})
        for g in grams(text):
            own[g] = own.get(g, 0) + 1
    total = {x: sum(own.values()) + 0.5 * (1 << bits) for x, own in count.items()}
    for text in texts:
        found = list(grams(text))
        if not found:
            yield "und", 0.0
            continue
        odds = {x: math.log(docs[x] / sum(docs.values())) + sum(math.log((count[x].get(g, 0) + 0.5) / total[x]) for g in found) for x in count}
        best = max(sorted(odds), key=odds.get)
        yield best, 1 / sum(math.exp(v - odds[best]) for v in odds.values())


def test_languages_match_plain_naive_bayes(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect()  # a fixture of 60 texts
    learned, judged = [(r.text, r.lang) for r in docs[:40] if r.lang and r.text is not None], [*docs[40:]]
    frame = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(learned)], "doc_id long, text string, lang string")
    texts = [r.text for r in judged] + ["a", "É 1", "...", "der the le el"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fit(frame), "doc_id").collect()}
    for k, (lang, score) in enumerate(naive_bayes(learned, texts)):
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-9


def test_every_language_is_learned(spark):
    rows = [(k, chr(0x4E00 + 40 * (k % 300)) * 8, f"l{k % 300:03}") for k in range(900)] + [(1000 + k, "common words here", "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs, sample_rows=1000, least_rows=2, matrix=1 << 20)
    assert len(model.languages) == 301 and model.weights.size <= 1 << 20
    got = predict(docs, model, "doc_id", "lang").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_long_texts_are_summed_up_in_parts(spark):
    from tidemark.llm import language_id

    text = "der hund é 1 und die katze. " * 3000
    whole = pa.array([text, "kurz"], pa.large_string())
    size = (1 << 15) + 1
    (a,) = [np.bincount(g[:, off[0] : off[1]].ravel(), minlength=size) for _, _, g, off, _ in language_id.buckets(whole, 1 << 22)]
    parts = [(np.bincount(g[:, off[0] : off[1]].ravel(), minlength=size), letters[0]) for first, _, g, off, letters in language_id.buckets(whole, 1000) if first == 0]
    assert len(parts) > 50 and (sum(p for p, _ in parts)[:-1] == a[:-1]).all() and sum(x for _, x in parts) == sum(c.isalpha() for c in text)


def plain(text):
    t, out = text or "", []
    out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    number = lambda m: re.sub("[^0-9]", "", m[0])
    check = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(number(m)) <= 19 and check(number(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(number(m)) <= 15]
    order = ["email", "ip", "card", "phone"]
    return [(k, m.start(), m.end()) for k, m in sorted(out, key=lambda x: (x[1].start(), order.index(x[0])))]


def test_personal_data_matches_plain_patterns(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = pii.op4_personal_data(spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{e}" for k, a, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.KINDS)


def test_personal_data_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "é a@b.co 1.2.3.4.5 999.1.1.1 " + "9" * 4000 + ".1.1.1 a@b@c.de x.y@@z.w.v %@a.b.@c.d-e.f" + "q" * 50_000), (3, "call me (212) 555-0101 or phone 212-555-0102 now"), (3, "write to jane (at) example (dot) org"), (4, "x " * 60_000 + "+1 (499) 555-6503")]
    rows += [(10 + k, f"tel +1 (499) 555-{6000 + k} and phone (49{k % 10}) 555-{7000 + k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS kind", "3 AS candidates")
    got = pii.find_personal_data(docs, "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id not in (3,):
            text = dict(rows)[r.doc_id]
            assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.base] == plain(text)
    assert any(not s.base and s.kind == 3 for r in got if (r.doc_id or 0) >= 10 for s in r.spans)
    assert pii.find_personal_data(docs.filter("false"), "doc_id").count() == 0
    assert pii.redact("é a@b.co x", [(2, 0, 8)]) == "é <EMAIL> x"
    assert pii.redact("+1 499 5556503 1111", [(0, 3, 14), (1, 2, 19)]) == "<PHONE>"


def test_long_candidates(spark):
    rows = [(k, f"write to {'x' * 200}{k} (at) example (dot) org or phone 0049 30 1 2 3 4 5 6 7 8 or 00{'1' * 400}") for k in range(40)] + [(100, "x" * 200_000), (101, "00" + "1 " * 50_000)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    for k in range(40):
        assert [rows[k][1][s.start : s.end] for s in got[k] if s.kind == 0] == [f"{'x' * 200}{k} (at) example (dot) org"]
    assert not got[100]


def test_label_model_prefers_agreeing_labelers():
    good, bad = pii.code((1, 1, 1, 1, 1)), pii.code((-1, -1, 0, -1, -1))
    p = pii.label_model({(0, good): 90, (0, bad): 60, (0, pii.code((1, 1, 0, 0, 1))): 40})
    assert p[0, good] > 0.9 and p[0, bad] < 0.1 and p[0, pii.code((1, 1, 0, 0, 1))] > 0.5


def units(text):
    out = []
    for m in re.finditer(r"[^\n]+", text or ""):
        at = 0
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", m[0]))
        group = []
        for w in words:
            group.append(w)
            if w[0][-1] in ".!?" or w is words[-1]:
                at = group[0].start()
                out.append((m.start() + at, m.start() + w.end(), tuple(re.sub("[A-Z]", lambda c: c[0].lower(), x[0]) for x in group)))
                group = []
    return out


def brute(docs):
    seen, out = {}, set()
    for d, t in docs:
        for a, e, key in units(t):
            if len(key) >= MIN_WORDS:
                if key in seen:
                    out.add((d, a, e, len(key), *seen[key]))
                else:
                    seen[key] = (d, a)
    return out


def all_units(text):
    """{(start, end, words)} of whole lines, and of the shortest runs of sentences from and up to each, of MIN_WORDS words."""
    parts, lines = [], []
    for m in re.finditer(r"[^\n]+", text or ""):
        own = [(a + m.start(), e + m.start(), key) for a, e, key in units(m[0])]
        if own:
            lines.append((len(parts), len(parts) + len(own)))
            parts += own
    runs = set(lines)
    for k in range(len(parts)):
        for step in (1, -1):
            n, at = 0, k
            while 0 <= at < len(parts) and n < MIN_WORDS:
                n += len(parts[at][2])
                at += step
            if n >= MIN_WORDS:
                runs.add((k, at) if step == 1 else (at + 1, k + 1))
    out = {(parts[a][0], parts[b - 1][1], sum((p[2] for p in parts[a:b]), ())) for a, b in runs}
    return {x for x in out if len(x[2]) >= MIN_WORDS}


def brute_units(docs):
    """All rows of the operator: of equal units the first stays, and what overlaps it in its own text."""
    found = sorted((d, a, e, key) for d, t in docs for a, e, key in all_units(t))
    first, out = {}, set()
    for d, a, e, key in found:
        k = first.setdefault(key, (d, a, e))
        if d != k[0] or a >= k[2]:
            out.add((d, a, e, len(key), k[0], k[1]))
    return out


def test_lines_match_brute_force(spark, tiny):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect())
    got = [tuple(r) for r in op6_line_dedup(spark, tiny).collect()]
    assert set(got) == brute_units(docs) and len(got) == len(set(got)) > 0


def test_lines_of_odd_rows(spark):
    line = "One two THREE four five six é."
    rows = [(1, None), (2, ""), (3, f"{line} {line}\n\n{line}"), (4, f"x\n one  two three\tfour five six é. y"), (4, line), (5, "a b c. a b c."), (6, "w " * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h1", "2 AS row", "3 AS kept").coalesce(1)
    got = sorted((r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in repeated_units(docs).collect())
    n = len(line)
    assert got == [(3, n + 1, 2 * n + 1, 3, 0), (3, 2 * n + 3, 3 * n + 3, 3, 0), (4, 0, n, 3, 0), (4, 3, 4 + n, 3, 0)]
    assert repeated_units(docs.filter("false")).count() == 0
    assert remove_spans("abcdef", [(1, 3), (2, 4)]) == ("aef", [(0, 1), (4, 6)])


def spans_by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.start, r.end))
    return out


def test_repeated_lines_of_short_sentences_go(spark):
    short = [" ".join(f"s{k}w{j}" for j in range(5)) + "." for k in range(12)]
    line, passage = " ".join(short), " ".join(short[3:7])
    rows = [(1, line), (2, f"own words\n{line.upper()}\nmore"), (3, f"Not seen before. {passage} Nor is this."), (4, "\n".join(short)), (5, "Yes. No. Why not so? Ha. " * 2), (6, "ha ha. " * 4)]
    got = repeated_units(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert (2, 10, 10 + len(line), 60, 1, 0) in [(r.doc_id, r.start, r.end, r.n_words, r.kept_doc_id, r.kept_start) for r in got]
    left = {d: remove_spans(t, spans_by_doc(got).get(d, []))[0].split() for d, t in rows}
    assert left == {1: line.split(), 2: "own words more".split(), 3: "Not seen before. Nor is this.".split(), 4: [], 5: "Yes. No. Why not so? Ha.".split(), 6: ("ha ha. " * 4).split()}


def test_every_repeated_line_goes_whole(spark, tiny):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect())
    got = op6_line_dedup(spark, tiny).collect()
    assert brute(docs) <= {tuple(r) for r in got} and len(got) == len({tuple(r) for r in got})
    spans, seen, repeats = spans_by_doc(got), set(), 0
    for d, t in docs:
        covered = {i for a, b in spans.get(d, []) for i in range(a, b)}
        for m in re.finditer(r"[^\n]+", t or ""):
            key = tuple(w for _, _, unit in units(m[0]) for w in unit)
            if len(key) >= MIN_WORDS and key in seen:
                repeats += 1
                assert all(i in covered for i in range(m.start(), m.end()) if not t[i].isspace())
            seen.add(key)
    assert repeats
