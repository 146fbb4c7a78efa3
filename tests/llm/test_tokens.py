"""Token counts, token files and packing against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm.bytepieces import PieceEncoder
from tidemark.llm.packing import BestFit, op2_packing, pack_documents
from tidemark.llm.token_counts import count_tokens, op10_token_counts, piece_counts
from tidemark.llm.token_files import op9_token_files, pack, read_token_files, token_digests, unpack, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None, "en"), (2, "", "x"), (3, "it's  we'll\n\n 12a  \t", None), (None, "null id", "x"), (5, "same", "x"), (5, "same", "x"), (6, "<|endoftext|>a<|endoftext|> b", ""), (7, "word " * 40_000, ""), (8, "x" * 9_000 + " yes" * 30_000, "")]
SCHEMA = "doc_id long, text string, n_tokens string"


def library(texts):
    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_counts_of_odd_texts(spark):
    want = sorted((d or -1, len((t or "").encode()), len(i), len(i) > 512) for (d, t, _), i in zip(ODD, library([x[1] for x in ODD]), strict=True))
    for chunk, overlap in ((1 << 15, 512), (1000, 80), (700, 100)):
        got = count_tokens(odd(spark), PATH, chunk=chunk, overlap=overlap).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_empty_tables(spark):
    none = odd(spark).filter("doc_id = 99")
    assert count_tokens(none, PATH).count() == 0
    assert pack_documents(none, PATH).count() == 0


def test_counts_and_files_of_the_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    ids = library([r.text for r in docs])
    assert {(r.doc_id, r.n_tokens) for r in op10_token_counts(spark, tiny).collect()} == {(r.doc_id, len(i)) for r, i in zip(docs, ids, strict=True)}
    start, want = 0, set()
    for r, i in zip(docs, ids, strict=True):
        i = [*i, 2]
        want.add((r.doc_id, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert {tuple(r) for r in op9_token_files(spark, tiny).collect()} == want


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (unpack(*pack(x), n) == x).all()


def test_files_of_odd_texts(spark, tmp_path):
    write_token_files(odd(spark), PATH, f"file://{tmp_path}/a")
    got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(spark, f"file://{tmp_path}/a").collect())
    assert got == sorted((d or -1, [*i, 2]) for (d, _, _), i in zip(ODD, library([x[1] for x in ODD]), strict=True))
    starts = sorted((r.start, r.n_tokens) for r in token_digests(spark, f"file://{tmp_path}/a").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def check_packing(rows, docs):
    ids = {}
    for d, i in docs:
        ids.setdefault(d, []).append([*i, 2])
    sequences, own = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert parts[-1][0] + parts[-1][1] <= 1024
    want = {}
    for d, lists in ids.items():
        for x in lists:
            first = len(x) % 1024 or min(len(x), 1024)
            cuts = [0, *range(first, len(x) + 1, 1024)]
            want.setdefault(d, []).extend((k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert {d: sorted(x) for d, x in own.items()} == {d: sorted(x) for d, x in want.items()}
    return len(sequences), sum(len(x) for lists in ids.values() for x in lists)


def test_packing(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    n, tokens = check_packing(op2_packing(spark, tiny).collect(), list(zip([r.doc_id for r in docs], library([r.text for r in docs]), strict=True)))
    assert n <= 1.05 * tokens / 1024 + 2
    check_packing(pack_documents(odd(spark), PATH).collect(), list(zip([x[0] for x in ODD], library([x[1] for x in ODD]), strict=True)))


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = BestFit(10, 2)
    assert [p.place(6), p.place(7)] == [(0, 0), (1, 0)]
    assert p.place(3) == (1, 7)  # fills bin 1
    assert [p.place(8), p.place(9)] == [(2, 0), (3, 0)]  # bin 2 was the fullest of two open ones
    assert p.place(1) == (3, 9) and p.place(4) == (0, 6) and not p.unfinished()


def test_a_fresh_encoder_counts_pieces():
    text = " ".join(f"word{k} it's" for k in range(3000))
    start, before, total = piece_counts(PieceEncoder(PATH), text)
    assert total == len(library([text])[0]) and before[-1] < total and start[0] == 0


def test_long_texts_in_parts(monkeypatch):
    from tidemark.llm import bytepieces

    rng = np.random.default_rng(4)
    marks = ["'s", "'ll", " ", "  ", "\n\n", "\t", " ", "　", "\u0085", "a", "B", "é", "ß", "7", "42", "!", "'", "''", "…", "<|endoftext|>", "x1y2", "don't", "re'", "日本"]
    texts = ["".join(rng.choice(marks, 4000)) for _ in range(6)] + ["a" * 3000 + "1" * 3000, "é" * 5000, "'" * 5000, "y'7" * 3000, " " * 5000 + "x"]
    monkeypatch.setattr(bytepieces, "STEP", 64)
    monkeypatch.setattr(bytepieces, "RUN", 50)
    monkeypatch.setattr(bytepieces, "MEMORY", 100)
    enc, want = PieceEncoder(PATH), library(texts)
    for t, ids in zip(texts, want, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert enc._long(raw).tolist() == ids
        plain = np.frombuffer(t.replace("<|endoftext|>", "").encode(), np.uint8)
        cuts = [0, *bytepieces.part_ends(plain, 64)]
        assert cuts[-1] == len(plain) and all(a < b for a, b in zip(cuts, cuts[1:], strict=False))
    got = [ids[places[k] : places[k + 1]].tolist() for first, end, ids, places in enc.steps(pa.array(texts)) for k in range(end - first)]
    assert got == want


def test_a_text_of_two_million_words_ends():
    text = " ".join(f"w{k:x}q" for k in range(2_200_000))
    got = next(PieceEncoder(PATH).steps(pa.array([text], pa.large_string())))
    tokenizer, at, size = Tokenizer.from_file(PATH), 0, 0
    words = text.split(" ")
    for k in range(0, len(words), 500_000):  # the library gets it in parts, cut before blanks
        part = ("" if k == 0 else " ") + " ".join(words[k : k + 500_000])
        ids = np.array(tokenizer.encode(part, add_special_tokens=False).ids, np.uint32)
        assert (got[2][at : at + len(ids)] == ids).all()
        at += len(ids)
    assert at == len(got[2])


def test_files_of_other_ids(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", None), (None, "x")], "doc_id string, text string")
    write_token_files(docs, PATH, f"file://{tmp_path}/b")
    assert [(r.doc_id, r.start) for r in token_digests(spark, f"file://{tmp_path}/b").orderBy("start").collect()] == [(None, 0), ("a", 2), ("b", 3)]
