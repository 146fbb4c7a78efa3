"""Language identification by multinomial naive Bayes over hashed character n-grams.

A bounded, documented sample of the labelled rows of each language is counted into (language, bucket) cells, the cells
become a matrix of log probabilities, and the matrix is broadcast. Scoring turns a batch of texts into one sparse matrix
of n-gram buckets (indices, and where each text begins) and multiplies it with the broadcast one in numpy; a long text
is summed up in parts. Every language is learned, however rare; priors are of all labelled rows. The matrix has at most
MATRIX cells, so that very many languages get fewer buckets each.

Defined results: texts that are null or have no letter are ``und`` with score 0, and so is all where nothing could be
learned; rows with a null doc_id are scored, never learned from, and not held out; repeated rows are scored each for
itself; columns besides doc_id, text and lang are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, prepare, text_steps

ORDERS = 3
#: Rows that the model is fitted on, about at most, and how many of each language it may have at least.
SAMPLE_ROWS, LEAST_ROWS = 20_000, 100
#: Cells of the matrix at most, and the logarithm of buckets at most.
MATRIX, BITS = 1 << 22, 15
#: Languages whose shares of the sample are broadcast at most (some 60 bytes each).
MOST_BROADCAST = 1 << 15
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower case (a blank for all but letters)."""
    letter = np.zeros(0x110000, bool)
    low = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            letter[c], low[c] = True, ord(y) if len(y) == 1 else c
    return letter, low


def _parts(raw: np.ndarray, off: np.ndarray, step: int):
    """Code points of texts laid end to end with their offsets; one longer text in parts that overlap by ORDERS - 1.

    Yields (code points, offsets, code points of the last text from which n-grams start).
    """
    if len(off) > 2 or len(raw) <= 2 * step:
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        yield codes, lead[off], len(codes)
        return
    at = 0
    while at < len(raw):
        stop = min(at + step, len(raw))
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop += 1
        more = stop
        for _ in range(ORDERS - 1):  # characters that n-grams from before stop reach into
            more += more < len(raw)
            while more < len(raw) and raw[more] & 0xC0 == 0x80:
                more += 1
        codes = np.frombuffer(raw[at:more].tobytes().decode().encode("utf-32-le"), np.uint32)
        yield codes, np.array([0, len(codes)]), int(((raw[at:stop] & 0xC0) != 0x80).sum())
        at = stop


def buckets(column: pa.Array, step: int, bits: int = BITS):
    """Yields (first row, end row, bucket of each n-gram of each order, offsets of texts, letters in each text).

    A row of buckets belongs to an order; an n-gram that is all blanks or leaves its text has the bucket 1 << bits. A
    text longer than step comes in several parts, to be summed up.
    """
    letter, low = _tables()
    for first, end, raw, whole in text_steps(column, step):
        for codes, off, own in _parts(raw, whole, step):
            n = len(codes)
            is_letter = letter[codes]
            letters = np.zeros(n + 1, np.int64)
            np.cumsum(is_letter, out=letters[1:])
            base = low[codes]
            rest = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # code points from here to the text's end
            out = np.full((ORDERS, n), 1 << bits, np.int32)
            for k in range(1, ORDERS + 1):
                if n < k:
                    break
                h = np.full(n - k + 1, 0x27D4EB2F * k & 0xFFFFFFFF, np.uint32)
                for j in range(k):
                    h = (h ^ base[j : n - k + 1 + j]) * np.uint32(_MULTIPLIERS[j])
                    h ^= h >> np.uint32(15)
                good = (rest[: n - k + 1] >= k) & (letters[k:] > letters[: n - k + 1])
                out[k - 1, : n - k + 1] = np.where(good, (h >> np.uint32(32 - bits)).astype(np.int32), 1 << bits)
            off[-1] = own
            yield first, end, out[:, :own], off, letters[off[1:]] - letters[off[:-1]]


@dataclass
class Model:
    languages: list[str]
    #: (buckets + 1) x languages; the last row is zero, for n-grams that don't count.
    weights: np.ndarray
    prior: np.ndarray
    bits: int


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, least_rows: int = LEAST_ROWS, matrix: int = MATRIX) -> Model:
    """Learn from rows (doc_id, text, lang): of each language a sample by hash, of sample_rows in all or least_rows each."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    number = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(number)
    if not languages:
        return Model([], np.zeros((2, 0)), np.zeros(0), 0)
    bits = max(1, min(BITS, (matrix // len(languages)).bit_length() - 1))
    each, scale = max(least_rows, sample_rows // len(languages)), 1 << 30
    # Languages with few rows leave their share to the others.
    spare = max(0, sample_rows - sum(min(each, n) for n in number.values()))
    over = sum(n - each for n in number.values() if n > each)
    take = {x: min(n, each + (spare * (n - each) // over if over and n > each else 0)) for x, n in number.items()}
    shares = spark.createDataFrame([(x, scale * take[x] // number[x]) for x in languages], "lang string, share long")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale))
    # The sample is bounded, and so are its tasks and what they count.
    # Texts don't move for this while languages are few, as they are; a shuffled join is there for any number.
    shares = F.broadcast(shares) if len(languages) <= MOST_BROADCAST else shares
    sample = rows.join(shares, "lang").filter(place < F.col("share")).select("text", "lang").repartition(min(16, partitions(spark)))

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, end, grams, off, _ in buckets(batch.column("text"), 1 << 18, bits):
                for k in range(first, end):
                    own = seen.setdefault(langs[k], np.zeros((1 << bits) + 1, np.int64))
                    own += np.bincount(grams[:, off[k - first] : off[k - first + 1]].ravel(), minlength=(1 << bits) + 1)
        for lang, own in seen.items():
            at = np.flatnonzero(own[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    cells = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = cells.toArrow()  # MATRIX cells at most
    lang, bucket, times = np.array(got["lang"].to_pylist(), object), got["bucket"].to_numpy(), got["n"].to_numpy()
    column = {x: k for k, x in enumerate(languages)}
    counts = np.full((1 << bits, len(languages)), 0.5)
    if len(lang):
        counts[bucket, [column[x] for x in lang]] += times
    weights = np.zeros(((1 << bits) + 1, len(languages)))
    weights[:-1] = np.log(counts / counts.sum(0))
    return Model(languages, weights, np.log(np.array([number[x] for x in languages], float) / sum(number.values())), bits)


def predict(rows: DataFrame, model: Model, *kept: str) -> DataFrame:
    """kept columns of rows (text), lang_pred, score."""
    spark = rows.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.prior, model.bits))
    step = max(1 << 12, (1 << 20) // max(4, len(model.languages)))

    def score(batches):
        languages, weights, prior, bits = shared.value
        names = [*languages, "und"]
        for batch in batches:
            total, lettered = np.zeros((batch.num_rows, len(languages))), np.zeros(batch.num_rows, np.int64)
            for first, end, grams, off, letters in buckets(batch.column("text"), step, bits) if languages else ():
                full = np.flatnonzero(letters)
                if not len(full):
                    continue
                each = weights[grams[0]]
                for k in range(1, ORDERS):
                    each += weights[grams[k]]
                # Texts without letters between two others add only zero rows.
                total[first + full] += np.add.reduceat(each, off[full], axis=0)
                lettered[first:end] += letters
            best, sure = np.full(batch.num_rows, len(languages), np.int64), np.zeros(batch.num_rows)
            full = np.flatnonzero(lettered)
            if len(full):
                odds = total[full] + prior
                odds = np.exp(odds - odds.max(1, keepdims=True))
                best[full], sure[full] = odds.argmax(1), 1 / odds.sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([names[k] for k in best], pa.string()), pa.array(sure)], [*kept, "lang_pred", "score"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "text").mapInArrow(score, f"{types}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(docs, model, "doc_id", "held_out")
