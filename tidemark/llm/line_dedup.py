"""Substring deduplication by line hashing.

Texts are cut into sentences, which end with a line too, and these are put together to units: each whole line, and for
each sentence the shortest run of sentences from it on, and the shortest up to it, that has min_words words. A sentence
of that many words is such a run by itself. So every sentence of a repeated passage of whole sentences with min_words
words in all is in a unit of the passage, however short its sentences are and wherever it was pasted. Units are
normalised (case and white space) and hashed to 128 bits; digests are grouped over all documents; the occurrence of the
least (doc_id, row, start) stays and the others are removed, with their original offsets. Units overlap; of a sentence
that goes, an equal one stays at an earlier place.

Digests are counted with partial aggregation, so a unit that a third of all documents hold is a row of each task; only
digests found twice are joined back, and a hot one is split among tasks like any skewed join.

Defined results: null and empty texts have no units; units of fewer than min_words words are never removed; rows with a
null doc_id rank first; rows that share a doc_id rank by their place in the input; repeats within a text count unless
they overlap what stays; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_VALUES, _FOLD, cut, mix64, prepare, span_hashes, text_steps, word_spans

MIN_WORDS = 6
_SALT = np.uint64(0x5851F42D4C957F2D)


def _text_units(raw: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """text, start, end (bytes), words, two hashes of each unit of at least min_words words of texts laid end to end."""
    starts, ends, first = word_spans(raw, off)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    values = BYTE_VALUES[_FOLD[raw]]
    words = span_hashes(values, starts, ends)
    # A line begins with a text and after a line's end, a sentence also after a word that ends one.
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=breaks[1:])
    line = np.zeros(len(starts), bool)
    line[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    line[first[:-1][first[:-1] < first[1:]]] = True
    begin = line.copy()
    begin[1:] |= np.isin(raw[ends[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    at = np.flatnonzero(begin)
    stop = np.append(at[1:], len(starts))
    text = np.searchsorted(first, at, "right") - 1
    # Units by their first and last sentence: lines, shortest runs from a sentence on, shortest runs up to one.
    n = len(at)
    each = np.arange(n)
    head = np.flatnonzero(line[at])
    a = np.concatenate([head, each, np.searchsorted(at, stop - min_words, "right") - 1])
    b = np.concatenate([np.append(head[1:], n) - 1, np.searchsorted(stop, at + min_words), each])
    inside = (a >= 0) & (b < n)
    a, b = a[inside], b[inside]
    fits = (text[a] == text[b]) & (stop[b] - at[a] >= min_words)
    a, b = np.divmod(np.unique(a[fits] * n + b[fits]), n)
    text, at, stop = text[a], at[a], stop[b]
    return text, starts[at], ends[stop - 1], stop - at, span_hashes(words, at, stop), span_hashes(mix64(words ^ _SALT), at, stop)


def find_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row, start, end, n_words, h1, h2 of units of at least min_words words of docs (doc_id, text)."""
    prepare(docs.sparkSession)

    def units(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.column("row")
            for first, end, raw, off in text_steps(batch.column("text")):
                text, start, stop, words, h1, h2 = _text_units(raw, off, min_words)
                if not len(text):
                    continue
                lead = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
                base = lead[off[text]]
                take = pa.array(first + text)
                columns = [ids.take(take), rows.take(take), pa.array(lead[start] - base), pa.array(lead[stop] - base), pa.array(words), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "start", "end", "n_words", "h1", "h2"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(units, f"doc_id {id_type}, row long, start long, end long, n_words long, h1 long, h2 long")


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row, start, end, n_words, kept_doc_id, kept_start of each unit that another occurrence outranks."""
    units = cut(find_units(docs, min_words))
    first = units.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "start", "end")).alias("kept"), F.count("*").alias("times"))
    twice = cut(first.filter("times > 1").drop("times"))
    met = units.join(twice, ["h1", "h2"])
    # The row is one text's, so this leaves out the unit that stays and what overlaps it.
    other = (F.col("row") != F.col("kept.row")) | (F.col("start") >= F.col("kept.end"))
    return met.filter(other).select("doc_id", "row", "start", "end", "n_words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the original offsets of what stays."""
    text = text or ""
    kept, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            kept.append((at, a))
        at = max(at, b)
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[a:b] for a, b in kept), kept


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
