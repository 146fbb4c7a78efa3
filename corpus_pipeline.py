"""A corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, and whatever other columns docs has, under any names, as they were.

Defined results, of every stage: an empty table gives an empty one; a row is judged by its text (and source), so that
repeated rows share a decision; no stage tells rows apart by doc_id alone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, delete_folder, discard, fresh, prepare, shared_dir, tidy
from tidemark.llm.decontamination import without_leaks
from tidemark.llm.ngram_join import representatives
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import find_personal_data, redact
from tidemark.llm.quality_rules import judged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts fail the rules and go. Rows of the same text and source, with any doc_id, stay or go together.
    """
    host, a, b = fresh(docs, "host", "a", "b")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({host: F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit("")), a: F.xxhash64(text), b: F.xxhash64(F.lit(1), text)})
    names = ["k0", "k1", "k2"]
    verdicts, tables = judged(keyed.select(F.col(host).alias("k0"), F.col(a).alias("k1"), F.col(b).alias("k2"), "text", "source"), *names)
    rejected = cut(verdicts.filter("NOT kept").select(*names).distinct()).toDF(host, a, b)
    discard(*tables)
    # The rejected grow with the documents, so they are never broadcast.
    return keyed.join(rejected.hint("merge"), [host, a, b], "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the least (doc_id, hash of its text) stays.

    Groups are of texts: rows of one doc_id with unrelated texts all stay. Of rows with the same doc_id and text one
    stays. Rows without a doc_id or without a word in the text belong to no group and stay.
    """
    th, *_ = fresh(docs, "th")
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    stay = representatives(docs).withColumnRenamed("th", th)
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    # Repeated rows become one on the map side, before any key is dealt out.
    kept = keyed.filter(worded).dropDuplicates(["doc_id", th]).join(stay, ["doc_id", th], "left_semi")
    return kept.select(docs.columns).unionByName(docs.filter(~worded))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text; null and empty texts hold none."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind, row by row; n_chars follows the text where something was.

    Texts without any are as they were, null ones too.
    """
    prepare(spark)
    own = [f"c{k}" for k in range(len(docs.columns))]
    found = find_personal_data(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, own, strict=True)), "text"), *own)
    place = {c.lower(): k for k, c in enumerate(docs.columns)}

    def run(batches):
        for batch in batches:
            columns, spans = [batch.column(x) for x in own], batch.column("spans").to_pylist()
            text = columns[place["text"]]
            out = [t if not s else redact(t, [(x["start"], x["kind"], x["end"]) for x in s]) for t, s in zip(text.to_pylist(), spans, strict=True)]
            columns[place["text"]] = pa.array(out, pa.string())
            if "n_chars" in place:
                size = columns[place["n_chars"]]
                columns[place["n_chars"]] = pa.array([len(new) if s else old for new, s, old in zip(out, spans, size.to_pylist(), strict=True)], size.type)
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = list(docs.columns)
    return found.mapInArrow(run, docs.schema)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, row by row, in sequences of at most 1024 tokens; a null or empty text is its end id alone."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Near-duplicate groups and everything after them can't be put in SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over documents. Each stage's table goes when the next one is written; the last input stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        with tidy(spark):
            out.write.parquet(f"{folder}/{k}-{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{k}-{name}"
        docs = spark.read.parquet(before)
