"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank in the corpus's own frequency order, so that common ones take one byte. Ranks are
written in one to four little-endian bytes; the lengths, two bits each, stand apart in control bytes (four a byte).
Decoding looks control bytes up in a table of lengths, so that numpy does it without a loop over ids.

A file set is a folder of Parquet parts in ascending doc_id order, a row for each block of documents: part, block,
doc_ids, counts, n_ids, control, data; and beside it a one-row table with the ids in rank order.

Defined results: null or empty texts hold only the end id; rows with null doc_ids come first; rows that share a doc_id
stand side by side in an order fixed by their texts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bytepieces import encoder
from tidemark.llm.common import delete_folder, prepare, shared_dir, tasks_for, tidy

#: Lengths of the four values that a control byte stands for, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that pack() was given."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.uint32)
    at = np.cumsum(size) - size
    out = raw[at]
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> None:
    """Write docs (doc_id, text) as a token file set. Texts move once, to their place in the order; ids don't."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = max(encoder(path).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(tasks_for(rows), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    placed = placed.withColumn("part", F.spark_partition_id()).select("doc_id", "part", "text")

    def encode(batches):
        enc, block = encoder(path), 0
        for batch in batches:
            for first, end, ids, places in enc.steps(batch.column("text")):
                count = np.diff(places) + 1
                out = np.full(int(count.sum()), end_id, np.uint32)
                text = np.repeat(np.arange(end - first), count - 1)
                out[np.arange(len(ids)) + text] = ids
                narrow = out.astype("<u2") if vocabulary <= 1 << 16 else out.astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column("part")[first : first + 1], pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, end - first], pa.int32()), batch.column("doc_id").slice(first, end - first)), pa.array([count.tolist()], pa.list_(pa.int64())), pa.array([narrow.tobytes()], pa.binary())], ["part", "block", "doc_ids", "counts", "ids"])
                block += 1

    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    staged = f"{folder}/staged"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    with tidy(spark):
        placed.mapInArrow(encode, f"part int, block long, doc_ids array<{id_type}>, counts array<long>, ids binary").write.option("compression", "zstd").parquet(staged)
    ids = spark.read.parquet(staged)

    def tally(batches):
        count = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                count += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocabulary)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], ["id", "n"])

    # A row for each id of the vocabulary at most comes to the driver.
    ranked = ids.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = [r["id"] for r in sorted(ranked, key=lambda r: (-r["n"], r["id"]))]
    rank = np.zeros(vocabulary, np.uint32)
    rank[order] = np.arange(len(order))
    spark.createDataFrame([(order,)], "ids array<long>").coalesce(1).write.parquet(f"{folder}/ranks")

    def write(batches):
        for batch in batches:
            packed = [pack(rank[np.frombuffer(x.as_buffer(), kind)]) for x in batch.column("ids")]
            sizes = [len(x.as_buffer()) // int(kind[-1]) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "block", "doc_ids", "counts")), pa.array(sizes, pa.int64()), pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())], ["part", "block", "doc_ids", "counts", "n_ids", "control", "data"])

    made = ids.mapInArrow(write, f"part int, block long, doc_ids array<{id_type}>, counts array<long>, n_ids long, control binary, data binary")
    made.write.option("compression", "zstd").parquet(f"{folder}/blocks")
    delete_folder(spark, staged)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, place, doc_id, ids (little-endian unsigned 32-bit) of each document of a file set."""
    prepare(spark)
    order = np.array(spark.read.parquet(f"{folder}/ranks").head()["ids"], np.uint32)
    blocks = spark.read.parquet(f"{folder}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches):
        for batch in batches:
            for k, row in enumerate(batch.select(["part", "block", "counts", "n_ids", "control", "data"]).to_pylist()):
                ids = order[unpack(row["control"], row["data"], row["n_ids"])] if row["n_ids"] else np.zeros(0, np.uint32)
                stop = np.cumsum(row["counts"]).tolist()
                n = len(stop)
                parts = [ids[b - c : b].tobytes() for b, c in zip(stop, row["counts"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int64()), batch.column("doc_ids")[k].values, pa.array(parts, pa.binary())], ["part", "block", "place", "doc_id", "ids"])

    return blocks.mapInArrow(read, f"part int, block long, place long, doc_id {id_type}, ids binary")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from a file set."""

    def digest(batches):
        for batch in batches:
            ids = [x.as_buffer() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "block", "place", "doc_id")), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["part", "block", "place", "doc_id", "n_tokens", "ids_crc32"])

    found = read_token_files(spark, folder)
    id_type = found.schema["doc_id"].dataType.simpleString()
    rows = found.mapInArrow(digest, f"part int, block long, place long, doc_id {id_type}, n_tokens long, ids_crc32 long")
    # A row for each part comes to the driver; parts are as many as shuffle partitions.
    sizes = {r["part"]: r["n"] for r in spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = [], 0
    for part in sorted(sizes):
        base.append((part, total))
        total += sizes[part]
    bases = spark.createDataFrame(base, "part int, base long")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.coalesce(before, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_digests(spark, folder)
