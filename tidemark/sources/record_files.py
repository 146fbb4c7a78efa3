"""Record files: a 64-byte little-endian header, then payload and key, with an XXH3-128 checksum over all.

Files are read by Spark's binary source and decoded file by file; a scan stops at the first damaged or torn record, and
says how far the file is valid. Only headers and keys are returned unless payloads are asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
MAGIC = b"STR0"
VERSION = 4
HEADER_LEN = 64
CHECKSUM_XXH3_128 = 1
MAX_PAYLOAD = 1 << 40
MAX_KEY = 4096

#: Bytes of rows that leave a scan at once.
STEP = 4 << 20
#: Bytes of rows that Spark hands to a worker at once, except a single longer row.
BATCH = 8 << 20

#: Magic, version, header length, key length, generation, payload length, checksum (two halves), algorithm, shard id and
#: generation, padding.
HEADER = struct.Struct("<4sHHIQQQQIIQ4x")


def checksum(header: bytes, payload: bytes, key: bytes) -> int:
    """XXH3-128 of the header with a zero checksum, the payload and the key."""
    digest = xxhash.xxh3_128(header[:28] + bytes(16) + header[44:])
    digest.update(payload)
    digest.update(key)
    return digest.intdigest()


def encode(key: bytes, payload: bytes, generation: int = 0, shard: int = 0, shard_generation: int = 0) -> bytes:
    if not 1 <= len(key) <= MAX_KEY or len(payload) > MAX_PAYLOAD:
        raise ValueError("a key has 1 to 4096 bytes, a payload at most 2^40")
    pack = lambda x: HEADER.pack(MAGIC, VERSION, HEADER_LEN, len(key), generation, len(payload), x & (1 << 64) - 1, x >> 64, CHECKSUM_XXH3_128, shard, shard_generation)
    return pack(checksum(pack(0), payload, key)) + payload + key


def peek(data: bytes, at: int = 0) -> dict:
    """The header at an offset; raises ValueError if there is none."""
    if len(data) - at < HEADER_LEN:
        raise ValueError("torn header")
    magic, version, size, key_len, generation, payload_len, low, high, algorithm, shard, shard_generation = HEADER.unpack_from(data, at)
    if (magic, version, size, algorithm) != (MAGIC, VERSION, HEADER_LEN, CHECKSUM_XXH3_128) or not 1 <= key_len <= MAX_KEY or payload_len > MAX_PAYLOAD:
        raise ValueError("no record header")
    return {"key_len": key_len, "generation": generation, "payload_len": payload_len, "checksum": high << 64 | low, "shard": shard, "shard_generation": shard_generation, "len": HEADER_LEN + payload_len + key_len}


def scan(data: bytes) -> Iterator[tuple[int, dict, bytes, bytes]]:
    """(offset, header, payload, key) of each record, up to the first that is torn or damaged."""
    at = 0
    while at < len(data):
        try:
            head = peek(data, at)
        except ValueError:
            return
        middle, end = at + HEADER_LEN + head["payload_len"], at + head["len"]
        if end > len(data) or checksum(data[at : at + HEADER_LEN], data[at + HEADER_LEN : middle], data[middle:end]) != head["checksum"]:
            return
        yield at, head, data[at + HEADER_LEN : middle], data[middle:end]
        at = end


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some MB, so that a worker's memory depends neither on a table's size nor on how long its texts are.
    The session keeps the setting, as a plan is run after it is made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def in_steps(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Rows of a batch by slices of at most STEP bytes (by the mean of the batch), a row at least; nothing is copied."""
    n = len(columns[0])
    step = max(1, STEP * n // max(1, sum(c.nbytes for c in columns)))
    for at in range(0, n, step):
        yield tuple(c.slice(at, step) for c in columns)


def binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


@F.arrow_udf(T.BinaryType())
def encoded(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Records of keys and payloads (texts) in a shard. They leave in steps, so that a worker holds what Spark hands it at
    once and a few MB more."""
    for batch in batches:
        for key, payload, shard in in_steps(*batch):
            yield binary([encode(k.as_buffer().to_pybytes(), p.as_buffer().to_pybytes(), shard=s.as_py()) for k, p, s in zip(key, payload, shard, strict=True)])


def header(record: Column) -> Column:
    """What the headers of records say, without a look at the rest."""
    return _header(F.substring(record, 1, HEADER_LEN))


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("key_len", "payload_len", "shard", "len")]))
def _header(start: pd.Series) -> pd.DataFrame:
    names = ("key_len", "payload_len", "shard", "len")
    return pd.DataFrame([[h[x] for x in names] for h in (peek(bytes(r)) for r in start)], columns=names)


@F.arrow_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("whole", T.BooleanType())]))
def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Key and payload of whole records; whole is false for what is torn or damaged. They leave in steps as encoded()'s do."""
    for batch in batches:
        for (record,) in in_steps(batch):
            rows = [next(scan(r.as_buffer().to_pybytes()), None) for r in record]
            columns = [binary([r and r[3] for r in rows]), binary([r and r[2] for r in rows]), pa.array([r is not None for r in rows])]
            yield pa.StructArray.from_arrays(columns, ["key", "payload", "whole"])


SCHEMA = "path string, offset long, len long, key binary, generation long, shard long, shard_generation long, payload binary"


def read_records(spark, folder: str, payloads: bool = False) -> DataFrame:
    """The valid prefix of each record file of a folder, a row for each record.

    A file is scanned in one task, as only its start says where its records begin; rows leave in steps of a few MB. Spark's
    binary source reads files of up to 2 GB, so segments have to be smaller.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for at, h, payload, key in scan(data):
                    rows.append((path, at, h["len"], key, h["generation"], h["shard"], h["shard_generation"], payload if payloads else None))
                    size += h["len"] if payloads else 256
                    if size >= STEP:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, SCHEMA)


def valid_prefixes(spark, folder: str, durable: DataFrame | None = None) -> DataFrame:
    """path, valid_len, file_len of each file; with durable (path, durable_len), damage before that length raises."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("file_len"))
    valid = read_records(spark, folder).groupBy("path").agg(F.max(F.col("offset") + F.col("len")).alias("valid_len"))
    out = files.join(valid, "path", "left").select("path", F.coalesce("valid_len", F.lit(0).cast("long")).alias("valid_len"), "file_len")
    if durable is None:
        return out
    bad = F.col("valid_len") < F.col("durable_len")
    checked = F.when(bad, F.raise_error(F.lit("damage before the durable length")).cast("long")).otherwise(F.col("valid_len"))
    return out.join(durable, "path").select("path", checked.alias("valid_len"), "file_len")
