"""Helpers that the operators of this subpackage share: session settings, durable cuts of lineage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to a Python worker at once. Texts may be very long, so batches are cut again by bytes.
ARROW_ROWS = 512
#: Bytes of text that one vectorised step works on at most, except a single longer text.
STEP_BYTES = 1 << 20


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory does not depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # Workers find this package where the driver did, should it not be installed; elsewhere, ship it with --py-files.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one will do for a local master;
    a cluster must name it, as its machines don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(local)
    return local


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends. Nothing is read twice here: tables are cut before that."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def delete_folder(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that cut() returned, once nothing reads them any more."""
    for df in frames:
        delete_folder(df.sparkSession, df.cut_path)


def is_empty(df: DataFrame) -> bool:
    with tidy(df.sparkSession):
        return df.isEmpty()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tasks_for(df: DataFrame, per_task: int = 1 << 28) -> int:
    """Tasks to deal df out to: the session's number, or more where its estimated bytes ask for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 55 else 0  # Spark says a number near 2^63 where it doesn't know
    return max(partitions(df.sparkSession), -(-known // per_task))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of at most limit bytes (one row at least).

    Yields (first row, end row, bytes of these rows, offsets of each row in them). Nulls are empty.
    """
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of the public SplitMix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, STEP_BYTES + 1024)
        for name, base in (("p", _BASE), ("i", _BASE_INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"], _powers["i"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for many spans: differences of one running polynomial sum."""
    n = len(values)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    got = (total[ends] - total[starts]) * down[starts]
    return mix64(got + (ends - starts).astype(np.uint64) * _GOLDEN)


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts laid end to end: starts, ends, and the first word of each text (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z in lower case if fold), and the first word of each text (n + 1)."""
    starts, ends, first = word_spans(raw, off)
    return span_hashes(BYTE_VALUES[_FOLD[raw] if fold else raw], starts, ends), first


_SHINGLE = [np.uint64(pow(0xA24BAED4963EE407, k + 1, 1 << 64)) for k in range(64)]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words of each text, a text with fewer words giving one of them all; firsts (n + 1)."""
    count = np.diff(first)
    kept = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(kept, out=begin[1:])
    out = np.zeros(begin[-1], np.uint64)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled += words[k : len(words) - size + 1 + k] * _SHINGLE[k]
        text = np.repeat(np.arange(len(count)), kept)
        at = np.arange(begin[-1]) - begin[text] + first[text]
        full = count[text] >= size
        out[full] = rolled[at[full]]
    for t in np.flatnonzero((count > 0) & (count < size)):
        w = words[first[t] : first[t + 1]]
        out[begin[t]] = (w * np.array(_SHINGLE[: len(w)])).sum(dtype=np.uint64) ^ _SHINGLE[size + len(w)]
    return mix64(out), begin
