"""Sinks: sorted tables, versioned tables with atomic commits, and a log that readers follow with a cursor.

A commit is one small file whose number must be new: the file system creates it whole or not at all, so that of two
writers of one version one fails, and readers see all of a batch or nothing. Data files are only ever added; a reader
pins a version and keeps seeing what it listed, whatever is committed later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, folder: str, *keys: str, bloom: str | None = None, parts: int | None = None) -> None:
    """Write df as immutable files of disjoint ranges of keys, each sorted, with a bloom filter for point reads if asked.

    Parquet keeps the least and greatest key of each block, so range scans read only the blocks they need.
    """
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    out = dealt.sortWithinPartitions(*keys).write
    if bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    out.parquet(folder)


class VersionedTable:
    """Rows by key; each commit adds rows and takes keys away, in one step."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 for none. What it holds is durable."""
        path, fs = self._path("commits")
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(path)), default=0) if fs.exists(path) else 0

    def _read(self, version: int) -> dict:
        if not version:
            return {"parts": []}
        path, fs = self._path(f"commits/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, added: DataFrame | None = None, removed: DataFrame | None = None, drop_parts: tuple[str, ...] = (), at: int | None = None) -> int:
        """Publish rows (added), keys (removed) and parts that no longer count, as the version after at (the newest).

        Parts that aren't there can't be dropped, and a version that another writer has taken raises.
        """
        at = self.version() if at is None else at
        parts = self._read(at)["parts"]
        missing = set(drop_parts) - {p["name"] for p in parts}
        if missing:
            raise ValueError(f"no such part: {sorted(missing)}")
        parts = [p for p in parts if p["name"] not in drop_parts]
        for kind, frame in (("removed", removed), ("added", added)):  # what is added counts over what is removed with it
            if frame is not None:
                name = f"data/{uuid.uuid4().hex}"
                frame.write.parquet(f"{self.folder}/{name}")
                parts.append({"name": name, "kind": kind, "version": at + 1, "rank": 2 * at + (kind == "added")})
        path, fs = self._path(f"commits/{at + 1:012d}.json")
        stream = fs.create(path, False)  # never over another one's
        stream.write(bytearray(json.dumps({"parts": parts}).encode()))
        stream.close()
        return at + 1

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The newest row of each key that is there at a version (now the newest)."""
        parts = self._read(self.version() if version is None else version)["parts"]
        empty = self.spark.createDataFrame([], self.schema)
        names = [c for c in empty.columns if c != self.key]
        rows = empty.withColumn("_rank", F.lit(0).cast("long")).withColumn("_there", F.lit(True))
        for p in parts:
            schema = empty.schema if p["kind"] == "added" else empty.select(self.key).schema
            own = self.spark.read.schema(schema).parquet(f"{self.folder}/{p['name']}")
            own = own.withColumn("_rank", F.lit(p["rank"]).cast("long")).withColumn("_there", F.lit(p["kind"] == "added"))
            rows = rows.unionByName(own, allowMissingColumns=True)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct("_there", *names), "_rank").alias("_r"))
        return last.filter("_r._there").select(self.key, *(F.col(f"_r.{c}").alias(c) for c in names)).select(empty.columns)


def append_frames(rows: DataFrame, folder: str, order: str) -> None:
    """Append rows to a log, in order; a frame is the rows of one value of order."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("append").parquet(folder)


def read_frames(log: DataFrame, cursor: int, most_rows: int, order: str) -> tuple[DataFrame, int]:
    """The next frames of a log after a cursor, of at most so many rows (one frame at least), and the cursor after them."""
    ahead = log.filter(F.col(order) > cursor)
    # The least rows of each task, then of all of them: a row more than may be read.
    frames = ahead.select(order).orderBy(order).limit(most_rows + 1).groupBy(order).agg(F.count("*").alias("n")).orderBy(order).collect()
    if not frames:
        return ahead.limit(0), cursor
    whole = frames if sum(r["n"] for r in frames) <= most_rows else frames[:-1] or frames[:1]
    end = whole[-1][order]
    return ahead.filter(F.col(order) <= end), end
