"""Incremental sweeps and folds of the mutation log with Structured Streaming.

A batch writes its sums to a folder named by its number and overwrites it when tried again, so that a batch counts once
whatever fails; totals are sums over batches. Rows that a batch may not apply yet go to a pending folder, and the
frontier moves only when nothing is pending: it is a minimum over what was seen, not an event-time watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.merge import fold
from tidemark.sources.folders import fresh_folder, share_code

LOG_SCHEMA = "lsn long, k long, shard long, epoch long, op string, end_epoch long, len long"
#: States that a fold's keys are dealt to.
BUCKETS = 2048


def run_batches(stream: DataFrame | Parts, each: Callable[[DataFrame, int, str], None], name: str, made: Callable[[DataFrame], DataFrame] = lambda s: s) -> str:
    """Drain a stream now, batch by batch, or one that comes part by part as each part is there; each() writes what it makes
    of made(stream)'s batches below the folder that is returned. Progress and state last from part to part."""
    folder = fresh_folder(stream.sparkSession, name)
    for s in [stream] if isinstance(stream, DataFrame) else stream:
        query = made(s).writeStream.outputMode("update").foreachBatch(lambda df, n: each(df, n, folder)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    return folder


def swept(stream: DataFrame | Parts, frontier: DataFrame, deleted: DataFrame, tries: int = 1) -> dict[str, DataFrame]:
    """applied (k, puts, bytes), pending rows, and dropped (k, n) of a stream of mutations.

    frontier (k, through): rows of a key beyond it are early and wait; deleted (k): rows of these keys are dropped.
    A batch that is tried again overwrites what it wrote; tries does so on purpose.
    """

    def each(batch: DataFrame, number: int, folder: str) -> None:
        rows = batch.join(deleted.withColumn("gone", F.lit(True)), "k", "left").join(frontier, "k", "left")
        rows = rows.withColumn("gone", F.coalesce("gone", F.lit(False))).withColumn("ready", F.coalesce(F.col("lsn") <= F.col("through"), F.lit(False)))
        rows = rows.persist()
        for _ in range(tries):
            sums = rows.filter("NOT gone AND ready AND op = 'put'").groupBy("k").agg(F.count("*").alias("puts"), F.sum("len").alias("bytes"))
            sums.write.mode("overwrite").parquet(f"{folder}/applied/batch={number}")
            rows.filter("NOT gone AND NOT ready").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/pending/batch={number}")
            rows.filter("gone").groupBy("k").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/dropped/batch={number}")
        rows.unpersist()

    spark = stream.sparkSession
    folder = run_batches(stream, each, "sweep")
    applied = spark.read.schema("k long, puts long, bytes long").parquet(f"{folder}/applied/*").groupBy("k").agg(F.sum("puts").alias("puts"), F.sum("bytes").alias("bytes"))
    dropped = spark.read.schema("k long, n long").parquet(f"{folder}/dropped/*").groupBy("k").agg(F.sum("n").alias("n"))
    return {"applied": applied, "pending": spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/pending/*"), "dropped": dropped}


def sweep(stream: DataFrame | Parts, frontier: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """swept()'s applied and pending."""
    got = swept(stream, frontier, deleted)
    return got["applied"], got["pending"]


def forwarded(stream: DataFrame | Parts, moves: DataFrame) -> DataFrame:
    """A stream of garbage events (segment_id, offset and more), each also for the copy that its record has by now.

    moves: segment_id, offset, to_segment. They are joined batch by batch, so an event that was not swept when its record
    moved still reaches the copy.
    """

    def each(batch: DataFrame, number: int, folder: str) -> None:
        copies = batch.join(moves, ["segment_id", "offset"]).withColumn("segment_id", F.col("to_segment")).select(*batch.columns)
        batch.unionByName(copies).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    folder = run_batches(stream, each, "forward")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/events/*")


class ProgressListener(StreamingQueryListener):
    """Tells a subscriber how far each query is: (query name or id, batch, rows) once a batch is durable."""

    def __init__(self, tell: Callable[[str, int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.tell(event.progress.name or str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def fold_stream(stream: DataFrame | Parts, buckets: int = BUCKETS) -> DataFrame:
    """k, live, ends of each key after all of a stream of mutations, by keyed state: how many versions it holds, and the
    end epochs of those that have one. Epochs reach a key lazily, by a look at ends when it is read.

    Keys are dealt to buckets, and a bucket's keys share a state: one by itself costs Python milliseconds in each batch,
    however little it holds. A batch rewrites the states of the buckets that it has rows of."""
    names = ["k", "lsn", "shard", "epoch", "op", "end_epoch"]

    def update(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[names] for b in batches], ignore_index=True)
        if bucket[0] is None:  # rows without a key
            rows["k"] = -1
        rows = rows.sort_values("k", kind="stable", ignore_index=True)
        states = json.loads(state.get[0]) if state.exists else {}
        cuts = [0, *np.flatnonzero(np.diff(rows["k"].to_numpy())) + 1, len(rows)]
        out = []
        for a, b in pairwise(cuts):
            own = rows.iloc[a:b]
            k, *columns = (own[c].to_list() for c in names)
            now = states[str(k[0])] = fold(states.get(str(k[0]), {}), [(x, s, e, op, int(end)) for x, s, e, op, end in zip(*columns, strict=True)])
            life = now["life"]
            ends = [life[1] for lsn, epoch in now["live"].values() if life and not (life[0] <= lsn and life[1] <= epoch)]
            out.append((None if bucket[0] is None else k[0], max(columns[0]), len(now["live"]), ends))
        state.update((json.dumps(states),))
        yield pd.DataFrame(out, columns=["k", "last_lsn", "live", "ends"])

    def folded(s: DataFrame) -> DataFrame:
        dealt = s.select(*names).withColumn("bucket", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("k"), F.lit(buckets))))
        return dealt.groupBy("bucket").applyInPandasWithState(update, "k long, last_lsn long, live long, ends array<long>", "json string", "update", GroupStateTimeout.NoTimeout)

    def each(batch: DataFrame, number: int, folder: str) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    spark = stream.sparkSession
    share_code(spark)
    folder = run_batches(stream, each, "fold", folded)
    states = spark.read.schema("k long, last_lsn long, live long, ends array<long>").parquet(f"{folder}/states/*")
    return states.groupBy("k").agg(F.max_by(F.struct("live", "ends"), "last_lsn").alias("s")).select("k", "s.live", "s.ends")


class Parts:
    """Rows as a stream that comes part by part: each step of an iteration writes a part's files, in as many tasks as the
    rows have, and gives the stream, which has all files so far. Who drains it each time with one checkpoint gets a part a
    batch, whatever the times and numbers of its files are."""

    def __init__(self, parts: list[DataFrame]):
        self.parts, self.sparkSession, self.schema = parts, parts[0].sparkSession, parts[0].schema

    def __iter__(self) -> Iterator[DataFrame]:
        folder = fresh_folder(self.sparkSession, "parts")
        for part in self.parts:
            part.write.mode("append").parquet(folder)
            yield self.sparkSession.readStream.schema(self.schema).parquet(folder)


def stream_in_parts(rows: DataFrame, order: str, bounds: list[int]) -> Parts:
    """rows as a stream of a batch for each part, in the order of a column: cut after each of bounds, so that what is kept by
    key has to last from batch to batch."""
    after = [rows if lo is None else rows.filter(F.col(order) > lo) for lo in [None, *bounds]]
    return Parts([part if hi is None else part.filter(F.col(order) <= hi) for part, hi in zip(after, [*bounds, None], strict=True)])


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as a stream of mutations."""
    from tidemark.sources.events import mutations

    class Streamed:
        """Reads as a stream where mutations() reads a table."""

        def __init__(self):
            self.read = self

        def parquet(self, path: str) -> DataFrame:
            folder, name = path.rsplit("/", 1)
            schema = spark.read.parquet(path).schema
            return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)

    return mutations(Streamed(), sf_dir)
