"""Best-fit packing of tokenised documents into sequences.

Bounded-space online best-fit: a packer keeps at most ``open_bins`` unfinished sequences, found by their free space in
a bitset, puts a piece where it fits most tightly, and closes the fullest when a new one is needed. Packers work side
by side over parts of the pieces; what each leaves unfinished is packed again as if it were pieces, in fewer tasks.

Defined results: a null or empty text is the end id alone; a null or repeated doc_id is packed row by row; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytepieces import encoder
from tidemark.llm.common import cut, partitions, prepare, tidy

OPEN_BINS = 256
#: Pieces that a packer of the first round gets at least, where there are so many, and about at most.
ITEMS, MOST_ITEMS = 1 << 12, 1 << 20
#: Unfinished sequences that one task of the second round packs.
SECOND_ROUND = 1 << 13


class BestFit:
    """Bounded-space online best-fit over item sizes up to capacity."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f is set while a bin with free space f is open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) for an item."""
        tail = self.bits >> size
        if tail:
            free = size + (tail & -tail).bit_length() - 1
            found = self.bins[free].pop()
            if not self.bins[free]:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            if self.open >= self.open_bins:
                least = (self.bits & -self.bits).bit_length() - 1
                self.bins[least].pop()
                if not self.bins[least]:
                    self.bits ^= 1 << least
                self.open -= 1
            free, found = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.bins[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free

    def unfinished(self) -> set[int]:
        return {b for group in self.bins for b in group}


def _packed(items: DataFrame, capacity: int, open_bins: int, tag: int) -> DataFrame:
    """items: key, size, dealt out already. Returns key, size, bin, offset, unfinished."""

    def run(batches):
        from pyspark import TaskContext

        packer, keys, sizes, places = BestFit(capacity, open_bins), [], [], []
        for batch in batches:  # a number or two for each item of this task
            keys.append(batch["key"].to_numpy(np.int64))
            sizes.append(batch["size"].to_numpy(np.int64))
            places.extend(map(packer.place, sizes[-1].tolist()))
        if not places:
            return
        place = np.array(places, np.int64).reshape(-1, 2)
        left = np.isin(place[:, 0], np.fromiter(packer.unfinished(), np.int64))
        base = (tag << 60) | (TaskContext.get().partitionId() << 36)
        yield pd.DataFrame({"key": np.concatenate(keys), "size": np.concatenate(sizes), "bin": place[:, 0] | base, "offset": place[:, 1], "unfinished": left})

    return items.select("key", "size").mapInPandas(run, "key long, size long, bin long, offset long, unfinished boolean")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches):
        enc = encoder(path)
        for batch in batches:
            for first, end, ids, places in enc.steps(batch.column("text")):
                out = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for k in range(end - first):
                    own = np.append(ids[places[k] : places[k + 1]], np.uint32(end_id)).astype("<u4")
                    at = 0
                    for piece, size in enumerate(piece_sizes(len(own), capacity)):
                        for name, value in zip(out, (first + k, piece, at, size, zlib.crc32(own[at : at + size].tobytes())), strict=True):
                            out[name].append(value)
                        at += size
                names = ["doc_id", *list(out)[1:]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in names[2:])], names)

    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pieces, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")
    made = cut(made.withColumn("key", F.monotonically_increasing_id()))
    whole = made.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("key")).withColumn("offset", F.lit(0).cast("long"))
    rest = made.filter(F.col("length") < capacity)
    with tidy(spark):
        pieces_left = rest.count()
    n = max(1, min(partitions(spark), pieces_left // ITEMS), -(-pieces_left // MOST_ITEMS))
    dealt = rest.select("key", F.col("length").alias("size")).repartition(n, F.xxhash64("key")).sortWithinPartitions(F.xxhash64("key"))
    first = cut(_packed(dealt, capacity, open_bins, 0))
    # What is left unfinished: open_bins sequences for each task at most.
    left = first.filter("unfinished").groupBy("bin").agg(F.sum("size").alias("size")).withColumnRenamed("bin", "key")
    rounds = max(1, n * open_bins // SECOND_ROUND)
    dealt = left.repartition(rounds, F.xxhash64("key")).sortWithinPartitions(F.desc("size"), "key")
    second = _packed(dealt, capacity, SECOND_ROUND, 1)
    second = second.select(F.col("key").alias("bin"), F.col("bin").alias("into"), F.col("offset").alias("base"))
    places = first.join(cut(second), "bin", "left").select("key", F.coalesce("into", "bin").alias("sequence_id"), (F.coalesce("base", F.lit(0)) + F.col("offset")).alias("offset"))
    return whole.unionByName(rest.join(places, "key")).drop("key")


def piece_sizes(n: int, capacity: int) -> list[int]:
    """A document of n ids in pieces: all of it, or full pieces with what is over in front."""
    over = n % capacity
    return ([over] if over else []) + [capacity] * (n // capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
