"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Every window of a text that has as many words as a benchmark item, and may be as similar as 0.8 by the rarest of the
item's shingles, gets a 128-bit SimHash of its weighted shingles. Fingerprints are looked up in a multi-index: for each
size 16 blocks of 8 bits, each with its one-bit neighbourhood, which by the pigeonhole principle finds every item of
that size within a Hamming radius of 31. What is found within the radius is verified by the exact weighted Jaccard
similarity of the shingles of window and item, a shingle's weight being how often it occurs; 0.8 or more is
contamination. At 0.8 two fingerprints differ in 19 bits on average, with a deviation of 4.

The benchmark's index is broadcast. It is built for blocks of items of a bounded size (BLOCK_BYTES of text), one after
the other, and the documents are scanned once for each block, so that a large benchmark needs more scans and not more
memory.

Defined results: null and empty texts or items match nothing; items of fewer than five words are one shingle, and are
found only where they are a whole text, not within a longer one; a text shorter than an item is a single window; rows
with a null or repeated doc_id are judged row by row; other columns are ignored, whatever their names; empty tables give
no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, mix64, prepare, shingle_hashes, text_steps, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 31
BLOCKS = 16
#: Text of benchmark items that one index holds.
BLOCK_BYTES = 1 << 24
#: Windows that are fingerprinted at once.
WINDOWS = 1 << 12
_SALT = np.uint64(0x2545F4914F6CDD1D)


def signs(shingles: np.ndarray) -> np.ndarray:
    """128 signs (+1, -1) of each shingle hash."""
    words = np.stack([mix64(shingles), mix64(shingles ^ _SALT)], 1)
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(shingles), 16), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of 16 bytes from rows of 128 summed signs."""
    return np.packbits(sums > 0, axis=1, bitorder="little")


def item_shingles(text: str | None) -> tuple[np.ndarray, int]:
    """Shingle hashes of an item in order, and its number of words."""
    for _, _, raw, off in text_steps(pa.array([text or ""])):
        words, first = word_hashes(raw, off)
        return shingle_hashes(words, first, SHINGLE)[0], len(words)
    return np.zeros(0, np.uint64), 0


class Index:
    """Benchmark items by anchor shingle, and by size and blocks of their fingerprints.

    A window with a similarity of 0.8 lacks at most a fifth of an item's weight (a ninth if it is as long), so it holds
    one of any shingles that weigh more. An item's anchors are such, those that the fewest items have: what many items
    share, like the words of a prompt, marks no window.
    """

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids, self.words, self.values, self.counts = [], [], [], []
        prints = []
        for item, text in items:
            shingles, n = item_shingles(text)
            if not n:
                continue
            value, count = np.unique(shingles, return_counts=True)
            self.ids.append(item)
            self.words.append(n)
            self.values.append(value)
            self.counts.append(count)
            prints.append(fingerprints(signs(shingles).sum(0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint8).reshape(-1, BLOCKS)
        shingle, owner = self._anchors()
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.owner = shingle[order], owner[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.shingle & np.uint64(0xFFFFF)).astype(np.int64)] = True
        # Items by (size, block, value): those whose block is the value or differs from it in one bit.
        self.sizes = np.unique(np.array(self.words, np.int64))
        size = np.searchsorted(self.sizes, np.array(self.words, np.int64))
        near = self.prints[:, :, None] ^ np.array([0, *(1 << j for j in range(8))], np.uint8)
        key = (size[:, None, None] * BLOCKS + np.arange(BLOCKS)[:, None]) * 256 + near
        order = np.argsort(key.ravel(), kind="stable")
        self.keys = key.ravel()[order]
        self.places = (order // (BLOCKS * 9)).astype(np.int32)

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.ids:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        _, at, owners = np.unique(np.concatenate(self.values), return_inverse=True, return_counts=True)
        shingle, owner, first = [], [], 0
        for k, (value, count) in enumerate(zip(self.values, self.counts, strict=True)):
            rare = np.argsort(owners[at[first : first + len(value)]], kind="stable")
            weight = np.cumsum(count[rare])
            need = rare[: int(np.searchsorted(5 * weight, weight[-1], "right")) + 1]  # more than a fifth of the weight
            shingle.append(value[need])
            owner.append(np.full(len(need), k))
            first += len(value)
        return np.concatenate(shingle), np.concatenate(owner)

    def anchors(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that are an anchor of some item."""
        at = np.flatnonzero(self.seen[(shingles & np.uint64(0xFFFFF)).astype(np.int64)])
        found = np.searchsorted(self.shingle, shingles[at])
        found[found == len(self.shingle)] = 0
        return at[self.shingle[found] == shingles[at]]

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, items) of all fingerprints within RADIUS of that of an item of size words."""
        none = np.zeros(0, np.int64)
        own = int(np.searchsorted(self.sizes, size))
        if own == len(self.sizes) or self.sizes[own] != size:
            return none, none
        key = (own * BLOCKS + np.arange(BLOCKS)) * 256 + prints
        first, last = (np.searchsorted(self.keys, key.ravel(), side) for side in ("left", "right"))
        count = last - first
        row = np.repeat(np.repeat(np.arange(len(prints)), BLOCKS), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first, count)
        pair = np.unique(row * len(self.ids) + self.places[at])
        row, item = np.divmod(pair, len(self.ids)) if len(pair) else (none, none)
        near = np.bitwise_count(self.prints[item] ^ prints[row]).sum(1, dtype=np.int64) <= RADIUS
        return row[near], item[near]

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        """Exact weighted Jaccard similarity of a window's shingles with an item's."""
        value, count = np.unique(shingles, return_counts=True)
        own, weight = self.values[item], self.counts[item]
        at = np.searchsorted(own, value)
        at[at == len(own)] = 0
        same = own[at] == value
        both = int(np.minimum(weight[at[same]], count[same]).sum())
        return both / (int(count.sum()) + int(weight.sum()) - both)

    def matches(self, shingles: np.ndarray, n_words: int, anchors: np.ndarray) -> dict[int, tuple[float, int]]:
        """item: (similarity, first word of the best window), for one text and its anchors."""
        windows: dict[int, list[np.ndarray]] = {}  # by size in words, stretches where windows start
        first = np.searchsorted(self.shingle, shingles[anchors], "left")
        last = np.searchsorted(self.shingle, shingles[anchors], "right")
        size_of = np.array(self.words, np.int64)
        which = np.repeat(np.arange(len(anchors)), last - first)
        at = np.arange(len(which)) - np.repeat(np.cumsum(last - first) - (last - first) - first, last - first)
        wanted = np.unique(np.stack([size_of[self.owner[at]], anchors[which]], 1), axis=0)
        for size in np.unique(wanted[:, 0]).tolist():
            own = wanted[wanted[:, 0] == size, 1]
            span = max(size - SHINGLE + 1, 1)
            most = max(len(shingles) - span, 0)
            # Places from which a window holds an anchor, as stretches that don't overlap.
            lo, hi = np.minimum(np.maximum(own - span + 1, 0), most), np.minimum(own, most) + 1
            cuts = np.flatnonzero(lo[1:] > hi[:-1]) + 1
            windows[size] = [np.arange(a, b) for a, b in zip(lo[np.r_[0, cuts]].tolist(), hi[np.r_[cuts - 1, len(hi) - 1]].tolist(), strict=True)]
        out: dict[int, tuple[float, int]] = {}
        for size, stretches in windows.items():
            span = max(size - SHINGLE + 1, 1)
            for run in (x for s in stretches for x in np.array_split(s, -(-len(s) // WINDOWS))):
                a, b = int(run[0]), min(int(run[-1]) + span, len(shingles))
                total = np.zeros((b - a + 1, 128), np.int32)
                np.cumsum(signs(shingles[a:b]), 0, out=total[1:])
                end = np.minimum(run + span, b)
                for row, k in zip(*(x.tolist() for x in self.candidates(fingerprints(total[end - a] - total[run - a]), size)), strict=True):
                    s = self.similarity(k, shingles[run[row] : end[row]])
                    if s >= THRESHOLD and (k not in out or (s, -int(run[row])) > (out[k][0], -out[k][1])):
                        out[k] = (s, int(run[row]))
        return out


def scan(index: Index, column: pa.Array) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
    """(row, matches) of each row of a batch that matches an item."""
    if not index.ids:
        return
    for first, _, raw, off in text_steps(column):
        words, begin = word_hashes(raw, off)
        shingles, start = shingle_hashes(words, begin, SHINGLE)
        at = index.anchors(shingles)
        text = np.searchsorted(start, at, "right") - 1
        for t in np.unique(text).tolist():
            a, b = int(start[t]), int(start[t + 1])
            got = index.matches(shingles[a:b], int(begin[t + 1] - begin[t]), at[text == t] - a)
            if got:
                yield first + t, got


def indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """An index for each block of items, and whether it is the last; a block's text is bounded."""
    items = benchmark.filter("text IS NOT NULL").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield Index(sorted(((r[0], r[1]) for r in rows), key=str)), k == blocks - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, word (the best window's first), n_words, similarity of each row of docs and item that match."""
    spark = docs.sparkSession
    prepare(spark)
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, word long, n_words long, similarity double"
    out = spark.createDataFrame([], types)
    for index, last in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                rows = [(row, own.ids[k], word, own.words[k], s) for row, got in scan(own, batch.column("text")) for k, (s, word) in sorted(got.items())]
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[j] for r in rows], t) for j, t in ((1, None if rows else pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], ["doc_id", "item_id", "word", "n_words", "similarity"])

        found = docs.select("doc_id", "text").mapInArrow(run, types)
        if not last:  # the next index comes when this one is gone
            found = cut(found)
            shared.destroy()
        out = out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no item, with all their columns."""
    prepare(docs.sparkSession)
    before = None
    for index, last in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in scan(shared.value, batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = cut(docs)
            shared.destroy()
            if before is not None:
                discard(before)
            before = docs
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
