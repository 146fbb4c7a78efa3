"""Exact set-similarity join on word shingles, by partitioning the universe of shingles.

Two sets of r and s shingles with Jaccard similarity of at least 0.8 differ in at most D = (r + s) // 9 shingles. Sizes
fall into bands, and for each band a hash deals all shingles out to segments: ``plain`` ones, in which a pair may differ
in nothing, and ``loose`` ones, in which it may differ in one shingle. A plain segment that differs costs one of D, a
loose one two, so with a total weight over D some segment must match. Each set is indexed by the content of its
segments and, for loose ones, by all contents with one shingle deleted. A set also probes the band below its own.

The allocation is by cost. Extra weight (``slack``) above D + 1 lets each set leave out its costliest segments: empty
ones first, then those whose content is most frequent. What two sets share then still holds a segment that neither
left out, since both rank contents alike. How much slack, and how many loose segments, a band gets is what makes the
fewest index entries and the fewest uninformative ones.

Sets that meet are not expanded into pairs. Of those that share a content, the first is the hub and the others are
compared with it; verified links are joined into components; contents that still join different components have their
most central members compared with the others, and only what then is left is looked at pair by pair. Comparisons are exact, on the shingles of the texts themselves; a count sketch of 256 cells
(whose differences never exceed those of the sets) spares most vain ones.

Shingles are compared by 64-bit hashes, and equal sets are one class by a 64-bit digest. Nothing that grows with the documents
comes to the driver, and each table that a step writes goes as soon as the next one has read it.

Defined results: texts without words have 0 shingles and no links; fewer than five words are one shingle; rows with a
null doc_id have a null component; rows that share a doc_id are one node, linked as any of them is; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, is_empty, mix64, prepare, shingle_hashes, tasks_for, text_steps, tidy, word_hashes
from tidemark.llm.components import components

SHINGLE = 5
CELLS, COARSE = 256, 64
#: Documents and index entries that are dealt out at once.
FLUSH_DOCS, FLUSH_ENTRIES = 1 << 13, 1 << 19
#: Classes that a task remembers to have sketched.
FLUSH_SEEN = 1 << 18
#: Index entries for one task, about.
TASK_ENTRIES = 1 << 21
#: A content that more documents of one batch share than this goes on with one of them; the others are kept aside.
LOCAL_HOT = 16
#: A content that more sets share than this may be left out, where slack allows.
HOT = 64
#: Members of one content that a block of a tile holds, about.
TILE = 1 << 12
#: Rounds in which the central members of open contents are tried, before all pairs that are left.
HUB_ROUNDS = 3
#: Comparisons with one hub in one task, about.
HUB_SHARE = 256
_S = [np.uint64(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xE7037ED1A0B428DB)]


class Band:
    """Sizes lo to hi, and how their universe is dealt out."""

    def __init__(self, number: int, lo: int, hi: int):
        self.number, self.lo, self.hi = number, lo, hi
        self.reach = hi * 5 // 4  # the largest set that may link with one of this band
        self.differ = (hi + self.reach) // 9
        best = None
        for loose in range(min(8, (self.differ + 1) // 2) + 1):
            slack = 0
            for _ in range(50):  # more slack makes more and smaller segments, so more of them are weak
                plain = self.differ + 1 + slack - 2 * loose
                each = 0.9 * hi / (plain + loose)
                empty = math.exp(-each) if plain + loose > 1 else 0.0
                weak = empty * (plain + 2 * loose * (1 + each))
                # A set whose weak segments outweigh the slack must be found by them: dear, so it has to be rare.
                wanted = min(math.ceil(weak + 3 * math.sqrt(2 * weak) - 1e-9), self.differ + 3)
                if wanted <= slack:
                    break
                slack = wanted
            cost = plain + loose * (1 + each) + 2 * (plain + loose) * empty * (1 + each)
            if best is None or cost < best[0]:
                best = cost, plain, loose, slack
        _, self.plain, self.loose, self.slack = best


@lru_cache(maxsize=1)
def bands() -> list[Band]:
    out, lo = [], 1
    while lo < 1 << 34:
        top = max(lo + 1, -(-lo * 5 // 4))
        out.append(Band(len(out), lo, top - 1))
        lo = top
    return out


def _sets(column: pa.Array):
    """Yields (first row, end row, list of each row's distinct shingle hashes, sorted)."""
    for first, end, raw, off in text_steps(column):
        hashes, begin = shingle_hashes(*word_hashes(raw, off), SHINGLE)
        yield first, end, [np.unique(hashes[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _digest(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed number."""
    x = mix64(shingles ^ _S[0]).sum(dtype=np.uint64) ^ mix64(np.array([len(shingles)], np.uint64) ^ _S[1])[0]
    return int(mix64(np.array([x], np.uint64))[0].view(np.int64))


def _sketch(shingles: np.ndarray) -> bytes:
    return np.bincount(shingles & np.uint64(CELLS - 1), minlength=CELLS).clip(max=0xFF).astype(np.uint8).tobytes()


def _sketches(column) -> np.ndarray:
    """Rows of cells of a column of sketches."""
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), CELLS).astype(np.int32)


def set_classes(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, cls (null for an empty set), sketch of each row of docs (doc_id, th, text).

    A set that a task has met lately isn't sketched again: some row (with a doc_id) of each class has a sketch, copies
    mostly don't.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            n, cls, sketch, named = [], [], [], batch.column("doc_id").is_valid().to_pylist()
            for _, _, sets in _sets(batch.column("text")):
                for s in sets:
                    c = _digest(s) if len(s) else None
                    new = c is not None and c not in seen and named[len(n)]
                    n.append(len(s))
                    cls.append(c)
                    sketch.append(_sketch(s) if new else None)
                    if new:
                        seen.add(c)
            if len(seen) > FLUSH_SEEN:
                seen.clear()
            arrays = [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "n_shingles", "cls", "sketch"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {id_type}, th long, n_shingles long, cls long, sketch binary")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    b = bands()
    return tuple(np.array([getattr(x, name) for x in b], np.int64) for name in ("lo", "plain", "loose", "slack", "reach"))


def entries(sets: list[np.ndarray], role: int) -> tuple[np.ndarray, ...]:
    """Index entries of sets in their own band (role 0) or as probes in the band below (role 1).

    Returns key, set number, weight of each entry, and the slack that each set has left.
    """
    lo, plain, loose, slack, reach = _tables()
    size = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(lo, size, "right") - 1 - role
    use = np.flatnonzero((band >= 0) & (size > 0) & (size <= reach[np.maximum(band, 0)]))
    left = np.zeros(len(sets), np.int64)
    if not len(use):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), left
    band, size = band[use], size[use]
    tokens = np.concatenate([sets[k] for k in use])
    owner = np.repeat(np.arange(len(use)), size)
    segments = plain[band] + loose[band]
    base = np.cumsum(segments) - segments
    place = ((mix64(tokens ^ _S[2]) >> np.uint64(32)) * segments[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    at = base[owner] + place
    total = int(segments.sum())
    value = mix64(tokens ^ _S[3])
    low = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
    high = np.bincount(at, (value >> np.uint64(32)).astype(float), total).astype(np.uint64)
    content = low + (high << np.uint64(32))
    count = np.bincount(at, minlength=total)
    of = np.repeat(np.arange(len(use)), segments)
    number = np.arange(total) - base[of]
    salt = mix64((band[of].astype(np.uint64) << np.uint64(40)) | number.astype(np.uint64))
    is_loose = number < loose[band][of]
    full = np.flatnonzero(count)
    # One shingle deleted, in loose segments; what leaves an empty one is weak, like an empty segment.
    cut_at = np.flatnonzero((place < loose[band][owner]) & (count[at] > 1))
    keys = [mix64(content[full] ^ salt[full]), mix64((content[at[cut_at]] - value[cut_at]) ^ salt[at[cut_at]])]
    sets_of = [of[full], owner[cut_at]]
    weights = [1 + is_loose[full], np.full(len(cut_at), 2)]
    weak = np.where(is_loose, 2 * (count <= 1), count == 0)
    spent = np.bincount(of, weak, len(use)).astype(np.int64)
    over = np.flatnonzero(spent > slack[band])
    for k in over:  # rare by the choice of slack
        own = np.arange(base[k], base[k] + segments[k])
        own = own[weak[own] > 0][::-1]
        kept = own[np.cumsum(weak[own]) > slack[band[k]]]
        keys.append(mix64(salt[kept]))
        sets_of.append(np.full(len(kept), k))
        weights.append(weak[kept])
    left[use] = np.maximum(slack[band] - spent, 0)
    return np.concatenate(keys), use[np.concatenate(sets_of)], np.concatenate(weights).astype(np.int64), left


def _pack(keys, owners, cls, left0, left1) -> bytes:
    """Entries as bytes: owners are number << 3 | hot << 2 | (weight - 1) << 1 | role."""
    head = np.array([len(keys), len(cls)], "<u4")
    return b"".join((head.tobytes(), cls.astype("<i8").tobytes(), left0.astype(np.uint8).tobytes(), left1.astype(np.uint8).tobytes(), keys.astype("<u8").tobytes(), owners.astype("<u2").tobytes()))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """key, cls, bits (hot, weight, role), slack left of each entry."""
    n, m = np.frombuffer(blob, "<u4", 2).tolist()
    cls = np.frombuffer(blob, "<i8", m, 8)
    left = np.frombuffer(blob, np.uint8, 2 * m, 8 + 8 * m).reshape(2, m)
    keys = np.frombuffer(blob, "<u8", n, 8 + 10 * m)
    owners = np.frombuffer(blob, "<u2", n, 8 + 10 * m + 8 * n)
    who, bits = owners >> 3, (owners & 7).astype(np.uint8)
    return keys, cls[who], bits, left[bits & 1, who]


def _deal(docs: DataFrame, tasks: int) -> DataFrame:
    """kind, task, blob: index entries of all rows, sorted by key and dealt out by it; kind 1 are hot ones kept aside."""

    def flush(sets, cls):
        got = [entries(sets, role) for role in (0, 1)]
        keys = np.concatenate([g[0] for g in got])
        owners = np.concatenate([(g[1] << 3) | (g[2] - 1) << 1 | role for role, g in enumerate(got)])
        left = [np.minimum(g[3], 255) for g in got]
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        hot = np.repeat(size > LOCAL_HOT, size)
        if hot.any():
            first = np.zeros(len(keys), bool)
            first[start] = True
            # Own entries come before probes: the sort is stable and they stand first.
            aside = np.flatnonzero(hot)
            yield 1, int(keys[aside[0]] % np.uint64(tasks)), _pack(keys[aside], owners[aside] | 4, cls, *left)
            keep = np.flatnonzero(~hot | first)
            owners = np.where(hot, owners | 4, owners)[keep]
            keys = keys[keep]
        task = (keys >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)
        edge = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(keys) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True):
            who, own = np.unique(owners[a:b] >> 3, return_inverse=True)
            yield 0, int(task[a]), _pack(keys[a:b], (own << 3) | (owners[a:b] & 7), cls[who], left[0][who], left[1][who])

    def run(batches):
        sets, cls, seen, held = [], [], set(), 0

        def out():
            rows = list(flush(sets, np.array(cls, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "task", "blob"])

        for batch in batches:
            for _, _, found in _sets(batch.column("text")):
                for s in found:
                    if len(s) and (c := _digest(s)) not in seen:
                        seen.add(c)
                        sets.append(s)
                        cls.append(c)
                        held += len(s)
                    if held > FLUSH_ENTRIES or len(sets) >= FLUSH_DOCS:
                        yield out()
                        sets, cls, seen, held = [], [], set(), 0
        if sets:
            yield out()

    return docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(run, "kind int, task int, blob binary")


def _stars(keys, cls, bits, left):
    """Of entries of one task: pairs (hub, member), and the members of contents that need a second look."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    keep = np.zeros(len(k), bool)
    keep[1:] = same
    keep[:-1] |= same
    order = order[keep | (bits[order] & 4 > 0)]
    keys, cls, bits, left = keys[order], cls[order], bits[order], left[order]
    order = np.lexsort((cls, bits & 1, keys))
    keys, cls, bits, left = keys[order], cls[order], bits[order], left[order]
    if not len(keys):
        return None
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1]) | ((bits[1:] & 1) != (bits[:-1] & 1))]
    # Copies of one set from several batches; a hot mark on any of them counts.
    hot = np.bitwise_or.reduceat(bits, np.flatnonzero(fresh)) & 4
    keys, cls, bits, left = keys[fresh], cls[fresh], bits[fresh] | hot.astype(np.uint8), left[fresh]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.append(start, len(keys)))
    hub, has = np.repeat(cls[start], size), np.repeat(bits[start] & 1 == 0, size)
    pair = has & (hub != cls)
    pairs = np.unique(np.stack([hub[pair], cls[pair]], 1), axis=0) if pair.any() else np.zeros((0, 2), np.int64)
    again = np.repeat((size > 2) | (np.bitwise_or.reduceat(bits, start) & 4 > 0), size)
    return pairs, keys[again].view(np.int64), cls[again], bits[again], left[again]


def _meet(dealt: DataFrame, tasks: int) -> DataFrame:
    """kind, a, b, bits, slack: candidate pairs (kind 0: hub, member) and members of contents (kind 1: key, cls)."""
    names = ["kind", "a", "b", "bits", "slack"]

    def rows(kind, a, b, bits, left):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.asarray(bits, np.int32)), pa.array(np.asarray(left, np.int32))], names)

    def out(parts):
        if not parts:
            return
        got = _stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        if got is not None:
            pairs, *members = got
            zero = np.zeros(len(pairs), np.int32)
            yield rows(0, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), zero, zero)
            yield rows(1, *members)

    def run(batches):
        task, parts = None, []
        for batch in batches:
            for kind, t, blob in zip(*(batch.column(c) for c in ("kind", "task", "blob")), strict=True):
                got = _unpack(blob.as_buffer().to_pybytes())
                if kind.as_py():  # kept aside by one batch: nothing to wait for
                    yield from out([got])
                    continue
                if t.as_py() != task:
                    yield from out(parts)
                    task, parts = t.as_py(), []
                parts.append(got)
        yield from out(parts)

    placed = dealt.repartition(tasks, "task").sortWithinPartitions("task", "kind")
    return placed.mapInArrow(run, "kind int, a long, b long, bits int, slack int")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sizes and sketches allow a link."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b)")

    def run(batches):
        for batch in batches:
            s = [_sketches(batch.column(c)) for c in ("s_a", "s_b")]
            most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) // 9
            yield batch.filter(pa.array(np.abs(s[0] - s[1]).sum(1) <= most)).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def class_texts(docs: DataFrame, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """node, text: one text of each class among candidates (node). Texts are dealt out once here, not for each comparison."""
    reps = candidates.distinct().join(classes.select(F.col("cls").alias("node"), "rep.*"), "node")
    # Repeated rows are one before they are dealt out.
    return docs.groupBy("doc_id", "th").agg(F.first("text").alias("text")).join(reps, ["doc_id", "th"]).select("node", "text")


def verify(pairs: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """Of pairs (a, b), those with similarity of at least 0.8: each hub's text meets its members' texts, one by one."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("shares"))
    members = pairs.join(shares, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"), F.col("b").alias("node"))
    hubs = shares.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), F.col("a").alias("node"))
    met = hubs.unionByName(members).join(texts, "node")

    def run(batches):
        hub, own = None, None
        for batch in batches:
            hubs, roles, nodes = (batch.column(c).to_pylist() for c in ("hub", "role", "node"))
            a, b = [], []
            for first, _, sets in _sets(batch.column("text")):
                for k, s in enumerate(sets, first):
                    if roles[k] == 0:
                        hub, own = hubs[k], s
                    elif hub == hubs[k]:
                        both = np.searchsorted(own, s)
                        both[both == len(own)] = 0
                        n = int((own[both] == s).sum())
                        if 100 * n >= 80 * (len(own) + len(s) - n):
                            a.append(hub)
                            b.append(nodes[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    placed = met.repartition(tasks, "hub", "share").sortWithinPartitions("hub", "share", "role")
    return placed.mapInArrow(run, "a long, b long").distinct()


def _members(met: DataFrame) -> DataFrame:
    """key, cls, role, weight, slack: members of contents that more than a pair shares."""
    weight = (1 + F.call_function("shiftright", F.col("bits"), F.lit(1)).bitwiseAND(1)).alias("weight")
    return met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cls"), F.col("bits").bitwiseAND(1).alias("role"), weight, "slack").distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with label and n (how many share the content), of contents that still join different components."""
    rows = members.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"), F.min("role").alias("r"))
    return rows.join(keys.filter("x <> y AND r = 0").select("key", "n"), "key")


def _hub_pairs(still: DataFrame) -> DataFrame:
    """a, b: of each open content, the most central member against those of other components.

    A set that shares much with many (the text that others are edits of) is central, and most likely to link with all.
    """
    central = still.join(still.groupBy("cls").agg(F.sum("n").alias("shared")), "cls")
    hubs = central.filter("role = 0").groupBy("key").agg(F.max(F.struct("shared", "cls", "label")).alias("hub"))
    met = still.join(hubs, "key").filter("label <> hub.label")
    return met.select(F.least("hub.cls", "cls").alias("a"), F.greatest("hub.cls", "cls").alias("b")).distinct()


def _tile_pairs(cls, role, label, size, sketch, block):
    """Pairs (a, b) of one tile that sizes and sketches allow, of different components, one of them in its own band."""
    out = []
    coarse = sketch.reshape(len(cls), CELLS // COARSE, COARSE).sum(1)
    split = len(np.unique(block)) > 1
    for i in range(len(cls) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[(role[j] == 0) | (role[i] == 0)]
        if split:
            j = j[block[j] != block[i]]
        j = j[100 * np.minimum(size[i], size[j]) >= 80 * np.maximum(size[i], size[j])]
        most = (size[i] + size[j]) // 9
        near = np.abs(coarse[j] - coarse[i]).sum(1) <= most
        j, most = j[near], most[near]
        j = j[np.abs(sketch[j] - sketch[i]).sum(1) <= most]
        if len(j):
            out.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], 1))
    return out


def _all_pairs(still: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """a, b: members of different components that share a content which neither may leave out, near enough by sketch.

    Members of a content meet in tiles of two blocks, of a bounded number each; only what may be a link leaves a tile.
    """
    costly_first = Window.partitionBy("cls", "role").orderBy(F.desc("n"), F.desc("key"))
    still = still.withColumn("spent", F.sum("weight").over(costly_first)).filter((F.col("n") <= HOT) | (F.col("spent") > F.col("slack")))
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    rows = still.join(classes.select("cls", F.col("n").alias("size"), "sketch"), "cls").withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    tiles = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    rows = rows.select("key", "cls", "role", "label", "size", "sketch", "block", tiles)
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cls", "role", "label", "size", "sketch", "block")

    def run(batches):
        held, at = [], None

        def out(parts):
            pairs = _tile_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)

        for batch in batches:
            tile = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], 1)
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("cls", "role", "label", "size", "block")]
            sketch = _sketches(batch.column("sketch"))
            cuts = [0, *(np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            made = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if at is not None and tuple(tile[a]) != at:
                    made.append(out(held))
                    held = []
                at = tuple(tile[a])
                c, r, l, z, k = (x[a:b] for x in columns)
                held.append((c, r, l, z, sketch[a:b], k))
            if made:
                yield rows_of(made)
        if held:
            yield rows_of([out(held)])

    def rows_of(made):
        pairs = np.unique(np.concatenate(made), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    placed = rows.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return placed.mapInArrow(run, "a long, b long").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, tasks: int) -> list[DataFrame]:
    """Tables (a, b) of enough links between classes (cls, n, sketch, rep) to join all that are linked.

    First each set meets one hub; then the other hubs of other components; then, while that finds links, the most
    central member of each open content; last, whatever pairs of different components an open content still holds.
    """
    met = cut(_meet(_deal(docs, tasks), tasks))
    sort = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = cut(_near(sort(met.filter("kind = 0")), classes))
    members = cut(_members(met))
    discard(met)
    texts = cut(class_texts(docs, classes, stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).unionByName(members.select(F.col("cls").alias("node")))))
    tried = [cut(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))]
    links = [cut(verify(tried[0], texts, tasks))]
    found = True
    for step in ("stars", *["hubs"] * HUB_ROUNDS, "all"):
        if step == "hubs" and not found:
            continue
        labels = components(_union(links))
        side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))  # noqa: B023, E731
        spent = [labels]
        if step == "stars":
            pairs = stars.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
            spent.append(stars)
        else:
            still = cut(_open(members, labels))
            pairs = _near(_hub_pairs(still), classes) if step == "hubs" else _all_pairs(still, classes, tasks)
            spent.append(still)
        more = cut(pairs.join(_union(tried), ["a", "b"], "left_anti"))
        found = False
        if not is_empty(more):
            new = cut(verify(more, texts, tasks))
            found = not is_empty(new)
            tried.append(more)
            links.append(new)
        else:
            spent.append(more)
        discard(*spent)
    discard(texts, members, *tried)
    return links


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (doc_id, th, n_shingles, cls), classes (cls, rep, n) and tables of links (a, b) between classes, all cut.

    A class is a set of shingles, th a hash of the text, rep the class's least (doc_id, th).
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    sets = cut(set_classes(docs))
    named = sets.filter("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")))
    with tidy(spark):
        total = classes.agg(F.sum("n")).head()[0] or 0
    tasks = max(tasks_for(docs), math.ceil(0.7 * total / TASK_ENTRIES))
    return sets, classes, link_classes(docs, classes, tasks)


def join_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    sets, classes, links = classed(docs)
    # Rows that share a doc_id tie their classes together.
    named = sets.filter("cls IS NOT NULL AND doc_id IS NOT NULL")
    shared = named.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a <> z")
    tied = named.join(shared.select("doc_id", "a"), "doc_id").select("a", F.col("cls").alias("b")).filter("a <> b")
    labels = components(_union(links).unionByName(tied))
    least = _least_of_components(classes.withColumn("rep", F.col("rep.doc_id")), labels)
    of = cut(least.select("cls", F.col("least").alias("component_id")))
    discard(labels, classes, *links)
    out = sets.select("doc_id", "n_shingles", "cls").join(of, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _least_of_components(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """cls, rep, least: the least rep of the class's component."""
    named = classes.select("cls", "rep").join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    return named.join(named.groupBy("label").agg(F.min("rep").alias("least")), "label")


def representatives(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text): of each group of near duplicates the row of the least (doc_id, th).

    Groups are of texts: rows that share a doc_id and nothing else are not one. Rows without words or doc_id have none.
    """
    sets, classes, links = classed(docs)
    labels = components(_union(links))
    stay = cut(_least_of_components(classes, labels).filter("rep = least").select("rep.*"))
    discard(sets, classes, labels, *links)
    return stay


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
