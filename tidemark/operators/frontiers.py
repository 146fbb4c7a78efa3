"""As-of lookups and LSN frontiers that don't need a join of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.events import BLOCK


def epoch_at(rows: DataFrame, changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (lsn) with as_of_epoch: the epoch of the last change at or before each (a backward as-of join).

    Both are merged block by block; a block starts with the last epoch before it, found from one row for each block.
    """
    both = rows.withColumn("_change", F.lit(None).cast("long")).unionByName(changes.select("lsn", F.col("epoch").alias("_change")), allowMissingColumns=True)
    both = both.withColumn("_block", F.expr(f"lsn div {block}"))
    ends = both.groupBy("_block").agg(F.max("_change").alias("_last"))
    before = F.max("_last").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    base = ends.select("_block", before.alias("_base"))
    own = F.last("_change", ignorenulls=True).over(Window.partitionBy("_block").orderBy("lsn", F.col("_change").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    out = both.join(base, "_block").withColumn("as_of_epoch", F.coalesce(own, "_base"))
    return out.filter("_change IS NULL").drop("_change", "_block", "_base")


def file_groups(files: DataFrame) -> DataFrame:
    """files with group_start: the least key of the transitive closure of overlapping key ranges, as islands."""
    order = Window.orderBy("first_k", "last_k", "file_id")  # over files, of which a manifest holds few
    reach = F.max("last_k").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = files.withColumn("_new", F.when(reach.isNull() | (F.col("first_k") > reach), F.col("first_k")))
    return rows.withColumn("group_start", F.last("_new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def first_reaching(ends: DataFrame, changes: DataFrame) -> DataFrame:
    """ends (end_epoch) with lsn: that of the first change whose epoch is at or beyond each, null if there is none yet.

    A row for each epoch and each end is all that is ordered.
    """
    both = changes.select(F.col("epoch").alias("_at"), "lsn", F.lit(None).cast("long").alias("end_epoch")).unionByName(ends.select(F.col("end_epoch").alias("_at"), F.lit(None).cast("long").alias("lsn"), "end_epoch"))
    least = F.min("lsn").over(Window.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("lsn", least).filter("end_epoch IS NOT NULL").select("end_epoch", "lsn")


def edit(manifest: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """A manifest without what is removed and with what is added; to remove what it doesn't hold raises."""
    names = manifest.columns
    missing = removed.join(manifest, names, "left_anti").agg(F.count("*")).scalar()
    kept = manifest.join(removed, names, "left_anti").unionByName(added)
    guard = F.when(missing > 0, F.raise_error(F.lit("what is removed isn't in the manifest")).cast("boolean")).otherwise(F.lit(True))
    return kept.filter(guard)


def _positions(key: str, bits: int, hashes: int):
    """Where a key's bits are in a filter of so many bits: two hashes, and steps from one by the other."""
    a, b = F.shiftright(F.xxhash64(key), 8), F.shiftright(F.xxhash64(F.lit(1), key), 8)  # so that sums stay within 64 bits
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda j: F.pmod(a + j.cast("long") * b, F.lit(bits).cast("long"))))


def bloom_bits(keys: DataFrame, key: str, per_key: int = 10, hashes: int = 7) -> DataFrame:
    """size, block, bits: the bits that are set in a bloom filter of keys, 64 to a row."""
    size = max(64, per_key * keys.count())
    at = keys.select(F.explode(_positions(key, size, hashes)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("block")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits"))
    return words.select(F.lit(size).cast("long").alias("size"), "block", "bits")


def bloom_probe(asked: DataFrame, filter_bits: DataFrame, key: str, hashes: int = 7) -> DataFrame:
    """key, may_contain: false only for keys that the filter wasn't built from."""
    size = filter_bits.agg(F.max("size")).head()[0] or 64
    at = asked.select(key, F.explode(_positions(key, size, hashes)).alias("at")).withColumn("block", F.expr("at div 64"))
    hit = F.coalesce(F.expr("bits & shiftleft(1L, int(at % 64))") != 0, F.lit(False))
    return at.join(filter_bits.select("block", "bits"), "block", "left").groupBy(key).agg(F.min(hit).alias("may_contain"))
