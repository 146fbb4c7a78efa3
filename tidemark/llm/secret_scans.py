"""Secret scans, in DataFrame functions only.

Base patterns are found in whole texts. Besides them, weaker parts of a credential (an access identifier, a long
random-looking token, an endpoint) are candidates; such a part is reported only when complementary parts stand within
the same scope, a stretch of the document around it. Parts meet by an interval join on (document, block of scope
length), with each part entered in its own and the neighbouring blocks. Parts of a kind don't overlap and have a least
length, so a block holds a bounded number of them, and no document, however full of secrets, gives all pairs.

Positions are code points: the gaps between matches and the matches themselves, summed up in order.

Defined results: null and empty texts have no spans; rows with a null or repeated doc_id are scanned row by row; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Base kinds in the order of their listing: pattern, least length, the group that the length is of.
BASE = {"assign": (ASSIGN, 12, 2), "access": ("AKIA[A-Z0-9]+", 18, 0), "hex": ("[0-9a-f]{16,}", 16, 0)}
#: Parts that are weak alone: pattern and the words without which a text needn't be searched.
WEAK = {
    "identifier": "(?:(?i:access_?key_?id|client_?id|user_?name|login|account))[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{4,}|(?:ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,}",
    "opaque": "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{32,}",
    "endpoint": "(?<![A-Za-z0-9])(?:https?|s3|jdbc|postgres|mysql|redis|amqp|mongodb)://[^\\x20\\x09-\\x0D\"'<>]{4,}",
}
ORDER = [*BASE, *WEAK]
#: What a part is in a credential.
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
SCOPE = 300


def _hint(kind: str):
    """A cheap test without which the pattern can't match."""
    text, low = F.col("text"), F.lower("text")
    if kind == "assign":
        return low.rlike("passw(?:or)?d|secret|token|api_?key")
    if kind == "access":
        return text.contains("AKIA")
    if kind == "endpoint":
        return text.contains("://")
    if kind == "identifier":
        named = [low.contains(x) for x in ("key", "client", "user", "login", "account")]
        return reduce(or_, [*named, *(text.contains(x) for x in ("ASIA", "AGPA", "AIDA", "AROA"))])
    if kind == "opaque":
        return text.rlike("[A-Za-z0-9+/_-]{32}")
    return F.lit(True)


def find_parts(docs: DataFrame, *kept: str) -> DataFrame:
    """kept columns and, for each kind, an array of (gap, length, good) in order; one pass over the texts."""
    patterns = {k: p for k, (p, _, _) in BASE.items()} | WEAK
    rows = docs.select(*kept, F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.select(*kept, "text", *(F.when(_hint(k), F.regexp_extract_all("text", F.lit(p), 0)).otherwise(none).alias(k) for k, p in patterns.items()))

    def parts(kind: str):
        gaps = F.when(F.size(kind) > 0, F.split("text", patterns[kind], -1)).otherwise(none)
        least, group = BASE[kind][1:] if kind in BASE else (0, 0)
        size = lambda m: F.length(F.regexp_extract(m, patterns[kind], group)) if group else F.length(m)
        each = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(kind), F.lit(0))), kind, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), (size(m) >= least).alias("good")))
        return each.alias(kind)

    return rows.select(*kept, *map(parts, patterns))


def spans_of(found: DataFrame, key: str) -> DataFrame:
    """key, kind, start, end of all good parts."""
    each = [found.select(key, F.lit(k).alias("kind"), F.posexplode(k).alias("i", "p")) for k in ORDER]
    rows = each[0]
    for x in each[1:]:
        rows = rows.unionByName(x)
    before = Window.partitionBy(key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("p.gap") + F.col("p.len")).over(before)
    rows = rows.select(key, "kind", "p.good", (end - F.col("p.len")).alias("start"), end.alias("end"))
    return rows.filter("good").drop("good")


def link_parts(spans: DataFrame, key: str, scope: int = SCOPE) -> DataFrame:
    """The spans that are reported: base kinds, and weak parts with complementary ones within scope."""
    role = F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair))
    spans = spans.withColumn("role", role[F.col("kind")])
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = spans.filter(F.col("kind").isin(*WEAK))
    near = weak.withColumn("block", blocks(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    other = spans.select(key, F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), blocks(F.col("start"), F.col("end")).alias("block"))
    met = near.join(other, [key, "block"]).filter((F.col("role") != F.col("o_role")) & (F.col("o_start") < F.col("end") + scope) & (F.col("o_end") > F.col("start") - scope))
    roles = met.groupBy(key, "kind", "role", "start", "end").agg(*(F.max(F.col("o_role") == r).alias(r) for r in ("secret", "identifier", "endpoint")))
    whole = F.when(F.col("role") == "endpoint", F.col("secret") & F.col("identifier")).when(F.col("role") == "secret", F.col("identifier") | F.col("endpoint")).otherwise(F.col("secret"))
    base = spans.filter(F.col("kind").isin(*BASE))
    # An opaque token that a base span covers is that span.
    over = base.select(key, F.col("start").alias("b_start"), F.col("end").alias("b_end"), blocks(F.col("start"), F.col("end")).alias("block"))
    linked = roles.filter(whole).select(key, "kind", "start", "end", F.floor(F.col("start") / scope).alias("block"))
    linked = linked.join(over, (linked[key] == over[key]) & (linked["block"] == over["block"]) & (over["b_start"] < linked["end"]) & (linked["start"] < over["b_end"]), "left_anti")
    return base.select(key, "kind", "start", "end").unionByName(linked.drop("block"))


def scan_secrets(docs: DataFrame, *kept: str) -> DataFrame:
    """kept columns, and spans: an array of (start, rank, kind, end) in order, for each row of docs (text)."""
    found = cut(find_parts(docs.withColumn("_rid", F.monotonically_increasing_id()), "_rid", *kept))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    linked = link_parts(spans_of(found, "_rid"), "_rid")
    spans = linked.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    return found.select("_rid", *kept).join(spans, "_rid", "left").drop("_rid").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] <= len(BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
