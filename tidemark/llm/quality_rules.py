"""Quality rules and cross-document line frequency, in DataFrame functions only.

Base rules are measured within each text. Then normalised lines are hashed, the documents of each host (the source
column) that hold a line are counted, lines over the limits are removed, and a document of which too little is left is
rejected. Copies of one page must not make its own lines boilerplate: besides the number of documents, a line's
documents must spread over several classes of length, which copies and near copies of one text never do, or they must
have more different contents than the limit, as pages of one length do. A content is told by a sketch, the least hashes
of windows of words. A document most of whose sketch no other one has is a content of its own; others share a content
if they agree in the least of the hashes that stand in about as many documents as most of their sketch does. So copies
count once and near copies a few times; so do pages of which over half is the same text, which can't be told from them.

Rows per line are pre-aggregated before they are dealt out by (host, line), so that a line in a third of all documents
is one row of each task. The lines over the limits are joined back by whatever join their checked size allows.

Defined results: a null or empty text has no words and fails the base rules; a null source is a host of its own; rows
with a null or repeated doc_id are judged row by row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, is_empty

SPACES = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: A line is removed for a host if more documents than this hold it...
MAX_DOCS = 20
#: ...of at least so many classes of length (a class is half a doubling), or of more than MAX_DOCS contents.
MIN_CLASSES = 5
#: Hashes of windows in a sketch, with repeats.
SKETCH = 16
MIN_WORDS = 20


def _windows(words: Column, n: Column) -> Column:
    """Hashes of all runs of WINDOW (a power of two) words, from those of runs half as long."""
    runs, size = words, 1
    while size < WINDOW:
        left = F.greatest(n - 2 * size + 1, F.lit(0))
        runs = F.zip_with(F.slice(runs, 1, left), F.slice(runs, size + 1, left), lambda x, y: F.xxhash64(x, y))
        size *= 2
    return F.when(n >= WINDOW, runs).otherwise(F.array().cast("array<long>"))


def base_metrics(docs: DataFrame, *kept: str) -> DataFrame:
    """kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line (hash, chars) pairs and sketch."""
    kept = list(kept)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*kept, text.alias("_text"), F.transform(F.array_remove(F.split(text, SPACES), ""), lambda w: F.xxhash64(w)).alias("_words"))
    has_word = lambda x: F.length(F.translate(x, _BLANKS, "")) > 0
    rows = rows.select(*kept, "_text", "_words", F.size("_words").alias("_n"), F.filter(F.split("_text", "\n"), has_word).alias("_lines"))
    rows = rows.select(*kept, "_text", "_n", "_lines", _windows(F.col("_words"), F.col("_n")).alias("_windows"))
    # Only texts with a repeated window are sorted to find where.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(*kept, "_text", "_n", "_lines", F.slice(F.sort_array("_windows"), 1, SKETCH).alias("sketch"), ordered.alias("_sorted"))
    s = F.col("_sorted")
    twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
    rows = rows.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    normal = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, SPACES, " "), "[0-9]+", "0")))
    rows = rows.select(
        *kept,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("h"), F.length(F.translate(x, _BLANKS, "")).alias("chars"))).alias("lines"),
        F.when(F.size("sketch") > 0, F.col("sketch")).otherwise(F.array(F.xxhash64("_lines"))).alias("sketch"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def contents(measured: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """host, sid (a sketch's hash) and content of all sketches. measured: host, sketch. tables gets what it cuts."""
    sketches = measured.groupBy("host", F.xxhash64("sketch").alias("sid")).agg(F.count("*").alias("docs"), F.first("sketch").alias("sketch"))
    values = cut(sketches.select("host", "sid", "docs", F.explode(F.array_distinct("sketch")).alias("v")))
    tables.append(values)
    shared = values.groupBy("host", "v").agg(F.sum("docs").alias("times")).filter("times > 1")
    size_class = F.coalesce(F.length(F.bin("times")), F.lit(0)).alias("size_class")  # 0: no other document has it
    classes = values.join(shared, ["host", "v"], "left").groupBy("host", "sid", size_class).agg(F.count("*").alias("n"), F.min("v").alias("v"))
    own, common = F.col("size_class") == 0, F.col("size_class") > 0
    found = classes.groupBy("host", "sid").agg(F.sum("n").alias("n"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own"), F.max(F.when(common, F.struct("n", "size_class", "v"))).alias("most"))
    return found.select("host", "sid", F.when(2 * F.col("own") >= F.col("n"), F.col("sid")).otherwise(F.col("most.v")).alias("content"))


def common_lines(measured: DataFrame, max_docs: int = MAX_DOCS, min_classes: int = MIN_CLASSES, tables: list[DataFrame] | None = None) -> DataFrame:
    """host, h, n_docs of lines over the limits. measured: host, n_words, lines, sketch. tables gets what it cuts."""
    tables = [] if tables is None else tables
    size_class = F.length(F.bin(F.col("n_words") * F.col("n_words"))) - 1  # twice the binary logarithm, rounded down
    each = measured.select("host", "sketch", F.call_function("shiftleft", F.lit(1).cast("long"), size_class).alias("bit"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counted = each.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.bit_count(F.bit_or("bit")).alias("classes"))
    counted = cut(counted.filter(F.col("n_docs") > max_docs))
    tables.append(counted)
    wide = counted.filter(F.col("classes") >= min_classes).select("host", "h", "n_docs")
    narrow = counted.filter(F.col("classes") < min_classes).select("host", "h", "n_docs")
    if is_empty(narrow):
        return wide
    held = cut(each.join(narrow, ["host", "h"]).select("host", "h", F.xxhash64("sketch").alias("sid")).distinct())
    tables.append(held)
    sketched = measured.withColumn("sid", F.xxhash64("sketch")).join(held.select("host", "sid").distinct(), ["host", "sid"], "left_semi")
    met = held.join(contents(sketched, tables), ["host", "sid"]).select("host", "h", "content").distinct()
    many = met.groupBy("host", "h").agg(F.count("*").alias("n_contents")).filter(F.col("n_contents") > max_docs)
    return wide.unionByName(narrow.join(many, ["host", "h"], "left_semi"))


def judge(docs: DataFrame, *kept: str, max_docs: int = MAX_DOCS, min_classes: int = MIN_CLASSES) -> DataFrame:
    """kept columns of each row of docs (text, source), its base metrics, chars left after line removal, and kept."""
    return judged(docs, *kept, max_docs=max_docs, min_classes=min_classes)[0]


def judged(docs: DataFrame, *kept: str, max_docs: int = MAX_DOCS, min_classes: int = MIN_CLASSES) -> tuple[DataFrame, list[DataFrame]]:
    """judge(), and the tables that it reads, to be discarded after it."""
    rows = docs.withColumn("_rid", F.monotonically_increasing_id())
    rows = rows.withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit("")))
    table, tables = cut(base_metrics(rows, "_rid", "_host", *kept)), []
    measured = table.withColumnRenamed("_host", "host")
    common = cut(common_lines(measured, max_docs, min_classes, tables))
    discard(*tables)
    lost = measured.select("_rid", "host", F.explode("lines").alias("line")).select("_rid", "host", F.col("line.h").alias("h"), F.col("line.chars").alias("chars"))
    lost = lost.join(common, ["host", "h"]).groupBy("_rid").agg(F.sum("chars").alias("lost"))
    left = F.col("word_chars") - F.coalesce("lost", F.lit(0))
    out = measured.drop("lines", "sketch", "host").join(lost, "_rid", "left").withColumn("chars_left", left).drop("_rid", "lost")
    # A word has about five characters: less than the least number of words, or under a tenth of the text, is depleted.
    depleted = (F.col("chars_left") < 5 * MIN_WORDS) & (F.col("chars_left") < F.col("word_chars")) | (10 * F.col("chars_left") < F.col("word_chars"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted), [table, common]


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Boilerplate hashes differ between engines, so the SQL compares normalised lines themselves.
OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times
  FROM (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8))),
r AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM w WHERE times > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, host, lines, len(words) AS n_words,
         length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM t LEFT JOIN r ON r.doc_id = t.doc_id),
l AS (
  SELECT doc_id, host, n_words,
         lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS h,
         length(translate(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS chars
  FROM (SELECT doc_id, host, n_words, unnest(lines) AS line FROM m)),
c AS (
  SELECT host, h FROM l GROUP BY host, h
  HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT length(bin(n_words * n_words))) >= 5),
x AS (SELECT doc_id, sum(chars) AS lost FROM l JOIN c USING (host, h) GROUP BY doc_id),
j AS (
  SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, word_chars - coalesce(lost, 0) AS chars_left
  FROM m LEFT JOIN x ON x.doc_id = m.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ((chars_left < 100 AND chars_left < word_chars) OR 10 * chars_left < word_chars) AS kept
FROM j
"""
