"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text longer than ``chunk`` code points is cut into overlapping chunks that any task may encode. Each chunk reports
where its pieces (the units the pre-tokenizer makes before merging) start inside the overlaps, with token counts from
there. A place at which two neighbouring chunks both start a piece is stable: what a piece holds depends on the text
from its start on and on a few code points after its end, never on what stands before. Counts are spliced there. Where
neighbours share no such place (a piece longer than the overlap), that text is encoded again with wider overlaps.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows with a null or repeated doc_id are counted each
for itself; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bytepieces import encoder
from tidemark.llm.common import cut, prepare

CHUNK = 1 << 15
OVERLAP = 512
#: Code points before a chunk's end at which its pieces are not trusted; an added token must be shorter.
GUARD = 64
#: Chunks of a text that leave a task together.
CHUNKS = 64


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (columns doc_id, text)."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    huge = F.length("text") > chunk

    def whole(batches):
        enc = encoder(path)
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            for first, end, _, places in enc.steps(batch.column("text")):
                count[first:end] = np.diff(places)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(count)], ["doc_id", "n_bytes", "n_tokens"])

    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    short = sized.filter(~huge).mapInArrow(whole, f"doc_id {id_type}, n_bytes long, n_tokens long")
    long = _spliced(sized.filter(huge).withColumn("rid", F.monotonically_increasing_id()), path, chunk, overlap)
    return short.unionByName(long.select("doc_id", "n_bytes", "n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def _spliced(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType.simpleString()
    known = None
    while True:
        made = _chunks(rows, path, chunk, overlap, id_type)
        done = cut(_splice(made))
        good = done.filter("whole")
        known = good if known is None else known.unionByName(good)
        if done.filter("not whole").isEmpty():
            return known
        again = done.filter("not whole").select("rid")
        rows, overlap = rows.join(again, "rid", "left_semi"), overlap * 8
        if overlap > chunk:
            chunk = overlap * 8  # ends with the whole text in one chunk


def _chunks(rows: DataFrame, path: str, chunk: int, overlap: int, id_type: str) -> DataFrame:
    """A row for each chunk: piece starts in its head and tail, with the tokens before each and in all."""
    kept = ["rid", "doc_id", "n_bytes"]

    def encode(batches):
        enc = encoder(path)
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                made = -(-len(text) // chunk)
                for a in range(0, made, CHUNKS):  # a text's chunks leave in groups of a bounded size
                    out = {k: [] for k in ("chunk", "last", "total", "head", "head_before", "tail", "tail_before")}
                    for k in range(a, min(a + CHUNKS, made)):
                        own = text[k * chunk : k * chunk + chunk + overlap]
                        start, before, total = piece_counts(enc, own)
                        head = start < overlap
                        tail = (start >= chunk) & (start < len(own) - GUARD)
                        found = (k, k * chunk + chunk + overlap >= len(text), total, start[head].tolist(), before[head].tolist(), (start[tail] - chunk).tolist(), before[tail].tolist())
                        for name, value in zip(out, found, strict=True):
                            out[name].append(value)
                    types = [pa.int32(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
                    same = pa.array([row] * len(out["chunk"]), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in kept), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], [*kept, *out])

    return rows.select(*kept, "text").mapInArrow(encode, f"rid long, doc_id {id_type}, n_bytes long, chunk int, last boolean, total long, head array<long>, head_before array<long>, tail array<long>, tail_before array<long>")


def _splice(chunks: DataFrame) -> DataFrame:
    """Sum the tokens between neighbouring common boundaries; whole says whether all were found.

    A text whose end lies in the overlap of the chunk before last has one chunk too many; that one is left out.
    """
    order = Window.partitionBy("rid").orderBy("chunk")
    first_last = F.min(F.when(F.col("last"), F.col("chunk"))).over(Window.partitionBy("rid"))
    kept = chunks.withColumn("end_chunk", first_last).filter("chunk <= end_chunk")
    at = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    kept = kept.withColumn("to", at).withColumn("from", F.lag("to").over(order))
    place = lambda where, value, x: F.element_at(value, F.array_position(where, F.col(x)).cast("int"))
    upto = F.when(F.col("last"), F.col("total")).otherwise(place("tail", "tail_before", "to"))
    since = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(place("head", "head_before", "from"))
    joined = (F.col("last") | F.col("to").isNotNull()) & ((F.col("chunk") == 0) | F.col("from").isNotNull())
    parts = kept.select("rid", "doc_id", "n_bytes", joined.alias("joined"), F.when(joined, upto - since).alias("n"))
    return parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"), F.min("joined").alias("whole"))


def piece_counts(enc, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Piece starts of a text, the tokens before each, and all tokens. Added tokens are pieces of their own."""
    if not enc.split:
        raise ValueError("overlap resynchronisation needs a byte-level pre-tokenizer")
    found = re.finditer("|".join(map(re.escape, enc.added)), text) if enc.added else ()
    cuts = [0, *(x for m in found for x in m.span()), len(text)]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    off = np.array(cuts, np.int64)
    begin = np.flatnonzero(enc.pieces(codes, off))
    added = off[1:-1:2]
    special = np.zeros(len(codes) + 1, bool)
    for a, b in zip(off[1:-1:2].tolist(), off[2:-1:2].tolist(), strict=True):
        special[a:b] = True
    begin = begin[~special[begin] | np.isin(begin, added)]
    stop = np.append(begin[1:], len(codes))
    plain = ~special[begin]
    count = np.ones(len(begin), np.int64)
    if plain.any():
        count[plain] = enc.counts(codes, begin[plain], stop[plain])
    total = np.cumsum(count)
    return begin, total - count, int(total[-1]) if len(total) else 0


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
