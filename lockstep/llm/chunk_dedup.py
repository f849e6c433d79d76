"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text is cut behind a white-space byte where the gear hash of the last 16 bytes is the least among the places less than
MIN_CHUNK bytes away; a stretch of MAX_CHUNK bytes without a cut is cut there (at a character boundary).  Characters of
three bytes or more (Chinese, Japanese, Thai) are places too, as are all characters of a stretch of over LONG bytes
without a place, so that texts without white space are cut by content as well.  Cuts depend on the bytes around them
only, so that an insertion shifts them without changing the chunks behind it, and long gaps between minima are far rarer
than between small hashes.  Chunks are compared by 128-bit digest; a chunk is repeated if at least two documents have
it.  A run of adjacent repeated chunks of at least MIN_WORDS words is a repeated passage.  The ends of a passage up to
the next cut are not seen; MIN_WORDS is so far below 50 that passages of over 50 words are found nevertheless.

Scale.  What is shuffled is one narrow row a chunk, combined map-side, never text.  A passage of any number of
documents is one group of two longs; occurrences are compared to the group, never to each other.

Cases.  Null and empty texts have no chunks.  Null and repeated doc_ids are documents of their own.  A passage that
repeats only within one document is not reported.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, packed, slices, stored, table, unpacked

MIN_CHUNK, MAX_CHUNK = 18, 512
LONG = 64
MIN_WORDS = 16
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 32 bytes: what a rolling h = (h << 1) + GEAR[b] holds in 32
    bits, for all places at once by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    if not data:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    inner = (raw & 0xC0) == 0x80
    ends = np.append(~inner[1:], True)  # of characters
    place = SPACE[raw]
    place[2:] |= ends[2:] & inner[2:] & inner[1:-1]
    known = np.concatenate(([0], np.flatnonzero(place) + 1, [len(raw)]))
    for i in np.flatnonzero(np.diff(known) > LONG).tolist():
        place[known[i] : known[i + 1]] = ends[known[i] : known[i + 1]]
    at = np.flatnonzero(place)
    value, least = (gear(raw) << np.uint32(16))[at], np.ones(len(at), dtype=bool)
    for k in range(1, MIN_CHUNK):
        near = at[k:] - at[:-k] < MIN_CHUNK
        if not near.any():
            break
        least[k:] &= ~near | (value[k:] <= value[:-k])
        least[:-k] &= ~near | (value[:-k] <= value[k:])
    places = at[least] + 1
    out, last = [], 0
    for p in [*places.tolist(), len(data)]:
        while p - last > MAX_CHUNK:
            end = last + MAX_CHUNK
            while end > last + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(end)
            last = end
        if p - last >= MIN_CHUNK or p == len(data) > last:
            out.append(p)
            last = p
    return out


def word_count(piece: bytes) -> int:
    """Words at white space; of eight or more characters of three bytes in a word, two count as one."""
    tokens = piece.split()
    if piece.isascii():
        return len(tokens)
    return sum(max(1, wide // 2 if (wide := sum(b >= 0xE0 for b in t)) >= 8 else 1) for t in tokens)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ats, sizes, words, digests = [], [], [], [], []
        for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text"), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            ends = cuts(data)
            starts = [0, *ends[:-1]] if ends else []
            ids += [uid] * len(ends)
            ats += starts
            for a, b in zip(starts, ends, strict=True):
                piece = data[a:b]
                sizes.append(b - a)
                words.append(word_count(piece))
                digests.append(xxhash.xxh3_128_digest(piece))
        both = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int32()), pa.array(words, pa.int32()), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))],
            ["uid", "at", "size", "words", "d0", "d1"],
        )


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each repeated passage of each document: doc_id, start (byte), n_bytes, n_words, n_chunks, first_doc_id
    (smallest doc_id that has one of its chunks), is_first (no smaller doc_id has any), repeats (start and n_bytes of
    the chunks that a smaller doc_id has).  A passage can be put together from passages of several first holders; each
    chunk is judged by itself, so that its first holder keeps it."""
    named = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text")
    chunks = stored(_with_ids(named), "chunks")  # from here on the uids are fixed
    shared = chunks.groupBy("d0", "d1").agg(F.min("uid").alias("u0"), F.max("uid").alias("u1"), F.min("doc_id").alias("first_doc_id")).where("u0 <> u1").drop("u0", "u1")
    narrow = chunks.select("d0", "d1", "uid", F.expr("shiftleft(at, 20) | shiftleft(size, 10) | words").alias("place"))  # narrow rows to shuffle
    ids = chunks.groupBy("uid").agg(F.first("doc_id").alias("doc_id"))  # a document has one; its chunks need not carry it through the join
    hits = join_hot(narrow, shared, ["d0", "d1"], "place").select("uid", "first_doc_id", F.expr("shiftright(place, 20)").alias("at"), F.expr("int(shiftright(place, 10) & 1023)").alias("size"), F.expr("int(place & 1023)").alias("words")).join(ids, "uid")
    order = Window.partitionBy("uid").orderBy("at")
    hits = hits.withColumn("starts", (F.col("at") != F.lag(F.col("at") + F.col("size"), 1, -1).over(order)).cast("int"))
    repeat = F.when(~F.col("doc_id").eqNullSafe(F.col("first_doc_id")), F.struct(F.col("at").alias("start"), F.col("size").alias("n_bytes")))
    runs = hits.withColumn("run", F.sum("starts").over(order)).groupBy("uid", "run").agg(
        F.min("doc_id").alias("doc_id"),
        F.min("at").alias("start"),
        F.sum("size").alias("n_bytes"),
        F.sum("words").alias("n_words"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("first_doc_id").alias("first_doc_id"),
        F.sort_array(F.collect_list(repeat)).alias("repeats"),
    )
    return runs.where(F.col("n_words") >= min_words).select("doc_id", "start", "n_bytes", "n_words", "n_chunks", "first_doc_id", (F.size("repeats") == 0).alias("is_first"), "repeats")


def _with_ids(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = next(_chunks(iter([batch])))
            at = np.searchsorted(batch.column("uid").to_numpy(), out.column("uid").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *out.columns], ["doc_id", *out.schema.names])

    return docs.mapInArrow(run, f"doc_id {kind}, uid long, at long, size int, words int, d0 long, d1 long")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (with unique doc_ids) without the repeated passages that a smaller doc_id has; all columns."""
    spans = passages(docs, min_words).where("not is_first").groupBy("doc_id").agg(F.flatten(F.collect_list("repeats")).alias("spans"))
    rows = packed(docs).withColumn("doc_id", F.col("row.doc_id")).join(spans, "doc_id", "left")

    @F.pandas_udf("string")
    def cut(texts, lists):
        out = []
        for text, spans in zip(texts, lists, strict=True):
            if text is not None and spans is not None:
                data, last, kept = text.encode("utf-8", "surrogatepass"), 0, []
                for s in sorted(spans, key=lambda s: s["start"]):
                    kept.append(data[last : s["start"]])
                    last = s["start"] + s["n_bytes"]
                text = b"".join([*kept, data[last:]]).decode("utf-8", "surrogatepass")
            out.append(text)
        return pd.Series(out, dtype=object)

    return unpacked(rows.select(F.col("row").withField("text", cut("row.text", "spans")).alias("row")))


def op6_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
