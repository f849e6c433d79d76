"""Exact deduplication by two-pass Bloom filtering (DataFrame functions only).

Pass 1 turns each text into two bit positions and keeps the positions that were hit at least twice: a Bloom filter
of the possibly repeated hashes.  Pass 2 probes that filter.  A row with a position that nobody else hit is certainly
unique and passes straight through; only the others are shuffled, by the full SHA-256.

Bounds.  A filter has 16 bits a row, at most MAX_BITS, stored as 4 KB bitmaps: the broadcast is 128 MB at most.  Beyond
2^30 / 16 rows the digests are cut into slices, each with a filter of its own: rows are written once by slice, without a
shuffle, and equal texts are in one slice, so that slices are decided one after the other, at full strength.  Copies learn their class by digest and salt, so that those of one text are
dealt over SALTS tasks.  What pass 1 shuffles are positions (two longs a row, combined map-side, so
that a hot text costs one row a task), never texts.

Cases.  A null text counts as empty.  Null doc_ids rank below all others.  Rows that repeat text and doc_id are all
marked `kept` by `classes` (they cannot be told apart); `keep_last` returns exactly one of them.  An empty table gives
an empty result.  Other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, new_path, packed, stored, table, unpacked

BITS_PER_ROW = 16
MIN_BITS = 1 << 15
MAX_BITS = 1 << 30
SALTS = 16


def digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def filter_bits(rows: int) -> int:
    bits = MIN_BITS
    while bits < min(MAX_BITS, rows * BITS_PER_ROW):
        bits *= 2
    return bits


def _positions(sha: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits)) for i in (1, 2)]


def repeat_filter(shas: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the positions that at least two rows of `sha` hit; at most bits / 32768 rows of 4 KB."""
    hit = shas.select(F.explode(F.array(*_positions(F.col("sha"), bits))).alias("p"))
    twice = hit.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return twice.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")
    )


def with_possible(df: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """df (with a column `sha`) and `possible`: false only if no other row has the same sha.  No shuffle: the filter is
    broadcast, and its size is bounded by MAX_BITS."""
    out = df
    for i, p in enumerate(_positions(F.col("sha"), bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"b{i}"), F.col("bitmap").alias(f"m{i}")))
        out = out.withColumn(f"p{i}", p)
        out = out.join(side, F.bitmap_bucket_number(f"p{i}") == F.col(f"b{i}"), "left")
    bit = []
    for i in range(2):
        at = F.bitmap_bit_position(f"p{i}")
        byte = F.conv(F.hex(F.substr(f"m{i}", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        set_ = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        bit.append(F.coalesce(set_, F.lit(False)))
    return out.withColumn("possible", bit[0] & bit[1]).drop("p0", "p1", "b0", "b1", "m0", "m1")


def by_slice(rows: DataFrame, decide) -> DataFrame:
    """decide(rows, bits) for rows with a column `sha`; slice by slice where one filter would be too large."""
    n = rows.count()
    slices = -(-n * BITS_PER_ROW // MAX_BITS)
    if slices <= 1:
        return decide(rows, filter_bits(n))
    path = new_path(rows.sparkSession, "op4-slices")
    rows.withColumn("slice of sha", F.pmod(F.xxhash64("sha", F.lit(3)), F.lit(slices))).write.partitionBy("slice of sha").parquet(path)
    found = []
    for k in range(slices):
        part = rows.sparkSession.read.parquet(path).where(F.col("slice of sha") == k).drop("slice of sha")
        found.append(stored(decide(part, filter_bits(part.count())), "op4-slice"))
    return reduce(DataFrame.unionByName, found)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of its class), group_size, kept, text_sha256."""
    shas = stored(docs.select("doc_id", digest(F.col("text")).alias("sha")), "op4-digests")
    return by_slice(shas, _classes).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _classes(shas: DataFrame, bits: int) -> DataFrame:
    bitmaps = stored(repeat_filter(shas, bits), "op4-filter")
    flagged = with_possible(shas, bitmaps, bits)
    alone = flagged.where("not possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    maybe = flagged.where("possible").select("doc_id", "sha")
    groups = maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    after_all = groups.where("group_size = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", "sha")
    salted = groups.where("group_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    several = maybe.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"])
    several = several.select("doc_id", "keep_id", "group_size", "sha").unionByName(after_all)
    return alone.unionByName(several)


def keep_last(docs: DataFrame) -> DataFrame:
    """docs without its repeated texts: of each class the row with the largest doc_id, all columns.

    Certainly unique rows pass straight through.  The class of a possibly repeated row is one aggregate whose map side
    already leaves one row a text and task, so a hot text is not gathered anywhere.
    """
    return unpacked(by_slice(packed(docs).withColumn("sha", digest(F.col("row.text"))), _keep_last))


def _keep_last(rows: DataFrame, bits: int) -> DataFrame:
    bitmaps = stored(repeat_filter(rows.select("sha"), bits), "op4-filter")
    flagged = with_possible(rows, bitmaps, bits)
    kept = flagged.where("possible").groupBy("sha").agg(F.max_by("row", F.struct("row.doc_id")).alias("row")).select("row")
    return flagged.where("not possible").select("row").unionByName(kept)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256)
"""
