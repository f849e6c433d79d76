"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Equal texts are one group, which stays in one shard (null counts as a text without bytes).  Up to GROUPS_PER_TASK
groups are differenced by one task: again and again the two partial partitions of largest spread are combined, the
largest sum of one with the smallest of the other.  Of more groups, each task differences its hash partition into
BUNDLES bundles of about equal size; bundles, groups larger than a bundle and every so many-th group as it is are the
items of the next level, about an eighteenth as many.  Those single groups, of all sizes, let the last level make up for
what the large ones leave uneven.  Neither driver nor any task ever holds more than about GROUPS_PER_TASK groups; of a
partial partition the sums go when it is combined, and only the order of its slots stays.

A hot text is one group, summed map-side.  Texts that occur once need no join to learn their shard; the others are
joined by group and salt, so that copies of one text are dealt over SALTS tasks.  Slots come from per-bucket counts, not
from one ordered pass over a shard.

Cases.  Null texts have size 1 and crc 0.  Null and repeated doc_ids are rows like any other.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 16
GROUPS_PER_TASK = 20_000
BUNDLES, SINGLES = 128, 2048
SALTS = 16


class Partial:
    """A partial partition: either one item, or two parts that were combined.  sums: in falling order, less the smallest;
    an item's are its weight and zeros, and those of a part that was combined are gone."""

    __slots__ = ("weight", "sums", "item", "left", "right", "order")

    def __init__(self, weight, sums=None, item=None, left=None, right=None, order=None):
        self.weight, self.sums, self.item, self.left, self.right, self.order = weight, sums, item, left, right, order

    def take_sums(self, k: int) -> np.ndarray:
        sums, self.sums = self.sums, None
        if sums is None:
            sums = np.zeros(k, dtype=np.int64)
            sums[0] = self.weight
        return sums


def combine(a: Partial, b: Partial, k: int) -> Partial:
    """The largest sum of one with the smallest of the other; of equal sums the first slot stays first."""
    sums = a.take_sums(k) + b.take_sums(k)[::-1]
    order = np.argsort(-sums, kind="stable")
    sums = sums[order]
    sums -= sums[-1]
    return Partial(int(sums[0]), sums, left=a, right=b, order=order.astype(np.uint16))


def difference(parts: list[Partial], k: int) -> Partial:
    """The differencing itself; ties go by position, so that a repeated task gives the same result."""
    heap = [(-p.weight, i, p) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    count = len(parts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        new = combine(a, b, k)
        heapq.heappush(heap, (-new.weight, count, new))
        count += 1
    return heap[0][2]


def resolve(root: Partial, k: int) -> Iterator[tuple[int, int]]:
    """(item, slot) for each leaf."""
    todo = [(root, np.arange(k, dtype=np.uint16))]  # slots[i]: the final slot of the part's i-th largest sum
    while todo:
        part, slots = todo.pop()
        if part.left is None:
            yield part.item, int(slots[0])
            continue
        left = np.empty(k, dtype=np.uint16)
        left[part.order] = slots
        todo += [(part.left, left), (part.right, left[::-1])]


def assign(weights: list[int], shards: int) -> list[int]:
    """The shard of each weight; one task's work."""
    out = [0] * len(weights)
    if weights:
        for item, slot in resolve(difference([Partial(w, item=i) for i, w in enumerate(weights)], shards), shards):
            out[item] = slot
    return out


def bundle(weights: list[int]) -> list[int]:
    """The bundle of each weight (in falling order)."""
    n = len(weights)
    bundles, singles = min(BUNDLES, max(1, n // 8)), min(SINGLES, n // 20)
    large = sum(weights) / bundles
    alone = {i for i, w in enumerate(weights) if w > large} | {i * n // singles for i in range(singles)}
    rest = [i for i in range(n) if i not in alone]
    out = [0] * n
    for i, b in zip(rest, assign([weights[i] for i in rest], bundles), strict=True):
        out[i] = b
    for k, i in enumerate(sorted(alone)):
        out[i] = bundles + k
    return out


def _by_task(place):
    """For id, bytes in falling order of bytes: `to`, what place() says of the task's weights, made distinct by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            found = pa.Table.from_batches(batches)
            to = np.array(place(found.column("bytes").to_pylist()), dtype=np.int64) + (TaskContext.get().partitionId() << 32)
            yield from found.append_column("to", pa.array(to)).to_batches(max_chunksize=10_000)

    return run


def place(items: DataFrame, shards: int) -> DataFrame:
    """id, shard of items(id binary, bytes)."""
    n = items.count()
    if n <= GROUPS_PER_TASK:
        one = items.repartition(1).sortWithinPartitions(F.desc("bytes"), "id")
        return one.mapInArrow(_by_task(lambda w: assign(w, shards)), "id binary, bytes long, to long").select("id", F.col("to").cast("int").alias("shard"))
    dealt = items.repartition(-(-n // GROUPS_PER_TASK), "id").sortWithinPartitions(F.desc("bytes"), "id")
    bundled = stored(dealt.mapInArrow(_by_task(bundle), "id binary, bytes long, to long"), "shard-bundles")
    name = F.to_binary(F.lpad(F.hex("to"), 16, "0"), F.lit("hex"))
    upper = place(stored(bundled.groupBy("to").agg(F.sum("bytes").alias("bytes")).select(name.alias("id"), "bytes"), "shard-items"), shards)
    return bundled.select("id", name.alias("upper")).join(upper.withColumnRenamed("id", "upper"), "upper").select("id", "shard")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key")),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.min("crc").alias("crc"))
    groups = stored(groups, "shard-groups")
    placed = stored(place(groups.select(F.col("key").alias("id"), "bytes"), shards), "shard-placed")
    placed = groups.join(placed.withColumnRenamed("id", "key"), "key")
    alone = placed.where("n = 1").select("doc_id", "size", "crc", "shard")
    salted = placed.where("n > 1").select("key", "shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    found = stored(alone.unionByName(copies.select("doc_id", "size", "crc", "shard")), "shard-found")
    buckets = max(1, int((found.count() / shards) ** 0.5))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    counts = found.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "crc"))
    ranked = found.withColumn("k", within).join(counts, ["shard", "bucket"])
    return ranked.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("k") - 1).alias("slot"))


def op10_kk_shards(spark, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
