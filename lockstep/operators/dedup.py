"""Redundant entities by agreement thresholds.

Both greedy rules are the lexicographically first maximal independent set of the graph "agreement at or above the
threshold", in an order of the entities.  It is found in rounds: an undecided entity with no undecided earlier neighbour
is kept, its neighbours go.  Rounds are few (the longest falling path among decisions), each two joins of the edges.

Where entities are vectors (`pairs.words_of`) no edges are made: the next STEP undecided entities are decided by one task,
and what is behind them meets those that were kept of them.  So an entity is compared with kept ones before it alone, until
one agrees with it; the kept ones of a step are at most STEP rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .margins import entity_margins, item_margins
from .pairs import alike, block_count, failing, shape, vectors, words_of

STEP = 1 << 13  # entities that one task decides at once


def first_independent(edges: DataFrame, order: DataFrame) -> DataFrame:
    """entity: the kept ones.  edges: (i, j); order: (entity, rank), all ranks different."""
    e = edges.select("i", "j").join(order.select(F.col("entity").alias("i"), F.col("rank").alias("a")), "i").join(order.select(F.col("entity").alias("j"), F.col("rank").alias("b")), "j")
    e = stored(e.select(F.when(F.col("a") < F.col("b"), F.col("i")).otherwise(F.col("j")).alias("early"), F.when(F.col("a") < F.col("b"), F.col("j")).otherwise(F.col("i")).alias("late")), "edges")
    open_ = stored(order.select("entity"), "open")
    kept = open_.limit(0)
    while not open_.isEmpty():
        blocked = e.select(F.col("late").alias("entity")).distinct()
        now = stored(open_.join(blocked, "entity", "left_anti"), "kept")
        lost = e.join(now.withColumnRenamed("entity", "early"), "early", "left_semi").select(F.col("late").alias("entity")).distinct()
        kept = kept.union(now)
        open_ = stored(open_.join(now, "entity", "left_anti").join(lost, "entity", "left_anti"), "open")
        e = stored(e.join(open_.withColumnRenamed("entity", "early"), "early", "left_semi").join(open_.withColumnRenamed("entity", "late"), "late", "left_semi").select("early", "late"), "edges")
    return kept


def first_apart(o: DataFrame, order: DataFrame, threshold: float, words: int, n: int, m: int) -> DataFrame:
    """`first_independent` of the entities that agree at the threshold, by their vectors; n entities, m items."""
    names = [f"w{k}" for k in range(words)]
    most = max((h for h in range(m + 1) if (m - h) / m >= threshold), default=-1)  # items on which two that agree may differ
    rest = stored(vectors(o, words).join(order, "entity").select("entity", "rank", *names), "open")
    kind, kept = dict(rest.dtypes)["entity"], rest.select("entity").limit(0)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # at most STEP rows
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.stack([t.column(c).to_numpy() for c in names], axis=1)
            left, own = np.argsort(t.column("rank").to_numpy()), []
            while len(left):
                own.append(int(left[0]))
                left = left[1:]
                left = left[np.bitwise_count((x[left] ^ x[own[-1]]).view(np.uint64)).sum(1, dtype=np.int64) > most]
            yield from t.take(pa.array(own)).to_batches()

    while not rest.isEmpty():
        last = rest.select("rank").orderBy("rank").limit(STEP).agg(F.max("rank")).head()[0]
        now = stored(rest.where(F.col("rank") <= last).coalesce(1).mapInArrow(decide, f"entity {kind}, rank long, " + ", ".join(f"{c} long" for c in names)), "kept")
        kept = kept.union(now.select("entity"))
        differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"x{k}"))) for k, c in enumerate(names)), F.lit(0))
        before = F.broadcast(now.select(*[F.col(c).alias(f"x{k}") for k, c in enumerate(names)]))  # at most STEP rows
        rest = stored(rest.where(F.col("rank") > last).repartition(block_count(n, 256), "rank").join(before, differing <= most, "left_anti"), "open")
    return kept


def links(o: DataFrame, threshold: float) -> DataFrame | None:
    """(i, j, agreement) for several calls of the rules below; None where they go by vectors."""
    return None if words_of(shape(o)) else stored(alike(o, threshold), "agreement")


def _first(o: DataFrame, order: DataFrame, threshold: float, pairs: DataFrame | None) -> DataFrame:
    if pairs is None:
        row = shape(o)
        if words := words_of(row):
            return first_apart(o, order, threshold, words, row.n, row.m)
        pairs = alike(o, threshold)
    return first_independent(pairs.where(F.col("agreement") >= threshold), order)


def keep_accurate(o: DataFrame, threshold: float, pairs: DataFrame | None = None) -> DataFrame:
    """Entities kept in order of accuracy (fewest failures, then entity): each agrees with no kept one at the threshold.
    pairs: (i, j, agreement), at least those at the threshold."""
    from .windows import by_accuracy

    return _first(o, by_accuracy(o).select("entity", "rank"), threshold, pairs)


def centrality(o: DataFrame) -> DataFrame:
    """entity, s: its agreements with all others, summed.  The joint failures with all others are c - 1 of each item that
    it fails, so that margins say it all."""
    items = item_margins(o)
    joint = failing(o).join(items, "item").groupBy("entity").agg(F.sum(F.col("c") - 1).alias("joint"))
    r = entity_margins(o)
    t = r.agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("all")).crossJoin(items.agg(F.count(F.lit(1)).alias("m")))
    others = (F.col("n") - 1) * (F.col("m") - F.col("r")) - (F.col("all") - F.col("r")) + 2 * F.coalesce("joint", F.lit(0))
    return r.join(joint, "entity", "left").crossJoin(F.broadcast(t)).select("entity", F.round(others / F.col("m"), 9).alias("s"))


def representatives(o: DataFrame, threshold: float, pairs: DataFrame | None = None) -> DataFrame:
    """Entities kept in order of centrality (sum of agreements, then entity); each stands for those it agrees with."""
    from .windows import ordinal

    return _first(o, ordinal(centrality(o), [F.desc("s"), F.col("entity")]).select("entity", "rank"), threshold, pairs)
