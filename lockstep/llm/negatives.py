"""Hard negatives by one-dimensional distance keys.

Vectors are scaled to integers, and a row's score for an anchor is their inner product.  One more component, the root of
what its square sum lacks of the largest, puts all rows at equal distance from the origin, so that a higher score is a
smaller distance from the anchor (with 0 there): distance^2 = |anchor|^2 + largest - 2 score.

Index: pivots are fitted by k-means on at most SAMPLE rows; every row belongs to its nearest pivot, and its key is the
distance from it.  Rows are stored sorted by (pivot, key), in cells of at most CELL rows with neighbouring keys; the
directory has a cell's first and last key.  A row at distance r from a query that is d away from the pivot has a key within
d - r and d + r (and at least r - d), so that a radius is one interval of keys a pivot.

Search: the first scan takes a query's own cell, the next ones all cells that meet the intervals of a growing radius.  The
k-th best score so far bounds the distance beyond which nothing is better; the last scan's radius is that bound, which
certifies the result.  An upper limit of the scores is an inner radius.  A scan joins intervals with the directory by
pivot, and cells with blocks of about QUERIES queries; a task holds one cell and one block.  Equal rows have equal keys,
and go to cells of their own by uid.

Scores are exact integers, ties go to the smaller vec_id (null last).

Cases.  Rows with a null label or vector or a component that is null or not finite take no part.  Shorter vectors are
filled up with zeros; scaled components are held to +-2^20, which no embedding reaches, so that products are exact in
doubles.  Rows with a null vec_id can be found but are no anchors; repeated vec_ids are rows of their own.  An anchor
without others of its label gives no rows.  Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SAMPLE, PIVOTS, LLOYD = 4096, 64, 8
CELL, QUERIES = 1024, 1024
SCALE, LIMIT = 256, 1 << 20
GROWTH = (0.25, 1.0)  # of the way from the inner radius to the bound, after the own cell
SLACK = 1e-6  # of distances, far above their rounding error and far below the difference that one point of score makes
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score


def scaled(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, label, q (integers) of the rows that take part; written, so that uids stay."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(F.lit(SCALE) * x.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return stored(rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("q")), "vectors")


def matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of doubles, filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = np.zeros((len(lists), dim))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def unpacked(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), dtype="<i4").reshape(len(vectors), dim).astype(np.float64)


@dataclass(frozen=True)
class Space:
    dim: int
    largest: int  # square sum
    pivots: np.ndarray  # with the component more

    def distances(self, rows: np.ndarray, last: np.ndarray) -> np.ndarray:
        """From each pivot, of rows with `last` as their component more."""
        points = np.hstack([rows, last[:, None]])
        squares = (points**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def lift(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - (rows**2).sum(1), 0))


def fitted(vectors: DataFrame) -> Space | None:
    """The space with its pivots; None without rows."""
    square = F.aggregate("q", F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x)
    n, dim, largest = vectors.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(square)).first()
    if not n:
        return None
    sample = matrix(vectors.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("q").toArrow().column("q"), dim)
    space = Space(dim, largest, np.zeros((1, dim + 1)))
    points = np.unique(np.hstack([sample, space.lift(sample)[:, None]]), axis=0)
    k = min(len(points), PIVOTS, max(1, int(n**0.5) // 4))
    pivots = points[np.random.default_rng(0).permutation(len(points))[:k]]
    for _ in range(LLOYD):
        near = Space(dim, largest, pivots).distances(points[:, :-1], points[:, -1]).argmin(1)
        held = np.bincount(near, minlength=k)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, points)
        pivots = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], pivots)
    return Space(dim, largest, pivots)


def _keyed(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("q"), space.dim)
            d = space.distances(rows, space.lift(rows))
            near = d.argmin(1) if len(rows) else np.empty(0, np.int64)
            vecs = rows.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in vecs], pa.binary()), pa.array((rows**2).sum(1)), pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near])],
                ["uid", "vec_id", "label", "vec", "square", "pivot", "key"],
            )

    return run


def _celled(size: int):
    """Numbers the cells of sorted rows; a cell has one pivot and at most `size` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            pivots = batch.column("pivot").to_numpy()
            out = np.empty(len(pivots), dtype=np.int64)
            starts = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist()] if len(pivots) else []
            for a, b in zip(starts, [*starts[1:], len(pivots)], strict=False):
                if pivots[a] != last:
                    cell, held, last = cell + 1, 0, pivots[a]
                out[a:b] = cell + (held + np.arange(b - a)) // size
                cell, held = cell + (held + b - a) // size, (held + b - a) % size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "cell"])

    return run


def indexed(vectors: DataFrame, space: Space) -> DataFrame:
    """uid, vec_id, label, vec (32-bit integers), square, pivot, key, cell, stored by (pivot, key)."""
    schema = "uid long, vec_id long, label long, vec binary, square double, pivot int, key double"
    keyed = stored(vectors.mapInArrow(_keyed(space), schema), "distance-keys")
    ordered = keyed.repartitionByRange("pivot", "key", "uid").sortWithinPartitions("pivot", "key", "uid")
    return stored(ordered.mapInArrow(_celled(CELL), schema + ", cell long"), "distance-index")


def _ways(space: Space):
    """The distance of each query from each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, uids = unpacked(batch.column("vec"), space.dim), batch.column("qid").to_numpy()
            for a in range(0, len(rows), 256):
                d = space.distances(rows[a : a + 256], np.zeros(len(rows[a : a + 256])))
                p = d.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uids[a : a + 256], p)), pa.array(np.tile(np.arange(p, dtype=np.int32), len(d))), pa.array(d.ravel())], ["qid", "pivot", "d"])

    return run


def _scanner(dim: int, k: int, same: bool):
    names = ["qid", "aid", "score", "vec_id", "uid"]
    kinds = [pa.int64()] * 5

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """The k best of a cell for each ask of each query."""
        rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])  # nulls last
        uids, labels = rows.column("uid").to_numpy(), rows.column("label").to_numpy()
        scores = (unpacked(queries.column("vec"), dim) @ unpacked(rows.column("vec"), dim).T).astype(np.int64)
        asked = queries.select(["qid", "label", "asks"]).to_pylist()
        out: list[tuple] = []
        for q, s in zip(asked, scores, strict=True):
            fit = (labels == q["label"]) & (uids != q["qid"]) if same else labels != q["label"]
            for ask in q["asks"]:
                at = np.flatnonzero(fit & (s >= ask["low"]) & (s <= ask["high"]))
                at = at[np.argsort(-s[at], kind="stable")[:k]]
                out.append((np.full(len(at), q["qid"]), np.full(len(at), ask["aid"]), s[at], at))
        if not out:
            return pa.table([pa.array([], t) for t in kinds], names)
        qids, aids, found, at = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([pa.array(qids, pa.int64()), pa.array(aids, pa.int64()), pa.array(found), rows.column("vec_id").take(pa.array(at)), pa.array(uids[at])], names)

    return run


class Search:
    """queries: qid, cell, label, vec, base (|query|^2 + largest) of rows of the index."""

    def __init__(self, index: DataFrame, space: Space, queries: DataFrame):
        self.index, self.space, self.queries = index, space, stored(queries, "queries")
        self.directory = stored(index.groupBy("cell").agg(F.min("pivot").alias("pivot"), F.min("key").alias("first"), F.max("key").alias("last")), "distance-cells")
        self.ways = stored(self.queries.select("qid", "vec").mapInArrow(_ways(space), "qid long, pivot int, d double"), "distance-ways")
        self.blocks = max(1, -(-self.queries.count() // QUERIES))

    def _scan(self, visits: DataFrame, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """qid, aid, score, vec_id, uid of the k best rows a cell, ask by ask, of visits(qid, cell)."""
        asked = self.queries.select("qid", "label", "vec").join(asks.groupBy("qid").agg(F.collect_list(F.struct("aid", "low", "high")).alias("asks")), "qid")
        block = F.pmod(F.xxhash64("qid"), F.lit(self.blocks)).alias("block")
        queries = visits.join(asked, "qid").select("cell", block, "qid", "label", "vec", "asks")
        rows = self.index.join(visits.select("cell", block).distinct(), "cell").select("cell", "block", "uid", "vec_id", "label", "vec")
        schema = "qid long, aid long, score long, vec_id long, uid long"
        return rows.groupBy("cell", "block").cogroup(queries.groupBy("cell", "block")).applyInArrow(_scanner(self.space.dim, k, same), schema)

    def best(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """qid, aid, score, vec_id, uid, rank of the k rows of highest score with low <= score <= high for each ask(qid,
        aid, low, high), of the query's label or of all others; written."""
        base = self.queries.select("qid", "base", "cell")
        order = Window.partitionBy("qid", "aid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
        found = done = None
        for part in (None, *GROWTH):
            least = F.ceil(-F.sqrt((F.col("base") - self.space.largest) * self.space.largest)) - 1  # that any row can have
            now = asks.join(base, "qid").withColumn("low", F.greatest("low", least))
            if found is not None:  # nothing below the k-th score is of use any more
                kth = found.where(F.col("rank") == k).select("qid", "aid", F.col("score").alias("kth"))
                now = now.join(kth, ["qid", "aid"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low"))).drop("kth")
            if part is None:
                visits = now.select("qid", "cell").distinct()
            else:
                far = lambda score: F.sqrt(F.greatest(F.col("base") - 2 * F.col(score), F.lit(0.0)))
                radii = now.groupBy("qid").agg(F.min(far("high")).alias("inner"), F.max(far("low")).alias("outer"))
                reach = F.col("inner") + part * (F.col("outer") - F.col("inner")) + SLACK
                meets = (F.col("d") - F.col("last") <= reach) & (F.col("first") - F.col("d") <= reach) & (F.col("d") + F.col("last") >= F.col("inner") - SLACK)
                visits = self.ways.join(radii, "qid").join(self.directory, "pivot").where(meets).select("qid", "cell")
                visits = visits.join(done, ["qid", "cell"], "left_anti")
            visits = stored(visits, "distance-visits")
            new = self._scan(visits, now.select("qid", "aid", "low", "high"), k, same)
            new = new if found is None else new.unionByName(found.drop("rank"))
            found = stored(new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "distance-best")
            done = visits if done is None else done.unionByName(visits)
        return found


def share(score: Column, percent: int, up: bool) -> Column:
    """score * percent / 100, rounded up or down to an integer."""
    whole = score * percent
    return F.when(F.lit(up), (whole + F.pmod(-whole, F.lit(100))) / 100).otherwise((whole - F.pmod(whole, F.lit(100))) / 100).cast("long")


def mined(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where `anchor` (over vec_id
    and label) holds and each of its best rows of the same label, the best rows of other labels whose score is between
    `low` and `high` percent of the positive's."""
    rows = scaled(vectors)
    space = fitted(rows)
    if space is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = indexed(rows, space)
    queries = index.where(anchor).select(F.col("uid").alias("qid"), F.col("vec_id").alias("anchor_id"), "cell", "label", "vec", (F.col("square") + float(space.largest)).alias("base"))
    search = Search(index, space, queries)
    queries = search.queries
    beyond = 1 << 55  # no score is
    near = search.best(queries.select("qid", F.lit(0).cast("long").alias("aid"), F.lit(-beyond).alias("low"), F.lit(beyond).alias("high")), positives, True)
    pairs = near.select("qid", F.col("uid").alias("aid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    asks = pairs.select("qid", "aid", share(F.col("positive_score"), low, True).alias("low"), share(F.col("positive_score"), high, False).alias("high"))
    hard = search.best(asks.where("low <= high"), negatives, False)
    hard = hard.select("qid", "aid", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(pairs, ["qid", "aid"]).join(queries.select("qid", "anchor_id"), "qid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_distance_key_negatives(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    moved = given.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mined(moved, F.col("vec_id") % 100 == 0)


SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER best AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""
