"""Packing of documents into token sequences by cutting-stock column generation.

A document is its ids and an end id.  Documents of at least `capacity` ids are cut into full pieces, which are sequences as
they are; what is left is packed.  A sequence is padded to `capacity`, unless its ids are a power of two.

The plan needs the histogram of piece lengths only, at most `capacity` numbers.  Lengths are put into at most CLASSES classes
of equal token mass.  A linear program over patterns (how many pieces of each class make a sequence) covers the histogram
with the least padded length; its columns come from a knapsack dynamic program over the dual prices, which gives the best
pattern of every sum.  The rounded patterns are then made of exact lengths: each class gives its most frequent length, and
two pieces are chosen so that the sum is exactly full, for as many sequences at once as the histogram allows.  What rounding
leaves is filled by exact subset sums, the longest piece first.  Lengths that nothing fills exactly form the chain: they
stand one behind the other, and a piece is cut where a sequence ends.  So padding is less than one sequence in all.

Assignment: pieces are ranked within their length (two-level counts, so that no length is one task's work), and a run of
ranks goes to a run of sequences.  The runs are a table of at most RUNS + capacity rows, the one that is broadcast; beyond
RUNS the rest goes to the chain.  The ids are tokenised once, in a written table; whole pieces need no ids to be placed.

Cases.  Null and empty texts are the end id alone.  Null and repeated doc_ids are documents like any other.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, table
from .token_files import TEXT_BYTES, TEXTS, default_tokenizer, loaded

CAPACITY, END_ID, PAD_ID = 4096, 2, 0
CLASSES, POOL = 128, 32
TOLERANCE = 1e-3
PROGRAMS = 4  # one after the other, each over what the one before leaves; fewer if one leaves nine tenths
OWN = 0.01  # of a sequence: what a shorter sequence of its own costs beside its ids
RUNS = 200_000
RANKED, BUCKETS = 250_000, 64


# --- the linear program -------------------------------------------------------------------------------------------------


def price(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sum up to capacity the best total price of sizes (ascending, any number of each) with exactly that sum,
    and the last one taken."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for s in range(int(sizes[0]), capacity + 1):
        found = best[s - sizes[: fitting[s]]] + prices[: fitting[s]]
        at = found.argmax()
        best[s], last[s] = found[at], at
    return best, last


def padded(s: int, capacity: int) -> int:
    return s if s & (s - 1) == 0 else capacity


def cost(s: int, capacity: int) -> float:
    """Of a sequence with s ids, in full sequences."""
    return 1.0 if padded(s, capacity) == capacity else s / capacity + OWN


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, without the threads that a library may start for it."""
    return np.einsum("i,ij->j" if a.ndim == 1 else "ij,j->i", a, b)


def patterns_of(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[float, int, np.ndarray]]:
    """(how often, sum, pieces of each size): the solution of the linear program, by the revised simplex method."""
    m = len(sizes)
    copies = capacity // sizes
    columns = [np.eye(m)[i] * copies[i] for i in range(m)]
    costs = np.array([cost(int(c @ sizes), capacity) for c in columns])
    inverse, x = np.diag(1 / copies), counts / copies
    every = np.array([cost(s, capacity) for s in range(capacity + 1)])
    least = float(counts @ sizes) / capacity  # without any padding
    pool, pool_costs = np.empty((0, m)), np.empty(0)
    for _ in range(40 * m + 400):
        if product(costs[None], x)[0] <= least * (1 + TOLERANCE):
            break
        y = product(costs, inverse)
        gains = product(pool, y) - pool_costs
        if not len(gains) or gains.max() <= TOLERANCE:
            best, last = price(sizes, y, capacity)
            sums = np.argsort(every - best, kind="stable")[:POOL]
            sums = sums[best[sums] - every[sums] > TOLERANCE]
            if not len(sums):
                break
            new = np.zeros((len(sums), m))
            for row, s in zip(new, sums.tolist(), strict=True):
                while s:
                    row[last[s]] += 1
                    s -= int(sizes[last[s]])
            pool, pool_costs = np.vstack([pool, new])[-2000:], np.concatenate([pool_costs, every[sums]])[-2000:]
            gains = product(pool, y) - pool_costs
        at = int(gains.argmax())
        d = product(inverse, pool[at])
        ratios = np.where(d > 1e-7, x / np.where(d > 1e-7, d, 1), np.inf)
        out = int(ratios.argmin())
        x = np.maximum(x - ratios[out] * d, 0)
        x[out] = ratios[out]
        columns[out], costs[out] = pool[at], pool_costs[at]
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
    return [(float(n), int(c @ sizes), c.astype(np.int64)) for n, c in zip(x, columns, strict=True) if n > 1e-9]


# --- rounding -----------------------------------------------------------------------------------------------------------


@dataclass
class Plan:
    """Runs of ranks: (length, first, until, sequence, per, offset).  The piece of rank r in a run has its sequence at
    `sequence` + (r - first) div per and stands at offset + (r - first) mod per * length there; with per = 0 it has
    `offset` ids before it in the chain, which begins at sequence `chain`."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    chain: int = 0
    by_patterns: int = 0  # sequences

    @property
    def cut(self) -> list[int]:
        """The lengths that the chain may cut."""
        return sorted({r[0] for r in self.runs if r[4] == 0})


class Rounding:
    def __init__(self, counts: np.ndarray, capacity: int):
        """counts[l]: pieces of length l."""
        self.left, self.capacity, self.plan = counts.astype(np.int64), capacity, Plan(capacity)
        self.taken = np.zeros(capacity + 1, dtype=np.int64)
        self.counts, self.sequences = counts, 0

    def emit(self, use: dict[int, int], times: int) -> None:
        """`times` sequences of use[l] pieces of each length l."""
        offset = 0
        for length, per in sorted(use.items(), reverse=True):
            first = int(self.taken[length])
            self.plan.runs.append((length, first, first + per * times, self.sequences, per, offset))
            self.taken[length] += per * times
            self.left[length] -= per * times
            offset += per * length
        self.sequences += times

    def often(self, use: dict[int, int]) -> int:
        return min(int(self.left[length]) // per for length, per in use.items())

    def exact(self, classes: list[tuple[int, int, int, int]], target: int) -> dict[int, int] | None:
        """Lengths with the sum `target`, of (first length, last length, pieces, mean) of each class: the most frequent
        ones on that side of the mean which makes up for the others, but for two pieces (or one) that end the sum."""
        pieces = sum(n for _, _, n, _ in classes)
        free = sorted(classes, key=lambda c: (c[1] - c[0], c[1]))[-2:]
        free = [free[-1], free[-1]] if free[-1][2] > 1 and (len(free) == 1 or free[0][0] == free[0][1]) else free[::-1]
        free = free[: min(2, pieces)]
        use: dict[int, int] = {}
        over = 0
        for a, b, n, mean in sorted(classes, key=lambda c: -c[2]):
            n -= sum(f[0] == a for f in free)
            if n:
                low, high = (a, mean) if over > 0 else (mean, b)
                length = low + int(self.left[low : high + 1].argmax())
                if not self.left[length]:
                    length = a + int(self.left[a : b + 1].argmax())
                use[length] = use.get(length, 0) + n
                over += n * (length - mean)
        left = self.left.copy()
        for length, n in use.items():
            left[length] -= n
        rest = target - sum(length * n for length, n in use.items())
        if len(free) == 1:
            a, b = free[0][:2]
            if not a <= rest <= b or left[rest] < 1:
                return None
            chosen = [rest]
        else:
            (a, b, *_), (c, d, *_) = free
            low, high = max(a, rest - d), min(b, rest - c)
            if low > high:
                return None
            one = np.arange(low, high + 1)
            times = np.minimum(left[one], left[rest - one])
            times[rest - one == one] //= 2
            at = int(times.argmax())
            if times[at] < 1:
                return None
            chosen = [low + at, rest - low - at]
        for length in chosen:
            use[length] = use.get(length, 0) + 1
        return use if self.often(use) else None

    def fill(self, classes: list[tuple[int, int, int, int]], target: int, times: int) -> None:
        while times > 0 and len(self.plan.runs) < RUNS:
            use = self.exact(classes, target)
            if use is None:
                return
            n = min(times, self.often(use))
            self.emit(use, n)
            times -= n

    def subset(self, longest: int, target: int) -> dict[int, int] | None:
        """Lengths with the sum `target`, the longest among them; by reachable sums as bits."""
        goal = target - longest
        lengths = np.flatnonzero(self.left[: goal + 1])[::-1].tolist()
        reach, steps = 1, []
        for length in [] if goal == 0 else lengths:
            n = min(int(self.left[length]) - (length == longest), goal // length)
            size = 1
            while n > 0:
                take = min(size, n)
                steps.append((length, take, reach))
                reach |= reach << (length * take)
                n -= take
                size *= 2
            reach &= (1 << (goal + 1)) - 1
            if reach >> goal & 1:
                break
        if not reach >> goal & 1:
            return None
        use, at = {longest: 1}, goal
        for length, take, before in reversed(steps):
            if not before >> at & 1:
                use[length] = use.get(length, 0) + take
                at -= length * take
        return use

    def rest(self) -> None:
        """What patterns leave: exactly full sequences where there are any, the longest piece first; then the chain."""
        capacity, linked = self.capacity, []
        for length in range(capacity, 0, -1):
            while self.left[length]:
                use, target = None, capacity
                while use is None and target >= length and len(self.plan.runs) < RUNS:
                    use = self.subset(length, target)
                    target //= 2
                if use is None:
                    linked.append(length)
                    break
                self.emit(use, self.often(use))
            if self.left[length]:  # set aside, so that no shorter piece counts on it
                self.taken[length], self.left[length] = self.taken[length], 0
        self.plan.chain, position = self.sequences, 0
        for length, n in ((length, int(self.counts[length] - self.taken[length])) for length in linked):
            first = int(self.taken[length])
            self.plan.runs.append((length, first, first + n, 0, 0, position))
            position += length * n


def by_patterns(work: Rounding) -> None:
    """One linear program over what is left, rounded: whole parts first, then one more of each pattern that has a rest."""
    lengths = np.flatnonzero(work.left)
    if not len(lengths):
        return
    counts = work.left
    mass = np.cumsum(lengths * counts[lengths].astype(np.float64))
    group = np.minimum((CLASSES * (mass - mass[0]) / mass[-1]).astype(int), CLASSES - 1) if len(lengths) > CLASSES else np.arange(len(lengths))
    spans = [(int(part[0]), int(part[-1])) for part in np.split(lengths, np.flatnonzero(np.diff(group)) + 1)]
    held = np.array([counts[a : b + 1].sum() for a, b in spans], dtype=np.float64)
    sizes = np.array([round(float(np.arange(a, b + 1) @ counts[a : b + 1]) / n) for (a, b), n in zip(spans, held, strict=True)])
    found = sorted(patterns_of(sizes, held, work.capacity), key=lambda p: -p[0])
    for up in (False, True):
        for often, total, pieces in found:
            # near enough to full that lengths can make it so; a pattern that stays short is for the chain
            target = total if padded(total, work.capacity) == total else work.capacity
            times = (1 if often % 1 > 0 else 0) if up else int(often)
            work.fill([(*spans[i], int(pieces[i]), int(sizes[i])) for i in np.flatnonzero(pieces)], target, times)


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for histogram[length] pieces of each length of at most capacity."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    work = Rounding(counts, capacity)
    if counts[capacity]:
        work.emit({capacity: 1}, int(counts[capacity]))
    for _ in range(PROGRAMS):
        before = work.left.sum()
        by_patterns(work)
        if work.left.sum() > 0.9 * before:
            break
    work.plan.by_patterns = work.sequences
    work.rest()
    return work.plan


# --- on Spark -----------------------------------------------------------------------------------------------------------


def _cutter(tokenizer: str, end_id: int, capacity: int):
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(tokenizer)
        for batch in slices(batches, TEXTS, TEXT_BYTES):
            ids = tokens.encode([t or "" for t in batch.column("text").to_pylist()])
            rows = []
            for name, some in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                whole = np.append(some, np.uint32(end_id)).astype("<u4")
                rows += [(name, a, min(capacity, len(whole) - a), len(whole), whole[a : a + capacity].tobytes()) for a in range(0, len(whole), capacity)]
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in list(zip(*rows, strict=True))[:4]), pa.array([r[4] for r in rows], pa.binary())], names)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """uid, doc_id, start, length, doc_tokens, ids (little-endian, 32 bits) of the pieces that full sequences cut; written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = rows.mapInArrow(_cutter(tokenizer or default_tokenizer(), end_id, capacity), "doc_id long, start long, length long, doc_tokens long, ids binary")
    return stored(cut.select(F.monotonically_increasing_id().alias("uid"), "*"), "token-pieces")


def plan_of(found: DataFrame, capacity: int = CAPACITY) -> Plan:
    """The plan for the lengths of pieces, of which at most `capacity` different ones come to the driver."""
    return planned(dict(map(tuple, found.groupBy("length").count().collect())), capacity)


def placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows(uid, doc_id, start, length, ids, ...) with sequence_id and offset; start, length and ids of those that are cut
    are their parts', and `whole` is the length before.  ids may be null where plan.cut does not have the length."""
    spark = rows.sparkSession
    most = max((until for _, _, until, *_ in plan.runs), default=0)
    buckets = max(BUCKETS, -(-most // RANKED))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "uid"))
    ranked = rows.withColumn("k", within).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    runs = spark.createDataFrame([(int(a), int(b), int(c), int(d), int(e), int(f)) for a, b, c, d, e, f in plan.runs], "length long, first long, until long, sequence long, per long, at long")
    found = ranked.join(F.broadcast(runs), "length").where("rank >= first and rank < until")
    j, per, size = F.col("rank") - F.col("first"), F.col("per"), F.lit(plan.capacity)
    position = F.col("at") + j * F.col("length")
    chained = per == 0
    found = found.withColumns({
        "sequence_id": F.when(chained, F.floor(position / size) + plan.chain).otherwise(F.col("sequence") + F.floor(j / F.greatest(per, F.lit(1)))),
        "offset": F.when(chained, position % size).otherwise(F.col("at") + j % F.greatest(per, F.lit(1)) * F.col("length")),
    })
    room = size - F.col("offset")
    one = F.struct(F.lit(0).cast("long").alias("skip"), F.least(room, F.col("length")).alias("length"), F.col("sequence_id"), F.col("offset"))
    two = F.struct(room.alias("skip"), (F.col("length") - room).alias("length"), (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = found.withColumn("part", F.explode(F.when(F.col("length") > room, F.array(one, two)).otherwise(F.array(one))))
    ids = F.when(F.col("part.length") < F.col("length"), F.col("ids").substr((F.col("part.skip") * 4 + 1).cast("int"), (F.col("part.length") * 4).cast("int"))).otherwise(F.col("ids"))
    kept = [c for c in rows.columns if c not in ("bucket", "start", "length", "ids")]
    return parts.select(
        *kept, (F.col("start") + F.col("part.skip")).alias("start"), F.col("part.length").alias("length"), F.col("length").alias("whole"), ids.alias("ids"),
        F.col("part.sequence_id").alias("sequence_id"), F.col("part.offset").alias("offset"),
    )


def _joiner(capacity: int, pad_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, held = None, []

        def whole() -> pa.RecordBatch:
            ids = b"".join(held)
            n = len(ids) // 4
            ids += np.full(padded(n, capacity) - n, pad_id, dtype="<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([present], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.binary())], ["sequence_id", "n_tokens", "ids"])

        for batch in batches:
            for name, ids in zip(batch.column("sequence_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != present and held:
                    yield whole()
                    held = []
                present = name
                held.append(ids)
        if held:
            yield whole()

    return run


def sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, pad_id: int = PAD_ID) -> DataFrame:
    """sequence_id, n_tokens, ids: the padded sequences."""
    found = pieces(docs, tokenizer, end_id, capacity)
    rows = placed(found, plan_of(found, capacity)).select("sequence_id", "offset", "ids")
    return rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(_joiner(capacity, pad_id), "sequence_id long, n_tokens long, ids binary")


def op11_cutting_stock_packing(spark, sf_dir: str) -> DataFrame:
    found = pieces(table(spark, sf_dir, "documents"))
    plan = plan_of(found)
    rows = found.select("uid", "doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("whole_crc32"), F.when(F.col("length").isin(plan.cut), F.col("ids")).alias("ids"))
    crc = F.when(F.col("length") == F.col("whole"), F.col("whole_crc32")).otherwise(F.crc32("ids")).alias("ids_crc32")
    return placed(rows, plan).select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")
