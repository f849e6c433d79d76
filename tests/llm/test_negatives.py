import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from lockstep.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, rank string, low int"


def row(vec_id, embedding, label):
    return Row(vec_id=vec_id, embedding=embedding, label=label, cell="x", rank="y", low=1)


def plain(rows, positives, count):
    """By loops over all rows."""
    kept = []
    for i, r in enumerate(rows):
        if r.label is None or r.embedding is None or any(x is None or not math.isfinite(x) for x in r.embedding):
            continue
        kept.append((i, r.vec_id, r.label, [max(-(1 << 20), min(1 << 20, math.floor(256 * float(np.float32(x))))) for x in r.embedding]))
    order = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for i, a, label, q in kept:
        if a is None or a % 10:
            continue
        scores = [(sum(x * y for x, y in zip(q, p, strict=False)), b, other == label) for j, b, other, p in kept if j != i]
        for ps, p, _ in order([s for s in scores if s[2]])[:positives]:
            fit = [s for s in scores if not s[2] and 30 * ps <= 100 * s[0] <= 90 * ps]
            out += [(a, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(order(fit)[:count], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def clustered(n, dim, seed):
    """Near a few centres, so that distance keys leave cells out."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.25) for x in c]
        size = math.sqrt(sum(x * x for x in v))
        rows.append(row(i, [float(np.float32(x / size)) for x in v], rng.randrange(3)))
    return rows


def test_mining_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELL", 16)
    monkeypatch.setattr(negatives, "QUERIES", 8)
    rows = clustered(400, 6, 1)
    found = negatives.mined(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, 5, 10)
    assert len(want) > 100 and got(found) == want


def test_scans_leave_cells_out(spark, monkeypatch):
    """Every answer is certified though not every cell is read."""
    monkeypatch.setattr(negatives, "CELL", 8)
    given = negatives.scaled(spark.createDataFrame(clustered(600, 3, 4), SCHEMA))
    space = negatives.fitted(given)
    index = negatives.indexed(given, space)
    queries = index.where("vec_id % 50 = 0").select(F.col("uid").alias("qid"), "cell", "label", "vec", (F.col("square") + float(space.largest)).alias("base"))
    visits = []
    inner = negatives.Search._scan
    monkeypatch.setattr(negatives.Search, "_scan", lambda self, v, *rest: visits.append(v) or inner(self, v, *rest))
    search = negatives.Search(index, space, queries)
    best = search.best(queries.select("qid", F.lit(0).cast("long").alias("aid"), F.lit(-(1 << 50)).alias("low"), F.lit(1 << 50).alias("high")), 3, True)
    assert best.count() == 36
    cells, read = index.select("cell").distinct().count(), defaultdict(int)
    for v in visits:
        for r in v.collect():
            read[r.qid] += 1
    assert len(read) == 12 and sum(read.values()) < 0.7 * 12 * cells
    assert index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pivot").alias("p")).where("n > 8 or p > 1").count() == 0


def test_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELL", 8)
    rng = random.Random(3)
    hot = [0.5, 0.25, -0.125, 0.75]
    rows = [row(i, hot, i % 2) for i in range(60)] + [row(i, [rng.uniform(-1, 1) for _ in range(4)], rng.randrange(2)) for i in range(60, 130)]
    rows += [row(10, hot, 0), row(10, hot, 1), row(None, hot, 1), row(None, [0.4, 0.2, 0.0, 0.7], 0)]
    rows += [row(200, None, 1), row(210, hot, None), row(220, [0.1, None, 0.2, 0.3], 1), row(230, [0.1, float("nan"), 0.2, 0.3], 1), row(240, [float("inf")] * 4, 0)]
    rows += [row(250, [], 1), row(260, [0.5, 0.5], 0), row(270, [9000.0, 0.1, 0.1, 0.1], 1), row(280, [-9000.0, 0.5, 0.5, 0.5], 0), row(290, hot, 7)]
    assert got(negatives.mined(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == plain(rows, 5, 10)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mined(empty, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([row(0, [0.5], 1), row(7, None, 1)], SCHEMA)
    assert negatives.mined(alone, F.col("vec_id") % 10 == 0).count() == 0
