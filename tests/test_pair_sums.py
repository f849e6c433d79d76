"""Statistics over all pairs that no table of pairs is made for, by brute force over dense matrices."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import frame, matrix

from lockstep.operators import dedup, local, pairs, residual, responses, statistics, windows


def dense(f):
    g = f.astype(int) @ f.T.astype(int)
    i, j = np.triu_indices(len(f), 1)
    r = f.sum(1, dtype=int)
    return i, j, g[i, j], r[i], r[j]


def shapes(spark):
    """Few items (vectors), items that are no integers (sparse), high item numbers (sparse or packed), empty rows."""
    f = matrix(40, 70, 3)
    f[3] = 0
    o = frame(spark, f)
    return f, [o, o.withColumn("item", F.concat(F.lit("q"), "item")), o.withColumn("item", F.col("item") * 10_000)]


@pytest.mark.parametrize("kind", range(3))
def test_histogram_counts_every_pair(spark, kind):
    f, forms = shapes(spark)
    got = {(r.ra, r.rb, r.g): r.k for r in pairs.histogram(forms[kind]).collect()}
    _, _, g, ri, rj = dense(f)
    assert got == Counter((min(a, b), max(a, b), c) for a, b, c in zip(ri, rj, g, strict=True))


@pytest.mark.parametrize("threshold", [0.0, 0.55, 0.62, 0.8, 1.0, 1.2])
def test_bands_lose_no_pair(spark, threshold):
    f, forms = shapes(spark)
    f[7] = f[8]
    i, j, g, ri, rj = dense(f)
    agree = (f.shape[1] - ri - rj + 2 * g) / f.shape[1]
    want = {(a, b): x for a, b, x in zip(i, j, agree, strict=True) if x >= threshold}
    for o in (frame(spark, f), frame(spark, f).withColumn("item", F.concat(F.lit("q"), "item"))):
        got = {(r.i, r.j): r.agreement for r in pairs.alike(o, threshold).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_pairs_of_both_plans_agree(spark):
    _, forms = shapes(spark)
    by = lambda df: sorted(map(tuple, df.collect()))
    assert by(pairs.all_pairs(forms[0])) == by(pairs.all_pairs(forms[0], "packed")) == by(pairs.all_pairs(forms[0], "sparse"))
    assert by(pairs.joint_counts(forms[0])) == by(pairs.sparse_counts(forms[0])) == by(pairs.packed_counts(forms[0], 3))


def test_heavy_items_are_dealt_out(spark, monkeypatch):
    """Blocks of three entities: an item that all fail, and the others, count the same."""
    f = matrix(40, 30, 8)
    f[:, 4] = 1
    o, want = frame(spark, f), {(r.i, r.j): r.g for r in pairs.sparse_counts(frame(spark, f)).collect()}
    monkeypatch.setattr(pairs, "HEAVY", 5)
    monkeypatch.setattr(pairs, "BLOCK", 3)
    monkeypatch.setattr(pairs, "HEAVY_SHARE", 50)
    assert {(r.i, r.j): r.g for r in pairs.sparse_counts(o).collect()} == want
    i, j, g, _, _ = dense(f)
    assert want == {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), g.tolist(), strict=True) if c}


def test_centrality_without_pairs(spark):
    f, forms = shapes(spark)
    i, j, g, ri, rj = dense(f)
    agree, want = (f.shape[1] - ri - rj + 2 * g) / f.shape[1], np.zeros(len(f))
    np.add.at(want, i, agree)
    np.add.at(want, j, agree)
    got = {r.entity: r.s for r in dedup.centrality(forms[1]).collect()}
    assert all(abs(got[k] - want[k]) < 1e-8 for k in range(len(f)))


def test_window_means_without_pairs(spark):
    f = matrix(60, 90, 5)
    order = np.argsort(f.sum(1), kind="stable")
    r = local.residual(f, local.expected_gram(local.fit(f)[0]))
    agree = np.array([[(a == b).mean() for b in f] for a in f])
    means = {}
    for k, start, width in windows.rank_windows(len(f)):
        inside = order[start - 1 : start - 1 + width]
        off = ~np.eye(width, dtype=bool)
        means[k] = (agree[np.ix_(inside, inside)][off].mean(), r[np.ix_(inside, inside)][off].mean(), 1 - f[inside].mean())
    for row in windows.window_profile(frame(spark, f)).collect():
        assert abs(row.mean_agreement - means[row.window][0]) < 1e-8 and abs(row.centre_accuracy - means[row.window][2]) < 1e-8
    for row in windows.residual_profile(frame(spark, f)).collect():
        assert abs(row.mean_residual - means[row.window][1]) < 1e-6


def test_summaries_equal_those_over_pairs(spark):
    f = matrix(50, 80, 6)
    o = frame(spark, f)
    p = residual.residual_pairs(o).toPandas()
    s, terms = residual.residual_summary(o).head(), residual.variance_terms(o).head()
    expected = p["observed"] - p["excess"]
    assert abs(s.rms_residual - np.sqrt((p["residual"] ** 2).mean())) < 1e-6
    assert terms.var_observed == pytest.approx(p["observed"].var()) and terms.covariance == pytest.approx(np.cov(expected, p["excess"])[0, 1])
    assert terms.correlation == pytest.approx(np.corrcoef(expected, p["excess"])[0, 1]) and terms.mean_excess == pytest.approx(p["excess"].mean())
    row = pairs.variance_inflation(o).head()
    c = np.corrcoef(f)[np.triu_indices(len(f), 1)].mean()
    assert abs(row.mean_correlation - c) < 1e-7


@pytest.mark.parametrize("n", [2, 3, 7, 40])
def test_random_pairs_are_all_pairs_once(spark, n):
    o = spark.range(n).select(F.concat(F.lit("e"), "id").alias("entity"))
    drawn = pairs.random_pairs(o, 10_000, n).collect()
    assert len(drawn) == n * (n - 1) // 2 == len({(r.i, r.j) for r in drawn}) and all(r.i < r.j for r in drawn)


def test_random_pairs_spread(spark):
    """Each entity comes about as often, and another seed gives other pairs."""
    o = spark.range(200).select(F.col("id").alias("entity"))
    a, b = ({(r.i, r.j) for r in pairs.random_pairs(o, 4000, seed).collect()} for seed in (1, 2))
    assert len(a) == len(b) == 4000 and len(a & b) < 1200  # 804 by chance
    times = np.bincount([e for p in a for e in p], minlength=200)
    assert times.min() > 15 and times.max() < 70 and abs(times.mean() - 40) < 1e-9


def test_vector_bootstrap_by_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), g, float(x) if k % 9 else None) for k, g, x in zip(range(60), rng.integers(0, 3, 60).tolist(), rng.normal(size=60), strict=True)]
    df = spark.createDataFrame(rows, "k long, g long, x double").repartition(5)
    got = {(r.g, r.draw): (r.w, r.x) for r in statistics.weighted_sums(df, "k", {"x": F.col("x")}, 30, 5, ["g"]).collect()}
    want = {}
    for k, g, x in rows:
        if x is not None:
            for d, w in enumerate(statistics._weights(5, str(k), 30).tolist()):
                a, b = want.get((g, d), (0.0, 0.0))
                want[g, d] = (a + w, b + w * x)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    weights = np.concatenate([statistics._weights(1, str(k), 500) for k in range(40)])
    assert abs(weights.mean() - 1) < 0.03 and abs(weights.var() - 1) < 0.05


def test_bootstrap_of_a_small_file_is_many_tasks_work(spark, monkeypatch):
    """Rows that lie in one partition are dealt out by what their draws cost, with the same result."""
    df = spark.range(0, 40, 1, 1).select("id", (F.col("id") * 1.5).alias("x"))
    parts = lambda: statistics.weighted_sums(df, "id", {"x": F.col("x")}, 50, 3)
    whole = {r.draw: (r.w, r.x) for r in parts().collect()}
    monkeypatch.setattr(statistics, "WEIGHTS", 500)
    dealt = parts()
    assert "RoundRobinPartitioning(4)" in dealt._jdf.queryExecution().toString()
    assert {r.draw: (r.w, pytest.approx(r.x)) for r in dealt.collect()} == whole


def test_dispersion_by_either_side(spark):
    """Many entities over few items and the reverse: the same sums, and pairs are those of the smaller side."""
    for f in (matrix(90, 20), matrix(20, 90)):
        _, _, g, _, _ = dense(f)
        o = frame(spark, f)
        assert pairs.squared_counts(o).head().squares == int((g * g).sum())
        row = pairs.dispersion(o).head()
        assert row.n_pairs == len(g) and row.variance_e6 == pytest.approx((g / f.shape[1]).var() * 1e6, abs=1e-4) and row["mean"] == pytest.approx((g / f.shape[1]).mean(), abs=1e-10)
    one = pairs.dispersion(spark.createDataFrame([(1, 2, 1)], "entity long, item long, f int")).head()
    assert (one.n_pairs, one.variance_e6) == (0, None)


def test_pairs_that_meet_are_not_broadcast(spark):
    """What is dealt out by blocks is larger than the aggregate it comes from, whose size Spark knows."""
    o = frame(spark, matrix(40, 30)).localCheckpoint()
    for plan in (pairs.vector_pairs(o, 1, 40), pairs.packed_counts(o), pairs.all_pairs(o, "sparse"), pairs.sparse_counts(o), pairs.alike(o, 0.7)):
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [" in text and "BroadcastHashJoin [ba" not in text and "BroadcastHashJoin [word" not in text


def test_packed_counts_over_several_slices(spark):
    f = matrix(25, 60, 5)
    g = f.astype(int) @ f.T.astype(int)
    want = {(i, j): g[i, j] for i in range(len(f)) for j in range(i + 1, len(f)) if g[i, j]}
    for step in (1, 700):  # one slice of items, eleven
        o = frame(spark, f).withColumn("item", F.col("item") * step)
        got = pairs.packed_counts(o)
        assert {(r.i, r.j): r.g for r in got.collect()} == want


def test_residual_pairs_without_python(spark, monkeypatch):
    o = frame(spark, matrix(40, 30))
    table = residual.residual_pairs(o)
    assert "ArrowEvalPython" not in table._jdf.queryExecution().toString()
    by_pair = {(r.i, r.j): r.residual for r in table.collect()}
    monkeypatch.setattr(residual, "CLASSES", 0)
    assert {(r.i, r.j): pytest.approx(r.residual, abs=1e-12) for r in residual.residual_pairs(o).collect()} == by_pair


def test_wrong_answers_by_bits(spark):
    """The same as by items; no pair is summed up after the join."""
    rng = np.random.default_rng(4)
    rows = [(i, k, int(c), int(c == k % 4)) for i in range(30) for k in range(24) for c in [rng.integers(-1, 4)] if rng.random() < 0.9]
    r = spark.createDataFrame(rows, "entity long, item long, choice int, acc int")
    got = responses.pair_agreement(r, None, 5)
    assert "Aggregate [i" not in got._jdf.queryExecution().optimizedPlan().toString()
    by_bits = {(x.i, x.j): (x.n, x.observed, x.expected) for x in got.collect()}
    by_items = responses.pair_agreement(r.withColumn("item", F.col("item") + 70), None, 5)
    assert len(by_bits) > 100 and {(x.i, x.j): (x.n, x.observed, x.expected) for x in by_items.collect()} == by_bits


def test_double_fault_without_pairs(spark):
    """By loops over pairs, with a member that is given twice, one that is alone and one without cells; no pair is joined."""
    f = matrix(40, 30)
    given = [(i % 3, i) for i in range(38)] + [(0, 3), (7, 39), (1, 999), (None, 4)]
    panels = spark.createDataFrame(given, "panel long, entity long")
    got = pairs.double_fault(frame(spark, f), panels)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(i#" not in plan and "(entity#" in plan
    got = {r.panel: (r.n_pairs, r.double_fault, r.disagreement) for r in got.collect()}
    want = {}
    for panel in (0, 1, 2):
        own = [i for p, i in given if p == panel and i < 40]
        both = [(f[a], f[b]) for k, a in enumerate(own) for b in own[k + 1 :] if a != b]
        want[panel] = (len(both), pytest.approx(np.mean([(a & b).mean() for a, b in both]), abs=1e-8), pytest.approx(np.mean([(a != b).mean() for a, b in both]), abs=1e-8))
    assert got == want


def test_nested_models_count_no_pairs(spark, monkeypatch):
    """The regression over panels reads sums; the pairs of members are not counted one by one."""
    from lockstep.plans import registry

    monkeypatch.setattr(pairs, "counts_of", lambda *_: pytest.fail("pairs are counted"))
    rows = {r.model: r for r in registry.QUERIES["nested_models"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {"M0", "M1", "M2"} and rows["M0"].r2 <= rows["M1"].r2 <= rows["M2"].r2 + 1e-12


def test_residual_pairs_are_looked_up(spark, monkeypatch):
    """One look-up a pair, rounded in the table; the same rows as worked out pair by pair."""
    o = frame(spark, matrix(40, 30))
    table = residual.residual_pairs(o, digits=4)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=broadcast)") == 1
    rows = sorted(map(tuple, table.collect()))
    monkeypatch.setattr(residual, "PAIR_CLASSES", 0)
    assert rows == sorted(map(tuple, residual.residual_pairs(o, digits=4).collect())) and len(rows) == 780


def test_agreement_is_rounded_once_a_value(spark):
    f, forms = shapes(spark)
    i, j, g, ri, rj = dense(f)
    want = {(a, b): round(x, 5) for a, b, x in zip(i.tolist(), j.tolist(), ((f.shape[1] - ri - rj + 2 * g) / f.shape[1]).tolist(), strict=True)}
    got = pairs.agreement(forms[0], digits=5)
    assert "strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.i, r.j): r.agreement for r in got.collect()} == want


def test_copies_of_a_row_are_bounded(spark):
    """However many entities there are, a row goes to so many tasks; entities without a name meet none."""
    assert pairs.block_count(10**7) == pairs.block_count(10**9) == pairs.BLOCKS <= 32 and pairs.block_count(3000) == 6
    o = frame(spark, matrix(30, 20))
    none = o.where("entity = 3").withColumn("entity", F.lit(None).cast("long"))
    for count in (pairs.joint_counts, pairs.packed_counts, pairs.all_pairs):
        assert all(r.i is not None and r.i < r.j for r in count(o.unionByName(none)).collect())
