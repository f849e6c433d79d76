import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_operators import frame, matrix

from lockstep.functions import verdicts
from lockstep.operators import local, nulls, pairs, residual, statistics, studies, windows


def dense_residual(f):
    return local.residual(f, local.expected_gram(local.fit(f)[0]))


def test_ranks_over_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select("id", (F.col("id") * 7919 % 101).alias("v"))
    got = windows.ordinal(df, [F.desc("v"), F.col("id")]).orderBy("rank").collect()
    want = sorted(((i, i * 7919 % 101) for i in range(5000)), key=lambda x: (-x[1], x[0]))
    assert [(r.id, r.v, r["rank"]) for r in got] == [(i, v, k + 1) for k, (i, v) in enumerate(want)]
    assert windows.ordinal(df.where("id < 0"), [F.col("id")]).isEmpty()


def test_counts_of_wanted_pairs(spark):
    f = matrix(25, 40)
    o, g = frame(spark, f), f.astype(int) @ f.T.astype(int)
    wanted = spark.createDataFrame([(0, 1), (0, 1), (2, 9), (5, 6)], "i long, j long")
    got = {(r.i, r.j): (r.g, r.ri, r.rj, r.m) for r in pairs.counts_of(o, wanted).collect()}
    assert got == {(i, j): (g[i, j], f[i].sum(), f[j].sum(), f.shape[1]) for i, j in ((0, 1), (2, 9), (5, 6))}
    every = {(r.i, r.j): r.g for r in pairs.packed_counts(o, 3).collect()}
    assert every == {(i, j): g[i, j] for i in range(len(f)) for j in range(i + 1, len(f)) if g[i, j]}


def test_reconciliation_of_variances(spark):
    f = matrix(40, 60)
    o = frame(spark, f)
    got = {r.term: r for r in studies.reconciliation(o, 4, 1, 60).collect()}
    want = residual.variance_terms(o).head()
    for term in ("var_observed", "var_expected", "covariance", "var_excess", "correlation", "mean_excess"):
        assert got[term].observed == pytest.approx(want[term], rel=1e-6, abs=1e-12)
    still = got["var_expected"]
    assert still.null_mean == pytest.approx(still.observed, rel=1e-9) and still.long_run == pytest.approx(still.observed, rel=1e-9) and still.ses is None


def test_rank_redundancy(spark):
    f = local.trim(local.planted("groups", 60, 80, 1.5, np.random.default_rng(5), groups=4))
    o = frame(spark, f)
    rows = studies.rank_redundancy(o, 4, 6, 2)
    assert rows.where("chain >= 0").select("chain", "t").distinct().count() == 4
    profile = {r.window: r for r in studies.rank_redundancy_profile(rows).collect()}
    for r in windows.residual_profile(o, 6).collect():
        assert profile[r.window].observed == pytest.approx(r.mean_residual, abs=1e-6) and profile[r.window].centre_accuracy == pytest.approx(r.centre_accuracy, abs=1e-6)
    s = studies.rank_redundancy_summary(rows).head()
    assert s.top == profile[0].observed and s.top_z == pytest.approx(profile[0].z) and s.rises == (s.spearman > 0 and s.top > s.median)


def test_chain_kinds(spark):
    rows = studies.chain_comparison(frame(spark, matrix(30, 50)), 12, 3, participations=8).orderBy("kind").collect()
    a, b = (r for r in rows if r.statistic == "dispersion")
    c, d = (r for r in rows if r.statistic == "participation")
    assert (c.kind, d.kind, c.n_null, d.n_null) == ("independent", "single", 8, 8) and c.observed == d.observed and c.sd_inflation == 1.0 and c.null_sd > 0
    assert (a.kind, b.kind) == ("independent", "single") and a.sd_inflation == 1 and a.n_null == b.n_null == 12 and a.observed == b.observed


def test_duplication_is_found(spark):
    """Half of the entities are copies: without them the residual structure falls to the null's."""
    f = local.trim(local.planted("clone", 60, 90, 0.0, np.random.default_rng(8)))
    sweep = studies.redundancy_sweep(frame(spark, f), (1.01, 0.99), 3, 1, 5)
    full, less = sweep.orderBy(F.desc("threshold")).collect()
    assert full.n_removed == 0 and less.n_removed >= 30 - (60 - len(f)) and less.n_entities + less.n_removed <= len(f)
    assert full.rms == pytest.approx(local.rms(dense_residual(f)), abs=1e-9)
    edge = nulls.draws(frame(spark, f), 3, 1, lambda x, e, gap: [(float(local.participation(local.residual(x, e))[3][0]),)], "w double", chains=3).where("chain >= 0").agg(F.avg("w")).head()[0]
    assert full.edge == pytest.approx(edge) and full.n_above_edge == int((local.participation(dense_residual(f))[3] > edge).sum())
    v = {r.statistic: r for r in studies.duplication_verdict(sweep, 1.01, 0.99).collect()}
    assert v["rms_ratio"].move_factor == pytest.approx(max(full.rms_ratio / less.rms_ratio, less.rms_ratio / full.rms_ratio))


def test_panels_in_accuracy_bands(spark):
    f = matrix(50, 60)
    o, accuracy = frame(spark, f), 1 - f.mean(1)
    got = studies.band_panels(o, (3, 5, 400), 60, seed=4).toPandas().groupby("panel")
    assert len(got) == 40  # no panel of 400
    for _, p in got:
        size = p["size"].iloc[0]
        assert len(p) == size == p["entity"].nunique()
        members = accuracy[p["entity"]]
        assert np.ptp(members) <= 0.25 + 1e-12 or any(((accuracy >= x) & (accuracy <= x + 0.25)).sum() < size for x in np.linspace(0, 0.75, 301))
    panels = spark.createDataFrame([(0, 3, e) for e in (1, 7, 9)] + [(1, 2, e) for e in (4, 7)], "panel int, size int, entity long")
    r, g = dense_residual(f), f.astype(float) @ f.T
    for row in studies.panel_measures(o, panels).collect():
        at = [(1, 7), (1, 9), (7, 9)] if row.panel == 0 else [(4, 7)]
        members = sorted({x for p in at for x in p})
        assert row.residual == pytest.approx(np.mean([r[p] for p in at]), abs=1e-7) and row.member_accuracy == pytest.approx(accuracy[members].mean())
        assert row.double_fault == pytest.approx(np.mean([g[p] / f.shape[1] for p in at])) and row.disagreement == pytest.approx(np.mean([(f[a] != f[b]).mean() for a, b in at]))


def test_strategies_choose_greedily(spark):
    f = matrix(30, 60)
    o = frame(spark, f)
    got = studies.strategy_members(o, 5, 12, 1).toPandas()
    chosen = {k: v.sort_values("place")["entity"].tolist() for k, v in got.groupby("strategy")}
    order = sorted(range(len(f)), key=lambda i: (f[i].sum(), i))
    assert set(chosen) == set(studies.STRATEGIES) and all(len(set(v)) == 5 for v in chosen.values())
    assert chosen["top_accuracy"] == order[:5] and set(chosen["gated_residual"]) | set(chosen["gated_disagreement"]) <= set(order[:12])
    r = dense_residual(f)
    np.fill_diagonal(r, 0.0)
    sims = {"residual": r, "disagreement": -(f[:, None, :] != f[None]).mean(2)}
    for name, sim in sims.items():
        for kind, pool in (("all", range(len(f))), ("gated", order[:12])):
            own = [order[0]]
            while len(own) < 5:
                own.append(min((x for x in pool if x not in own), key=lambda x: (round(np.mean([sim[x, y] for y in own]), 9), list(pool).index(x))))
            assert chosen[f"{kind}_{name}"] == own
    last = got[(got.strategy == "all_residual") & (got.place == 4)]["pair_residual"].iloc[0]
    inside = chosen["all_residual"]
    assert last == pytest.approx(np.mean([r[a, b] for a in inside for b in inside if a != b]))


def test_study_of_panels(spark):
    rng = np.random.default_rng(6)
    key, skill = rng.integers(0, 4, 40), rng.uniform(0.2, 0.9, 30)
    rows = []
    for e in range(30):
        for i in range(40):
            c = int(key[i]) if rng.random() < skill[e] else int(rng.integers(0, 4))
            rows.append((e, i, c, int(c == key[i])))
    r = spark.createDataFrame(rows, "entity long, item long, choice int, acc int")
    o, other, gold = studies.halves(r, 1)
    assert not {x.item for x in o.select("item").distinct().collect()} & {x.item for x in other.select("item").distinct().collect()}
    assert {x.item: x.gold for x in gold.collect()}.items() <= dict(enumerate(key.tolist())).items()
    models = {m.model: m for m in studies.incremental_models(studies.panel_study(r, (3, 5), 80, 2)).collect()}
    assert set(models) == {"M0", "M1", "M2", "M0+residual", "M0+double_fault"}
    assert 0 < models["M0"].r2 <= models["M1"].r2 + 1e-9 <= models["M2"].r2 + 2e-9 and models["M2"].adds in (True, False)
    s = studies.panel_strategies(r, (3, 5), 10, 2, 3)
    assert s.count() == 2 * 2 * 6 and s.where("vote IS NULL OR member_accuracy IS NULL").isEmpty()
    c = {x["size"]: x for x in studies.strategy_contrast(s, 200).collect()}
    assert set(c) == {3, 5} and all(x.low <= x.difference <= x.high for x in c.values())


def test_bootstrap_of_a_slope(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = 2 * x + rng.normal(size=400)
    r = statistics.bootstrap_slope(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double"), "k", "y", "x", 200).head()
    assert r.slope == pytest.approx(np.polyfit(x, y, 1)[0], abs=0.02) and r.low < 2 < r.high and 0.1 < r.high - r.low < 0.4


def test_verdicts_at_their_limits(spark):
    lit = F.lit
    row = spark.range(1).select(
        verdicts.covered(lit(0.4)).alias("a"), verdicts.covered(lit(0.399)).alias("b"), verdicts.closed_form_holds(lit(1.0), lit(1.0 + 1e-10)).alias("c"), verdicts.differs(lit(1.0), lit(1.25)).alias("d"),
        verdicts.differs(lit(1.0), lit(1.2)).alias("e"), verdicts.duplication_driven(lit(2.0)).alias("f"), verdicts.redundancy_rises(lit(0.1), lit(0.2), lit(0.1)).alias("g"), verdicts.survives_dedup(lit(None).cast("double")).alias("h"),
        verdicts.interval_has_zero(lit(-1.0), lit(1.0)).alias("i"), verdicts.usable(lit(0.8), lit(0.3)).alias("j"), verdicts.uniform(lit(0.01)).alias("k"), verdicts.mixed(lit(1.06)).alias("l"),
    ).head()
    assert row == Row(a=True, b=False, c=True, d=True, e=False, f=False, g=True, h=False, i=True, j=False, k=True, l=False)
    four = spark.createDataFrame([(True,)] * 4 + [(False,)], "p boolean")
    assert four.agg(verdicts.fires_below(F.col("p")).alias("x"), verdicts.fires_by_majority(F.col("p")).alias("y")).head() == Row(x=False, y=False)
    assert verdicts.adds_information(1e-4, 0.01) and not verdicts.adds_information(1e-4, 0.009)


def test_least_similar_takes_the_first_of_equals():
    sim = np.zeros((4, 4))
    assert local.least_similar(sim, 2, 3) == [2, 0, 1] and local.least_similar(sim, 0, 9) == [0, 1, 2, 3]
