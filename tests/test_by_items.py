"""Statistics and trades of many more entities than items, which hold no matrix of the entities."""

import tracemalloc

import numpy as np
import pytest
from test_operators import frame

from lockstep.operators import dedup, local, nulls, studies


def tall(n=260, m=40):
    return local.trim(local.planted("groups", n, m, 1.0, np.random.default_rng(1)))


def test_by_items_equals_by_entities():
    f = tall()
    (dense, _), (shares, gap) = local.margin_model(f, dense=True), local.margin_model(f)
    a, b = local.residual(f, dense), local.residual(f, shares)
    assert isinstance(b, local.Residual) and gap < 1e-8 and local.rms(b) == pytest.approx(local.rms(a), abs=1e-12)
    assert np.allclose(local.participation(b)[3], local.participation(a)[3], atol=1e-6)
    assert local.participation(b)[:3] == pytest.approx(local.participation(a)[:3], abs=1e-6)
    one, two = local.variance_terms(f, dense), local.variance_terms(f, shares)
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(one[k], rel=1e-9, abs=1e-14) for k in one)
    assert np.allclose(studies._profile(f, b, 9), studies._profile(f, a, 9), atol=1e-12)
    assert np.allclose(np.delete(b[7], 7), np.delete(a[7], 7), atol=1e-12)
    g = local.gram(f)[np.triu_indices(len(f), 1)] / f.shape[1]
    assert local.dispersion(f) == pytest.approx(g.var(), rel=1e-12)


def test_no_square_of_the_entities():
    f = (np.random.default_rng(2).random((20_000, 24)) < 0.5).astype(np.uint8)
    tracemalloc.start()
    r = local.residual(f, local.margin_model(f)[0])
    local.rms(r), local.participation(r), local.dispersion(f), local.variance_terms(f, r.shares), studies._profile(f, r, 25)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20  # the square is 3.2 GB as doubles
    tracemalloc.stop()


def test_tall_trades_keep_margins_and_visit_a_fiber_evenly(monkeypatch):
    monkeypatch.setattr(local, "TALL", 0)
    f, seen = tall(301, 20), []
    x = local.trades(f, 20 * len(f), np.random.default_rng(3), {len(f): seen.append})
    assert (x.sum(0) == f.sum(0)).all() and (x.sum(1) == f.sum(1)).all() and 0.05 < (x != f).mean() and (seen[0].sum(1) == f.sum(1)).all()
    fiber = local.enumerate_fiber([2, 2, 2, 1, 1], [3, 3, 2])
    at, counts, x, rng = {k: i for i, k in enumerate(fiber)}, np.zeros(len(fiber)), np.array(fiber[0], dtype=np.uint8), np.random.default_rng(4)
    for _ in range(4000):
        x = local.trades(x, 40, rng)
        counts[at[tuple(map(tuple, x.tolist()))]] += 1
    assert ((counts - counts.mean()) ** 2).sum() / counts.mean() < 70  # 30 degrees of freedom


def test_draws_and_strategies_of_a_tall_table(spark):
    f = tall(220, 30)
    o = frame(spark, f)
    got = nulls.null_statistics(o, 2, 1, 5).where("chain = -1").head()
    r = local.residual(f, local.margin_model(f, dense=True)[0])
    assert got.dispersion == pytest.approx(local.dispersion(f)) and got.rms == pytest.approx(local.rms(r)) and got.participation == pytest.approx(local.participation(r)[0], abs=1e-5)
    np.fill_diagonal(r, 0.0)
    members = studies.strategy_members(o, 6, 40, 1).where("strategy = 'all_residual'").orderBy("place").collect()
    own = [members[0].entity]
    while len(own) < 6:
        own.append(min((x for x in range(len(f)) if x not in own), key=lambda x: (round(np.mean([r[x, y] for y in own]), 9), x)))
    assert [x.entity for x in members] == sorted(own, key=own.index)


def test_permutations_rank_wide_keys_in_buckets(spark, monkeypatch):
    """The same cells, whether a key is ranked whole or by buckets; all cells are dealt out, not the few keys."""
    f = tall(200, 30)
    o = frame(spark, f)
    for permute, axis in ((nulls.permute_rows, 1), (nulls.permute_columns, 0)):
        monkeypatch.setattr(nulls, "WIDE", 1 << 14)
        plan = permute(o, 11)
        assert "REPARTITION_BY_COL" in plan._jdf.queryExecution().executedPlan().toString()
        whole = {(r.entity, r.item): r.f for r in plan.collect()}
        monkeypatch.setattr(nulls, "WIDE", 4)
        assert {(r.entity, r.item): r.f for r in permute(o, 11).collect()} == whole
        x = np.zeros_like(f)
        for (i, j), v in whole.items():
            x[i, j] = v
        assert (x.sum(axis) == f.sum(axis)).all() and (x != f).any()


def test_redundancy_goes_by_steps_without_edges(spark, monkeypatch):
    """The kept entities are those of the greedy rule, whatever a step decides at once, in one word and in several; no pairs
    are made for it."""

    def no_pairs(*_):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(dedup, "alike", no_pairs)
    for m, threshold in ((40, 0.65), (150, 0.6), (40, 0.99)):
        f = local.planted("groups", 120, m, 1.5, np.random.default_rng(5))
        o, kept = frame(spark, f), []
        for i in sorted(range(len(f)), key=lambda x: (f[x].sum(), x)):
            if all((f[i] == f[k]).mean() < threshold for k in kept):
                kept.append(i)
        for step in (16, 1 << 13):
            monkeypatch.setattr(dedup, "STEP", step)
            assert sorted(r.entity for r in dedup.keep_accurate(o, threshold).collect()) == sorted(kept)
    assert dedup.links(o, 0.65) is None


def test_chains_are_as_long_as_published(spark):
    """Four chains of 25 draws of the rms residual, whose burn-ins differ; degenerate rows are left out."""
    f = tall(60, 20)
    f[5], f[6] = 0, 1
    got = nulls.chain_draws(frame(spark, f), 4).toPandas()
    assert (got.groupby("chain").size() == 25).all() and sorted(got["chain"].unique()) == [0, 1, 2, 3] and (got["x"] > 0).all()
    x = local.trim(f)
    expected, rng = local.margin_model(x)[0], np.random.default_rng([4, 3])
    for t in range(2):
        x = local.trades(x, (125 - 25 if t == 0 else 5) * len(x), rng)
        assert got[(got["chain"] == 2) & (got["t"] == t)]["x"].item() == pytest.approx(local.rms(local.residual(x, expected)))
