import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lockstep.functions import scalar
from lockstep.operators import dedup, local, margins, nulls, pairs, residual, responses, statistics, windows
from lockstep.plans import report
from lockstep.sources import ingest


def frame(spark, f):
    i, m = np.indices(f.shape)
    return spark.createDataFrame(pd.DataFrame({"entity": i.ravel(), "item": m.ravel(), "f": f.ravel().astype("int32")}))


def matrix(n=60, m=90, seed=1, kind="rasch", strength=0.0):
    return local.trim(local.planted(kind, n, m, strength, np.random.default_rng(seed)))


def naive(f):
    n, m = f.shape
    p = f.mean(1)
    return local.mean_joint(f) - (p.sum() ** 2 - (p * p).sum()) / (n * (n - 1))


@pytest.mark.parametrize("shape", [(60, 90), (40, 150), (150, 30)])
def test_closed_form_equals_measurement(spark, shape):
    f = local.draw(local.rasch(*shape, np.random.default_rng(2)), np.random.default_rng(3))
    t = margins.closed_form_terms(frame(spark, f)).head()
    assert (t.n, t.m) == shape
    assert abs(t.mean - local.mean_joint(f)) < 1e-14 and abs(t.naive - naive(f)) < 1e-13 and abs(t.naive - t.forced) < 1e-13


def test_sampler_keeps_margins_and_mean(spark):
    f = matrix()
    o = frame(spark, f)
    draws = nulls.null_matrices(o, 4, 7).cache()
    for k in range(4):
        assert margins.margins_equal(o, draws.where(f"rep = {k}")).head().equal
    assert draws.where("f NOT IN (0, 1)").isEmpty()
    assert margins.fraction_changed(o, draws.where("rep = 0").drop("rep")).head().fraction_changed > 0.1
    stats = nulls.null_statistics(o, 6, 3).toPandas()
    assert stats["mean"].max() - stats["mean"].min() < 1e-15


def test_margin_model_from_classes(spark):
    f = matrix()
    model = residual.fit_margins(frame(spark, f))
    assert model.gap < 1e-8
    a, b = residual.parameters(frame(spark, f), model)
    p = 1 / (1 + np.exp(-(a.orderBy("entity").toPandas()["alpha"].to_numpy()[:, None] + b.orderBy("item").toPandas()["beta"].to_numpy())))
    assert np.allclose(p.sum(1), f.sum(1), atol=1e-7) and np.allclose(p.sum(0), f.sum(0), atol=1e-7)
    assert np.allclose(p, local.fit(f)[0], atol=1e-9)


def test_residuals_against_dense(spark):
    f = matrix()
    o = frame(spark, f)
    r = local.residual(f, local.expected_gram(local.fit(f)[0]))
    got = residual.residual_pairs(o).orderBy("i", "j").toPandas()
    assert np.allclose(got["residual"], r[np.triu_indices(len(f), 1)], atol=1e-9)
    s = residual.residual_summary(o).head()
    assert s.rms_residual == pytest.approx(local.rms(r), abs=1e-6) and s.participation_raw == pytest.approx(local.participation(r)[2], abs=1e-3)
    spec = residual.spectrum_summary(residual.spectrum(o)).head()
    assert spec.clipped == pytest.approx(local.participation(r)[0], abs=1e-3)
    v = residual.variance_terms(o).head()
    assert v.var_observed == pytest.approx(v.var_expected + 2 * v.covariance + v.var_excess, rel=1e-9)


@pytest.mark.parametrize("kind, strength, low, high", [("rasch", 0.0, 0.55, 1.8), ("groups", 1.6, 0.0, 0.5)])
def test_controls(spark, kind, strength, low, high):
    f = local.trim(local.planted(kind, 300, 400, strength, np.random.default_rng(4), groups=6))
    r = nulls.n_effective(frame(spark, f), 4, 1).head()
    assert low < r.ratio < high


def test_pair_plans_agree(spark):
    f = matrix()
    o = frame(spark, f)
    want = {(i, j): int(g) for i, j in zip(*np.triu_indices(len(f), 1)) if (g := local.gram(f)[i, j])}
    for strategy in ("sparse", "packed", "auto"):
        assert {(r.i, r.j): r.g for r in pairs.joint_counts(o, strategy).collect()} == want
    agree = pairs.agreement(o).toPandas()
    assert np.allclose(agree.sort_values(["i", "j"])["agreement"], [(f[i] == f[j]).mean() for i, j in zip(*np.triu_indices(len(f), 1))])


def greedy(f, order, threshold):
    kept = []
    for i in order:
        if all((f[i] == f[k]).mean() < threshold for k in kept):
            kept.append(i)
    return sorted(kept)


def test_redundancy_rules(spark):
    f = local.planted("copy", 60, 40, 0.8, np.random.default_rng(5))
    o = frame(spark, f)
    for threshold in (0.6, 0.7, 0.9, 1.01):
        got = sorted(r.entity for r in dedup.keep_accurate(o, threshold).collect())
        assert got == greedy(f, sorted(range(60), key=lambda i: (f[i].sum(), i)), threshold)
    s = np.array([[(a == b).mean() for b in f] for a in f]).sum(1) - 1
    got = sorted(r.entity for r in dedup.representatives(o, 0.7).collect())
    assert got == greedy(f, sorted(range(60), key=lambda i: (-round(s[i], 9), i)), 0.7)


def test_trim_is_one_pass(spark):
    f = np.array([[1, 1, 1], [0, 0, 0], [1, 0, 1], [0, 1, 1]])
    got = margins.trim_degenerate(frame(spark, f)).toPandas()
    assert set(got["entity"]) == {2, 3} and set(got["item"]) == {0, 1}


def test_checks(spark):
    bad = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 0, 1), (2, 0, 1), (2, 1, 0)], "entity int, item int, f int")
    assert tuple(margins.domain_check(bad).head()) == (6, 1, 1)
    with pytest.raises(Exception, match="0 or 1"):
        margins.require_binary(bad).collect()
    guard = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 0), (2, 0, 1)], "entity int, item int, f int")
    assert {r.entity: r.status for r in margins.rowcount_guard(guard).collect()} == {0: "kept", 1: "non-binary", 2: "rowcount:1!=2"}
    assert margins.flip(spark.createDataFrame([(1, 1, 1)], "entity int, item int, correct int")).head().f == 0


def test_response_edge_cases(spark):
    r = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 1, 1), (3, 1, -1, 1), (1, 2, 0, 0), (2, 2, 3, 0), (1, 3, 0, 0)], "entity int, item int, choice int, acc int")
    assert {x.item: x.gold for x in responses.recover_gold(r).collect()} == {1: 1, 2: -1, 3: -1}
    assert {x.item: x.q2 for x in responses.concentration(r).collect()} == {2: 0.5, 3: None}
    masked = responses.permute_wrong(r, 1).groupBy("item", "choice").count().collect()
    assert {(x[0], x[1], x[2]) for x in masked} == {(x[0], x[1], x[2]) for x in r.groupBy("item", "choice").count().collect()}


def test_statistics(spark):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x - z + rng.normal(size=200) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "z": z, "same": 3 - 2 * x}))
    m0, m1, m2 = (statistics.ols(df, "y", c) for c in (["x"], ["x", "z"], ["x", "z", "same"]))
    assert np.allclose(m1["coefficients"], np.linalg.lstsq(np.column_stack([np.ones(200), x, z]), y, rcond=None)[0])
    assert m2["rank"] == 3 and m2["r2"] == pytest.approx(m1["r2"]) and statistics.partial_f(m1, m2)[1] == 0
    f, q, p = statistics.partial_f(m0, m1)
    assert q == 1 and f > 1000 and p < 1e-6
    scored = statistics.zscored(df, ["x"]).agg(F.avg("x"), F.stddev_pop("x")).head()
    assert abs(scored[0]) < 1e-12 and scored[1] == pytest.approx(1)
    chi = statistics.chi_square_uniform(spark.createDataFrame([(30,), (20,), (10,)], "k int"), 3).head()
    assert chi.chi_square == pytest.approx(10) and chi.p == pytest.approx(math.exp(-5), abs=2e-3)


def test_fibers_and_uniformity(spark):
    for size, r, c in ((90, [2] * 4, [2] * 4), (48, [3, 2, 2, 1], [2] * 4), (204, [3, 3, 2, 2, 2], [3] * 4), (1170, [2, 3, 1, 2, 2], [2] * 5)):
        assert len(local.enumerate_fiber(r, c)) == size
    visits, size = nulls.fiber_visits(spark, [2] * 4, [2] * 4, 4000, 3)
    assert statistics.chi_square_uniform(visits, size).head().p > 0.001


def test_scalars(spark):
    df = spark.createDataFrame(
        [
            Row(t="  A\t b\n\nC ", d="x/details_a__b__c", card=["o/m", "bad"], tags=["base_model:finetune:z/y"], e="http:503", v=[0.5, 2.0, 2.0]),
            Row(t=None, d="x/none", card=None, tags=["base_model:q:z/y", "base_model:z/y"], e="ValueError", v=[1.0]),
        ],
        "t string, d string, card array<string>, tags array<string>, e string, v array<double>",
    )
    out = df.select(
        scalar.text_key(F.col("t")), scalar.model_of_dataset(F.col("d")), scalar.parents(F.col("card"), F.col("tags")), scalar.retryable(F.col("e")), scalar.http_code(F.col("e")), scalar.first_argmax(F.col("v"))
    ).collect()
    import hashlib

    assert tuple(out[0]) == (hashlib.md5(b"a b c").hexdigest()[:16], "a/b__c", ["o/m"], True, 503, 1)
    assert tuple(out[1]) == (None, None, ["z/y"], False, None, -1)
    one = spark.range(1).select(scalar.effect_size(F.lit(3.0), F.lit(1.0), F.lit(2.0)), scalar.effect_size(F.lit(3.0), F.lit(1.0), F.lit(0.0)), scalar.move_factor(F.lit(2.0), F.lit(8.0)), scalar.sigmoid(scalar.logit(F.lit(0.3)))).head()
    assert (one[0], one[1], one[2]) == (1.0, None, 4.0) and one[3] == pytest.approx(0.3)


def test_layouts(spark, tmp_path):
    spark.createDataFrame([("m", 0, (1.0, 0.5), [0.1, 0.9])], "model string, item int, metrics struct<acc:double,mc2:double>, predictions array<double>").write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([("m", 0, "True", [0.1, float("nan")])], "model string, item int, acc string, predictions array<double>").write.parquet(f"{tmp_path}/a")
    assert ingest.read_correctness(spark, f"{tmp_path}/c").head().correct == 1.0
    assert ingest.read_correctness(spark, f"{tmp_path}/a").head().correct == 1.0
    assert [ingest.read_choices(spark, f"{tmp_path}/{x}").head().choice for x in "ca"] == [1, -1]
    plan = ingest.read_correctness(spark, f"{tmp_path}/c")._jdf.queryExecution().executedPlan().toString()
    assert "mc2" not in plan and "predictions" not in plan
    samples = [{"acc": 0.0, "acc_norm": 1.0}, {"predictions": ["A"], "target": "A"}, {"pred": "B", "doc": {"answerKey": "C"}}]
    files = spark.createDataFrame([("list", json.dumps(samples)), ("object", json.dumps({"samples": samples})), ("values", json.dumps({str(i): s for i, s in enumerate(samples)}))], "model string, json string")
    got = ingest.sample_correctness(files).orderBy("model", "item").collect()
    assert [r.correct for r in got] == [0, 1, 0] * 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("arc", 10, 3, 0.5)], "bench string, n_models int, delta int, pr_ratio double")
    ingest.append_rows(rows, f"{tmp_path}/csv")
    ingest.append_rows(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    ingest.write_report(rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").head().bench == "arc"
    assert ingest.changelog(rows).head().line == "- arc: 10 models (+3), PR ratio 0.500"


def test_windows_and_panels(spark):
    assert windows.rank_windows(100)[-1] == (24, 91, 10) and windows.rank_windows(5) == []
    f = matrix()
    profile = windows.window_profile(frame(spark, f))
    assert profile.count() == 25
    null = profile.withColumn("mean_agreement", F.col("mean_agreement") - 0.1).union(profile)
    assert windows.window_z(profile, null).count() == 25
    chosen = responses.greedy_diverse(pairs.agreement(frame(spark, f)), 0, 4)
    assert len(set(chosen)) == 4 and chosen[0] == 0


def test_report_and_command_line(spark, tmp_path, capsys):
    f = matrix(30, 40)
    keys = {r.key: r for r in report.audit(frame(spark, f), 2).collect()}
    assert keys["n_entities"].value == len(f) and abs(keys["residual"].value) < 1e-12 and keys["power"].note
    assert all(r.passed for r in report.selftest(spark, 40, 60).collect())
    np.save(f"{tmp_path}/f.npy", f)
    assert report.main(["excess", f"{tmp_path}/f.npy", "--json", f"{tmp_path}/out.json"]) == 0
    assert json.load(open(f"{tmp_path}/out.json"))[0]["naive"] == pytest.approx(naive(f))
    with open(f"{tmp_path}/g.npz", "wb") as g:
        np.savez(g, models=np.array(["a"]), prim=1 - f)
    assert report.main(["pr", f"{tmp_path}/g.npz", "--correct", "--no-calibrate"]) == 0
    r = report.measure(frame(spark, f), 3).head()
    assert r.n == len(f) and r.pr_null_sd >= 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from lockstep.streaming import incremental

    events = spark.createDataFrame([(1, "2024-01-01 01:00:00", 1, "error"), (2, "2024-01-01 02:00:00", 1, "view")], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    incremental.run_cells(spark, f"{tmp_path}/events.parquet", f"{tmp_path}/state")
    assert incremental.cells(spark, f"{tmp_path}/state").count() == 2
    events.withColumn("user_id", F.col("user_id") + 1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    incremental.run_cells(spark, f"{tmp_path}/events.parquet", f"{tmp_path}/state")
    assert incremental.cells(spark, f"{tmp_path}/state").count() == 4


def test_residual_profile_and_planted_kinds(spark):
    rng = np.random.default_rng(3)
    f = local.trim(local.planted("groups", 40, 60, 1.0, rng))
    n, m = f.shape
    o = spark.createDataFrame([(i, j, int(f[i, j])) for i in range(n) for j in range(m)], "entity long, item long, f int")
    r = local.residual(f, local.expected_gram(local.fit(f)[0]))
    order = sorted(range(n), key=lambda i: (f[i].sum(), i))
    for row in windows.residual_profile(o, 5).collect():
        inside = order[row.start - 1 : row.start - 1 + 10]
        want = np.mean([r[a, b] for a in inside for b in inside if a != b])
        assert abs(row.mean_residual - want) < 1e-6 and abs(row.centre_accuracy - (1 - f[inside].mean())) < 1e-6
    whole = local.planted("copy", 30, 50, 1.0, rng)
    assert (whole == whole[0]).all()
    assert local.planted("shuffled", 30, 50, 0.0, rng).shape == (30, 50)
