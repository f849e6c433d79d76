"""Trades and spectra that no task holds whole, maintained margins, the time series, and the harvest source."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_operators import frame, matrix

from lockstep.operators import local, margins, nulls, residual
from lockstep.sources import results
from lockstep.sources.storage import new_path, stored
from lockstep.streaming import maintained


def test_trades_keep_margins_and_move_cells(spark, monkeypatch):
    monkeypatch.setattr(nulls, "MATCHED", 16)
    f = matrix(45, 60, 2)
    o = frame(spark, f)
    x = np.zeros_like(f)
    for r in nulls.null_table(o, 3, 2).collect():
        x[r.entity, r.item] += 1
    assert x.max() == 1 and (x.sum(0) == f.sum(0)).all() and (x.sum(1) == f.sum(1)).all()
    assert (x != f).mean() > 0.1
    again = np.zeros_like(f)
    for r in nulls.null_table(o.repartition(7), 3, 2).collect():
        again[r.entity, r.item] = 1
    assert (again == x).all()


def test_trades_visit_a_fiber_evenly(spark):
    """1,500 copies of one small matrix, each matched within itself: all 90 matrices of its margins come about as often."""
    start, copies = [[0, 1], [0, 1], [2, 3], [2, 3]], 1500
    rows = spark.createDataFrame([(c, 4 * c + i, items) for c in range(copies) for i, items in enumerate(start)], "copy long, entity long, failed array<int>").repartition(4, "copy")
    for t in range(14):
        rows = stored(nulls.trade_sweep(rows, 5, t, 0, "copy"), "fiber")
    state = rows.groupBy("copy").agg(F.array_sort(F.collect_list(F.struct("entity", F.array_sort("failed").alias("failed")))).alias("s")).select(F.transform("s", lambda x: x["failed"]).alias("s"))
    seen = Counter(str(r.s) for r in state.collect())
    assert len(seen) == 90 and sum(seen.values()) == copies
    mean = copies / 90
    chi = sum((k - mean) ** 2 / mean for k in seen.values())
    assert chi < 145  # 89 degrees of freedom: 1 in 10,000


@pytest.mark.parametrize("raw", [False, True])
def test_spectrum_by_items_equals_the_dense_one(spark, raw):
    f = matrix(90, 25, 4)
    o = frame(spark, f)
    got = np.array([r.eigenvalue for r in residual.spectrum(o, raw).orderBy("place").collect()])
    if raw:
        c = local.gram(f)
        s = np.sqrt(np.diag(c))
        want = np.linalg.eigvalsh(c / s[:, None] / s)[::-1]
    else:
        want = local.participation(local.residual(f, local.expected_gram(local.fit(f)[0])))[3]
    assert len(got) == len(f) and np.allclose(got, want, atol=1e-7)


def test_record_after_every_batch(spark):
    """Cells that come again, turn into failures later, or hold new entities and items; a run without news."""
    rng, state, seen = np.random.default_rng(1), new_path(spark, "maintained"), []
    zero = maintained.sums(spark, state).head()
    assert (zero.n, zero.m, zero.srr) == (0, 0, 0)
    for k in range(4):
        cells = [(int(rng.integers(0, 8 + 4 * k)), int(rng.integers(0, 12)), int(rng.random() < 0.4)) for _ in range(60 if k != 2 else 0)]
        seen += cells
        spark.createDataFrame(cells, "entity long, item long, f int").coalesce(2).write.parquet(f"{state}/source/part={k}")
        maintained.take_up(spark.readStream.schema("entity long, item long, f int").parquet(f"{state}/source/*"), state)
        o = spark.createDataFrame(seen, "entity long, item long, f int").groupBy("entity", "item").agg(F.max("f").alias("f"))
        assert maintained.sums(spark, state).head().asDict() == {c: int(v) for c, v in margins.totals(o).head().asDict().items()}
        assert maintained.record(spark, state).head() == margins.joint_failure_record(o).head()
    want = {r.entity: r.r for r in margins.entity_margins(o).collect()}
    assert {r.key: r.margin for r in maintained.margins(spark, state, "entity").collect()} == want


def test_published_runs_replace_themselves(spark):
    state = new_path(spark, "series")
    assert maintained.series(spark, state).isEmpty()
    row = lambda n: spark.createDataFrame([("b", n, 5, 0.25, 1.0)], "bench string, n_models long, n_items long, mean_joint double, naive_excess_e6 double")
    for run, n in (("2024-01", 10), ("2024-02", 17), ("2024-02", 17), ("2024-03", 16), ("2024-01", 10)):
        maintained.publish(row(n), state, run)
    got = sorted((r.run, r.n_models, r.n_models_delta, r.line) for r in maintained.series(spark, state).collect())
    assert [x[:3] for x in got] == [("2024-01", 10, 10), ("2024-02", 17, 7), ("2024-03", 16, -1)]
    assert got[1][3] == "- 2024-02 b: 17 models (+7), 5 items, mean joint failure 0.250000"


def put(folder, snapshot, model, table):
    where = folder / f"snapshot={snapshot}" / f"model={model}"
    where.mkdir(parents=True)
    pq.write_table(table, where / "part-0.parquet")


def test_harvest_judges_files_and_goes_on(spark, tmp_path):
    folder, state = tmp_path / "results", new_path(spark, "harvest")
    good = pa.table({"item": [0, 1, 2], "acc": [1.0, 0.0, 1.0], "other": ["x"] * 3})
    put(folder, "a", "m1", good)
    put(folder, "a", "m2", good.slice(0, 2))
    put(folder, "a", "m3", pa.table({"item": [0, 1, 2], "acc": [1.0, 2.0, 0.0]}))
    put(folder, "a", "m4", pa.table({"item": [0, 1, 2], "acc": [1.0, None, 0.0]}))
    put(folder, "a", "m5", pa.table({"item": [0, 1, 2]}))
    (folder / "snapshot=a" / "model=m6").mkdir()
    (folder / "snapshot=a" / "model=m6" / "part-0.parquet").write_bytes(b"no parquet")
    results.harvest(spark, str(folder), state, 3, files=4)
    first = spark.read.parquet(f"{state}/files").count()
    assert 1 <= first <= 6
    for _ in range(3):
        results.harvest(spark, str(folder), state, 3, files=4)
    put(folder, "b", "m2", good)
    results.harvest(spark, str(folder), state, 3, files=4)
    results.harvest(spark, str(folder), state, 3, files=4)
    cells, rejects = results.harvested(spark, state)
    assert sorted((r.snapshot, r.model, r.item, r.correct) for r in cells.collect()) == [(s, m, i, c) for s, m in (("a", "m1"), ("b", "m2")) for i, c in ((0, 1), (1, 0), (2, 1))]
    reasons = {r.model: r.reason for r in rejects.collect()}
    assert {m: reasons[m] for m in ("m2", "m3", "m4")} == {"m2": "rowcount:2!=3", "m3": "non-binary-primary", "m4": "non-binary-primary"} and {"m5", "m6"} <= reasons.keys()
    assert spark.read.parquet(f"{state}/files").count() == 7
    assert sorted(tuple(r) for r in results.newest(cells).where("entity = 'm2'").collect()) == [("m2", 0, 0), ("m2", 1, 1), ("m2", 2, 0)]
    spark.dataSource.register(results.ResultFiles)
    batch = spark.read.format(results.FORMAT).option("path", str(folder)).option("expected", 3).load()
    assert batch.where("reason IS NULL").count() == 6 and batch.where("reason IS NOT NULL").count() == 5


def test_readers_offsets(tmp_path):
    for k in range(5):
        put(tmp_path / "r", "a", f"m{k}", pa.table({"item": [0], "acc": [1.0]}))
    reader = results.StreamReader({"path": str(tmp_path / "r"), "files": "2"})
    offsets = [reader.initialOffset(), *(reader.latestOffset() for _ in range(4))]
    taken = [[p.path for p in reader.partitions(a, b)] for a, b in zip(offsets, offsets[1:], strict=False)]
    assert [len(t) for t in taken] == [2, 2, 1, 0] and len({p for t in taken for p in t}) == 5
    again = results.StreamReader({"path": str(tmp_path / "r"), "files": "2", "after": offsets[2]["at"]})
    assert [p.path for p in again.partitions(offsets[2], again.latestOffset())] == taken[2]
    rows = next(reader.read(reader.partitions(offsets[0], offsets[1])[0])).to_pylist()
    assert [(r["snapshot"], r["item"], r["correct"], r["reason"]) for r in rows] == [("a", 0, 1, None)]


def test_margins_are_state_by_buckets():
    """One call takes up many keys, known and new, over several frames; the state is their sorted margins."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rng, state, want = np.random.default_rng(7), State(), {}
    for _ in range(3):
        frames = [pd.DataFrame({"key": rng.integers(0, 60, 40), "f": rng.integers(0, 2, 40).astype("int32")}) for _ in range(2)]
        (out,) = maintained._gains(("entity", 3), iter(frames), state)
        cells, before = pd.concat(frames).groupby("key")["f"].sum(), dict(want)
        for key, gain in cells.items():
            want[key] = want.get(key, 0) + gain
        got = out.set_index("key")
        assert sorted(got.index) == sorted(cells.index) and all(got.margin[k] == want[k] and got.fresh[k] == (k not in before) and got.squares[k] == want[k] ** 2 - before.get(k, 0) ** 2 for k in got.index)
        keys, margins_ = (np.frombuffer(x, dtype=np.int64) for x in state.get)
        assert dict(zip(keys.tolist(), margins_.tolist())) == want and (np.diff(keys) > 0).all()
