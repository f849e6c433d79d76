"""Conditioning on margins: the maximum-entropy margin model, residual correlation, participation.

The model depends on the data through distinct margins and how many entities or items have them, so only those classes
come to the driver (at most min(N, M + 1) and min(M, N + 1) rows).  What pairs are expected to share depends on their
two classes; it is an Arrow column function with the class table in its closure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import local
from .margins import entity_margins, item_margins
from .pairs import all_pairs, histogram

MAX_CELLS = 1 << 27  # of a matrix that one task may hold: 1 GB as doubles, two or three of which a fit needs


@dataclass
class MarginModel:
    n: int
    m: int
    r: np.ndarray
    nr: np.ndarray
    c: np.ndarray
    nc: np.ndarray
    alpha: np.ndarray
    beta: np.ndarray
    gap: float

    def probabilities(self) -> np.ndarray:
        """(classes of entities, classes of items)."""
        return 1 / (1 + np.exp(-(self.alpha[:, None] + self.beta)))


def fit_margins(o: DataFrame) -> MarginModel:
    """o must have no degenerate margins (trim_degenerate)."""
    rows = entity_margins(o).groupBy("r").agg(F.count(F.lit(1)).alias("k")).orderBy("r").collect()
    columns = item_margins(o).groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy("c").collect()
    r, nr = np.array([tuple(x) for x in rows]).T
    c, nc = np.array([tuple(x) for x in columns]).T
    n, m = int(nr.sum()), int(nc.sum())
    alpha, beta, gap = local.fit_classes(r, nr, c, nc, m, n)
    return MarginModel(n, m, r, nr, c, nc, alpha, beta, gap)


def parameters(o: DataFrame, model: MarginModel) -> tuple[DataFrame, DataFrame]:
    """(entity, alpha) and (item, beta): the class parameters joined back."""
    spark = o.sparkSession
    a = spark.createDataFrame(list(zip(model.r.tolist(), model.alpha.tolist(), strict=True)), "r long, alpha double")
    b = spark.createDataFrame(list(zip(model.c.tolist(), model.beta.tolist(), strict=True)), "c long, beta double")
    return entity_margins(o).join(F.broadcast(a), "r").select("entity", "alpha"), item_margins(o).join(F.broadcast(b), "c").select("item", "beta")


def expected_share(model: MarginModel):
    """Column function (ri, rj) -> expected share of items that both fail."""
    p, r, nc, m = model.probabilities(), model.r, model.nc, model.m

    @F.pandas_udf("double")
    def share(ri: pd.Series, rj: pd.Series) -> pd.Series:
        a, b = np.searchsorted(r, ri.to_numpy()), np.searchsorted(r, rj.to_numpy())
        key, back = np.unique(a * len(r) + b, return_inverse=True)
        out = np.empty(len(key))
        for at in range(0, len(key), 4096):
            x, y = np.divmod(key[at : at + 4096], len(r))
            out[at : at + 4096] = ((p[x] * p[y]) @ nc) / m
        return pd.Series(out[back])

    return share


CLASSES = 256  # different margins, whose pairs are a table


def class_shares(model: MarginModel) -> np.ndarray:
    """What two entities are expected to share, by their margins."""
    p = model.probabilities()
    return (p * model.nc) @ p.T / model.m


def class_deviations(model: MarginModel) -> np.ndarray:
    """Root of the variance that the model leaves an entity of each margin, over items."""
    p = model.probabilities()
    return np.sqrt(np.maximum(model.r / model.m - (p * p) @ model.nc / model.m, 1e-12))


def expected_in_group(model: MarginModel, members: dict[int, int]) -> float:
    """The sum over pairs of a group (members[r]: how many have margin r) of the expected share over both deviations."""
    k = np.array([members.get(int(r), 0) for r in model.r], dtype=np.float64)
    x = model.probabilities() / class_deviations(model)[:, None]
    return float(((k @ x) ** 2 - k @ (x * x)) @ model.nc / (2 * model.m))


def _sides(spark, model: MarginModel):
    """(margin column, name) -> the table of the deviations, to join by margin: distinct margins, which the driver holds."""
    classes = spark.createDataFrame(list(zip(model.r.tolist(), class_deviations(model).tolist(), strict=True)), "r long, s double")
    return lambda r, s: F.broadcast(classes.select(F.col("r").alias(r), F.col("s").alias(s)))


def residual_classes(o: DataFrame, model: MarginModel | None = None) -> DataFrame:
    """observed, expected, excess, residual, k: of the pairs of all entities, those of equal margins and count together."""
    model = model or fit_margins(o)
    share, side = expected_share(model), _sides(o.sparkSession, model)
    h = histogram(o).join(side("ra", "sa"), "ra").join(side("rb", "sb"), "rb")
    out = h.select((F.col("g") / F.col("m")).alias("observed"), share("ra", "rb").alias("expected"), "sa", "sb", "k")
    excess = F.col("observed") - F.col("expected")
    return out.select("observed", "expected", excess.alias("excess"), (excess / (F.col("sa") * F.col("sb"))).alias("residual"), "k")


PAIR_CLASSES = 1 << 17  # pairs of margins and joint counts, of which a table is broadcast (40 bytes each, about)


def _pair_table(spark, model: MarginModel) -> DataFrame | None:
    """ri, rj, g, expected, si, sj of all pairs of margins with every joint count that they allow; None where they are many."""
    r = model.r
    if len(r) > CLASSES or (counts := np.minimum.outer(r, r).ravel() + 1).sum() > PAIR_CLASSES:
        return None
    s, of = class_deviations(model), lambda x: np.repeat(x, counts)
    g = np.arange(counts.sum()) - of(np.cumsum(counts) - counts)
    columns = {"ri": np.repeat(r, len(r)), "rj": np.tile(r, len(r)), "expected": class_shares(model).ravel(), "si": np.repeat(s, len(r)), "sj": np.tile(s, len(r))}
    return spark.createDataFrame(pa.table({"g": g, **{k: of(v) for k, v in columns.items()}}))


def residual_pairs(o: DataFrame, model: MarginModel | None = None, wanted: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """i < j, observed (share), excess (observed less expected share), residual (its correlation), rounded to `digits`.  wanted:
    the counts (`pairs.counts_of`) of the pairs that matter, instead of all.  What is said of a pair depends on both margins
    and the joint count: where these are few, it is worked out and rounded once for each, and a pair looks it up by one number."""
    model = model or fit_margins(o)
    spark, names = o.sparkSession, ("observed", "excess", "residual")
    q = all_pairs(o) if wanted is None else wanted
    rounded = lambda df: df if digits is None else df.withColumns({c: F.round(c, digits) for c in names})

    def valued(q: DataFrame, expected, *keys: str) -> DataFrame:
        observed = F.col("g") / F.lit(model.m)
        out = q.select(*keys, observed.alias("observed"), (observed - expected).alias("excess"), "si", "sj")
        return rounded(out.select(*keys, "observed", "excess", (F.col("excess") / (F.col("si") * F.col("sj"))).alias("residual")))

    if (table := _pair_table(spark, model)) is not None:
        base = F.lit(int(max(model.m, model.r.max())) + 1).cast("long")
        key = ((F.col("ri") * base + F.col("rj")) * base + F.col("g")).alias("key")
        looked = valued(table.withColumn("key", key), F.col("expected"), "key")
        return q.select("i", "j", key).join(F.broadcast(looked), "key").select("i", "j", *names)
    share, side = expected_share(model), _sides(spark, model)
    if len(model.r) <= CLASSES:  # a table of pairs of margins, so that no pair goes through Python
        at, expected = model.r.tolist(), class_shares(model)
        table = pa.table({"ri": np.repeat(model.r, len(at)), "rj": np.tile(model.r, len(at)), "expected": expected.ravel()})
        q = q.join(F.broadcast(spark.createDataFrame(table)), ["ri", "rj"])
        share = lambda ri, rj: F.col("expected")
    return valued(q.join(side("ri", "si"), "ri").join(side("rj", "sj"), "rj"), share("ri", "rj"), "i", "j")


def residual_summary(o: DataFrame) -> DataFrame:
    """One row: largest margin gap of the model, rms residual, N^2 / sum R^2 (participation, negative eigenvalues kept)."""
    model = fit_margins(o)
    s = residual_classes(o, model).agg(F.sum(F.col("k") * F.col("residual") * F.col("residual")).alias("s"), F.sum("k").alias("k"))
    return s.select(F.lit(model.n).alias("n"), F.lit(model.gap < 1e-8).alias("margins_fit"), F.round(F.sqrt(F.col("s") / F.col("k")), 6).alias("rms_residual"), F.round(model.n**2 / (model.n + 2 * F.col("s")), 4).alias("participation_raw"))


def variance_terms(o: DataFrame) -> DataFrame:
    """One row: Var(C) = Var(E) + 2 Cov(E, D) + Var(D) over pairs, sample moments."""
    p = residual_classes(o)
    k, middle = F.col("k"), p.agg(*[(F.sum(F.col(c) * F.col("k")) / F.sum("k")).alias(f"mean_{c}") for c in ("observed", "expected", "excess")])
    d = {c: F.col(c) - F.col(f"mean_{c}") for c in ("observed", "expected", "excess")}
    second = lambda x, y: F.sum(k * d[x] * d[y]) / (F.sum(k) - 1)
    return p.crossJoin(F.broadcast(middle)).agg(
        second("observed", "observed").alias("var_observed"), second("expected", "expected").alias("var_expected"), second("expected", "excess").alias("covariance"), second("excess", "excess").alias("var_excess"),
        (second("expected", "excess") / F.sqrt(second("expected", "expected") * second("excess", "excess"))).alias("correlation"), F.max("mean_excess").alias("mean_excess"),
    )


def matrix(o: DataFrame) -> tuple[np.ndarray, list, list]:
    """(F, entities, items) in the driver; refused beyond MAX_CELLS before anything is collected."""
    ends = o.agg(F.count_distinct("entity").alias("n"), F.count_distinct("item").alias("m")).head()
    if ends.n * ends.m > MAX_CELLS:
        raise ValueError(f"{ends.n} x {ends.m} cells; one task takes {MAX_CELLS}")
    items = o.select("item").distinct().orderBy("item").toArrow().column(0)
    known, m = items.combine_chunks(), len(items)

    def pack(batches):
        for batch in batches:
            lists, f = batch.column("failed"), np.zeros((batch.num_rows, m), dtype=np.uint8)
            place = pc.index_in(lists.flatten(), known).to_numpy(zero_copy_only=False)
            f[np.repeat(np.arange(len(f)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), place] = 1
            yield pa.RecordBatch.from_arrays([batch.column("entity"), pa.array([x.tobytes() for x in np.packbits(f, axis=1)], pa.binary())], ["entity", "bits"])

    failed = F.collect_list(F.when(F.col("f") == 1, F.col("item")))  # without nulls
    lists = o.groupBy("entity").agg(failed.alias("failed"))
    rows = lists.mapInArrow(pack, f"entity {dict(o.dtypes)['entity']}, bits binary").orderBy("entity").toArrow()  # a bit a cell
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
    return np.unpackbits(bits, axis=1, count=m), rows.column("entity").to_pylist(), items.to_pylist()


def _whole_spectrum(o: DataFrame, raw: bool) -> DataFrame:
    """By the matrix of the entities, in one task."""
    f, _, _ = matrix(o)
    bits, shape = np.packbits(f), f.shape

    def run(batches):
        for batch in batches:
            if len(batch):
                g = np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape)
                if raw:
                    c = local.gram(g)
                    s = np.sqrt(np.diag(c))
                    w = np.linalg.eigvalsh(c / s[:, None] / s)[::-1]
                else:
                    w = local.participation(local.residual(g, local.expected_gram(local.fit(g)[0])))[3]
                yield pd.DataFrame({"place": range(len(w)), "eigenvalue": w})

    return o.sparkSession.range(0, 1, 1, 1).mapInPandas(run, "place int, eigenvalue double")


ROWS = 512  # entities that a task has as doubles at once


def _item_gram(o: DataFrame, weights: dict[int, float], more: dict[int, np.ndarray], items: pa.Array) -> DataFrame:
    """k, v: row k of G'G, summed over entities, where an entity's row of G is its failures and more[r], times weights[r]."""
    q = len(items) + len(next(iter(more.values())))

    def blocks(batches):
        total = np.zeros((q, q))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                lists, r = some.column("failed"), some.column("r").to_pylist()
                g = np.zeros((len(r), q))
                place = pc.index_in(lists.flatten(), items).to_numpy(zero_copy_only=False)
                g[np.repeat(np.arange(len(r)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), place] = 1
                g[:, len(items) :] = [more[x] for x in r]
                g *= np.array([weights[x] for x in r])[:, None]
                total += g.T @ g
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(q)), pa.array([x.tobytes() for x in total], pa.binary())], ["k", "v"])

    def sums(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                rows[k] = rows.get(k, 0) + np.frombuffer(v)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], ["k", "v"])

    failed = F.collect_list(F.when(F.col("f") == 1, F.col("item")))
    rows = o.groupBy("entity").agg(F.sum("f").cast("long").alias("r"), failed.alias("failed")).select("r", "failed")
    return rows.mapInArrow(blocks, "k long, v binary").repartition("k").mapInArrow(sums, "k long, v binary")


def _item_spectrum(o: DataFrame, raw: bool, n: int) -> DataFrame:
    """By the items: with G the entities' rows (failures, and by class of items the model's expectation), scaled, the matrix
    of the entities is G S G' with S = 1 for failures and -1 for expectations.  Its eigenvalues other than 0 are those of
    H^1/2 S H^1/2, where H = G'G is a sum over entities: blocks of them are multiplied in tasks, and no task holds more
    than items and classes squared."""
    items = o.select("item").distinct().orderBy("item").toArrow().column(0).combine_chunks()
    if raw:
        margins = [x.r for x in entity_margins(o).select("r").distinct().collect()]  # distinct margins
        weights, more = {r: 1 / np.sqrt(max(r, 1)) for r in margins}, {r: np.empty(0) for r in margins}
    else:
        model = fit_margins(o)
        own = 1 / (class_deviations(model) * np.sqrt(model.m))
        p = model.probabilities() * np.sqrt(model.nc)
        weights, more = dict(zip(model.r.tolist(), own.tolist(), strict=True)), dict(zip(model.r.tolist(), p, strict=True))
    m = len(items)

    def solve(batches):
        rows = {k: np.frombuffer(v) for b in batches for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist(), strict=True)}
        if rows:
            h = np.array([rows[k] for k in range(len(rows))])
            w = local.signed_spectrum(h, np.where(np.arange(len(h)) < m, 1.0, -1.0), n)
            yield from pa.table({"place": pa.array(np.arange(n, dtype=np.int32)), "eigenvalue": pa.array(w)}).to_batches(max_chunksize=10_000)

    return stored(_item_gram(o, weights, more, items), "gram").coalesce(1).mapInArrow(solve, "place int, eigenvalue double")


def spectrum(o: DataFrame, raw: bool = False) -> DataFrame:
    """place (from 0, falling), eigenvalue: of the residual correlation, or (raw) of joint failures normed by own ones.  By
    entities or by items, whichever are fewer; the fewer ones squared are at most MAX_CELLS."""
    ends = o.agg(F.count_distinct("entity").alias("n"), F.count_distinct("item").alias("m")).head()
    if ends.n <= ends.m:
        return _whole_spectrum(o, raw)
    if (2 * ends.m) ** 2 > MAX_CELLS:
        raise ValueError(f"{ends.m} items; their products are squared, and one task takes {MAX_CELLS} cells")
    return _item_spectrum(o, raw, ends.n)


def spectrum_summary(s: DataFrame) -> DataFrame:
    """One row from a spectrum: participation (clipped, absolute, raw), share of the first eigenvalue's square, and the
    participation without it."""
    v, w = F.greatest("eigenvalue", F.lit(0.0)), F.col("eigenvalue")
    rest = F.when(F.col("place") > 0, F.greatest("eigenvalue", F.lit(0.0))).otherwise(0.0)
    ratio = lambda x: F.pow(F.sum(x), F.lit(2)) / F.sum(x * x)
    return s.agg(
        F.count(F.lit(1)).alias("n"), F.round(ratio(v), 4).alias("clipped"), F.round(ratio(F.abs(w)), 4).alias("absolute"), F.round(ratio(w), 4).alias("raw"),
        F.round(F.max(F.when(F.col("place") == 0, v * v)) / F.sum(v * v), 6).alias("first_share"), F.round(ratio(rest), 4).alias("deflated"),
    )


def eigenvalues_above(s: DataFrame, edge: float) -> DataFrame:
    return s.agg(F.count_if(F.col("eigenvalue") > edge).alias("n_above"))


def by_cohort(o: DataFrame, cohorts: DataFrame, least_entities: int = 60, least_items: int = 50) -> DataFrame:
    """cohort, n_entities, n_items, n_eff, share: participation of each cohort, its items trimmed again, fitted again.
    A cohort is one task; cohorts are parallel."""
    sized = cohorts.groupBy("cohort").agg(F.count(F.lit(1)).alias("k")).where((F.col("k") >= least_entities) & (F.col("cohort").cast("string") != ""))
    cells = o.where("f = 1").join(cohorts, "entity").join(F.broadcast(sized.select("cohort")), "cohort").select("cohort", "entity", "item")
    sizes = {r.cohort: r.k for r in sized.collect()}

    def run(key, pdf):
        entities, ri = np.unique(pdf["entity"], return_inverse=True)
        items, ci = np.unique(pdf["item"], return_inverse=True)
        f = np.zeros((sizes[key[0]], len(items)), dtype=np.uint8)  # entities without failures are rows of zeros
        f[ri, ci] = 1
        f = f[:, f.sum(0) < len(f)]
        n, m = f.shape
        if m < least_items:
            return pd.DataFrame(columns=["cohort", "n_entities", "n_items", "n_eff", "share"])
        p = local.participation(local.residual(f, local.margin_model(f)[0]))[0]
        return pd.DataFrame([(key[0], n, m, p, p / n)], columns=["cohort", "n_entities", "n_items", "n_eff", "share"])

    kind = dict(cohorts.dtypes)["cohort"]
    return cells.groupBy("cohort").applyInPandas(run, f"cohort {kind}, n_entities long, n_items long, n_eff double, share double")
