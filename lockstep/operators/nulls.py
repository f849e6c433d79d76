"""Null models.

Hash nulls order cells by an MD5 of seed and cell, so that any engine draws the same ones; they are plain windows or
filters.  The fixed-margin null is a Markov chain, serial by nature: replicates are independent tasks, each with its own
child of the seed, the observed matrix as bits in its closure, and only statistics coming back.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import local
from .margins import trim_degenerate
from .residual import matrix
from .responses import tiebreak

TRADES = 50  # an entity, to forget the start
THIN = 5


def permute_rows(o: DataFrame, seed: int) -> DataFrame:
    """Each entity fails as many items as before, drawn anew."""
    return _permute(o, seed, "entity", "item")


def permute_columns(o: DataFrame, seed: int) -> DataFrame:
    """Each item is failed as often as before, by entities drawn anew."""
    return _permute(o, seed, "item", "entity")


WIDE = 1 << 14  # cells of a key that are ranked as one group, about


def _permute(o: DataFrame, seed: int, key: str, other: str) -> DataFrame:
    """The cells of a key are ranked by hash.  Those of a key with many are ranked in buckets of the hash's first digits, which
    have the same order, behind the sizes of the buckets before: no group grows with the table."""
    keys, others = o.groupBy(key).agg(F.sum("f").alias("s")), o.select(other).distinct()
    digits = -(-max(0, (others.count() // WIDE).bit_length()) // 4)
    bucket = F.substring(tiebreak(seed, "entity", "item"), 1, digits)
    # the dense result has all cells, which are far more than the keys that they would be partitioned like
    cells = keys.crossJoin(others).withColumn("bucket", bucket).repartition(key, "bucket")
    place = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(tiebreak(seed, "entity", "item"), other))
    ranked = cells.withColumn("k", place)
    if digits:
        sizes = keys.select(key).crossJoin(others).groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select(key, "bucket", (F.sum("n").over(Window.partitionBy(key).orderBy("bucket")) - F.col("n")).alias("before"))
        ranked = ranked.join(before, [key, "bucket"]).withColumn("k", F.col("k") + F.col("before"))
    return ranked.select("entity", "item", (F.col("k") <= F.col("s")).cast("int").alias("f"))


def uniform(seed: int, *columns: str):
    """A number in [0, 1) from 32 bits of the hash."""
    return F.conv(F.substring(tiebreak(seed, *columns), 1, 8), 16, 10).cast("double") / 4294967296.0


def bernoulli(o: DataFrame, seed: int, p: float) -> DataFrame:
    """f = 1 with probability p in every cell of o."""
    return o.select("entity", "item", (uniform(seed, "entity", "item") < p).cast("int").alias("f"))


def _replicates(spark: SparkSession, tasks: list[int], run, schema: str) -> DataFrame:
    n = len(tasks)
    ids = spark.range(0, n, 1, max(1, n))  # a task a replicate (or chain)

    def each(batches):
        for batch in batches:
            for k in batch["id"]:
                yield run(tasks[int(k)])

    return ids.mapInPandas(each, schema)


def _bits(o: DataFrame):
    f, entities, items = matrix(o)
    bits, shape = np.packbits(f), f.shape
    return (lambda: np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape)), shape, entities, items


def null_matrices(o: DataFrame, replicates: int, seed: int = 0, trades: int = TRADES) -> DataFrame:
    """rep, entity, item, f: draws with the margins of o, dense."""
    load, (n, m), entities, items = _bits(o)

    def run(k: int) -> pd.DataFrame:
        x = local.trades(load(), trades * n, np.random.default_rng([seed, k]))
        return pd.DataFrame({"rep": k, "entity": np.repeat(entities, m), "item": np.tile(items, n), "f": x.ravel().astype("int32")})

    kinds = dict(o.dtypes)
    return _replicates(o.sparkSession, list(range(replicates)), run, f"rep int, entity {kinds['entity']}, item {kinds['item']}, f int")


MATCHED = 512  # entities, about, that are matched among themselves in a sweep


def trade_sweep(rows: DataFrame, seed: int, t: int, buckets: int, within: str | None = None) -> DataFrame:
    """One global trade on rows(entity, failed): entities are dealt into buckets by a hash of seed and sweep and matched there
    in hash order; of the items that only one of a pair fails each keeps as many as before, by a hash order of the items.
    One shuffle, no Python.  within: a column of rows; only entities with one value of it are matched.  All draws come from hashes, so that a task that is repeated gives the same rows."""
    order = tiebreak_of(f"{seed}|{t}", F.col("entity"))
    dealt = rows.select("entity", "failed", order.alias("h"), *([F.col(within).alias("bucket")] if within else []))
    if within is None:
        dealt = dealt.withColumn("bucket", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "entity"))
    pairs = dealt.withColumn("pair", F.floor((place - 1) / 2)).groupBy("bucket", "pair").agg(F.array_sort(F.collect_list(F.struct("h", "entity", "failed"))).alias("two"))
    a, b = F.col("two")[0], F.try_element_at("two", F.lit(2))
    mine, other = F.array_except(a["failed"], b["failed"]), F.array_except(b["failed"], a["failed"])
    both = F.array_intersect(a["failed"], b["failed"])
    key = lambda x: tiebreak_of(f"{seed}|{t}", a["entity"], x)
    mixed = F.transform(F.array_sort(F.transform(F.concat(mine, other), lambda x: F.struct(key(x).alias("h"), x.alias("item")))), lambda s: s["item"])
    k = F.size(mine)
    rest = F.size(other)
    one = F.struct(a["entity"].alias("entity"), F.concat(both, F.slice("mixed", F.lit(1), k)).alias("failed"))
    two = F.struct(b["entity"].alias("entity"), F.concat(both, F.slice("mixed", k + 1, rest)).alias("failed"))
    alone = F.struct(a["entity"].alias("entity"), a["failed"].alias("failed"))
    traded = pairs.withColumn("mixed", F.when(F.size("two") == 2, mixed))
    kept = [F.col("bucket").alias(within)] if within else []
    return traded.select(*kept, F.explode(F.when(F.size("two") == 2, F.array(one, two)).otherwise(F.array(alone))).alias("x")).select(*([within] if within else []), "x.*")


def tiebreak_of(head: str, *values):
    return F.md5(F.concat_ws("|", F.lit(head), *[v.cast("string") for v in values]))


def null_table(o: DataFrame, seed: int = 0, trades: int = TRADES) -> DataFrame:
    """entity, item: the failing cells of one draw with the margins of o, after about `trades` trades an entity; for matrices
    of any size.  A sweep is a job whose rows are written to the shared folder; a task holds one pair of entities."""
    rows = stored(o.groupBy("entity").agg(F.collect_list(F.when(F.col("f") == 1, F.col("item"))).alias("failed")), "trade")
    buckets = max(1, rows.count() // MATCHED)
    for t in range(2 * trades):  # half the entities trade with the other half
        rows = stored(trade_sweep(rows, seed, t, buckets), "trade")
    return rows.select("entity", F.explode("failed").alias("item"))


def draws(o: DataFrame, replicates: int, seed: int, measure, schema: str, trades: int = TRADES, chains: int | None = None, thin: int = THIN, fitted: bool = True, apart: int = 0) -> DataFrame:
    """chain, t and the columns of `schema` of null draws; chain -1 is the observed matrix.  measure(f, expected, gap) gives
    the rows of one matrix.

    chains None: every replicate starts from the observed matrix.  Else `chains` chains burn in (each by `apart` trades an
    entity longer than the one before) and are thinned, which gives cheaper, autocorrelated draws.  The margin model (fitted) is that of the observed matrix: all draws have its
    margins."""
    load, (n, _), _, _ = _bits(o)
    count = replicates if chains is None else chains
    each = 1 if chains is None else -(-replicates // chains)
    names = ["chain", "t", *[c.split()[0] for c in schema.split(", ")]]

    def run(k: int) -> pd.DataFrame:
        f = load()
        expected, gap = local.margin_model(f) if fitted else (None, None)
        rng, rows = np.random.default_rng([seed, k + 1]), []
        for t in range(each if k >= 0 else 1):
            if k >= 0:
                f = local.trades(f, (trades + apart * k if t == 0 else thin) * n, rng)
            rows += [(k, t, *row) for row in measure(f, expected, gap)]
        return pd.DataFrame(rows, columns=names)

    return _replicates(o.sparkSession, list(range(-1, count)), run, f"chain int, t int, {schema}")


def null_statistics(o: DataFrame, replicates: int, seed: int = 0, trades: int = TRADES, chains: int | None = None, thin: int = THIN, residuals: bool = True) -> DataFrame:
    """chain, t, mean, dispersion, rms, participation of the observed matrix and of null draws (see `draws`).  residuals
    False leaves out rms and participation (null), which cost an eigen-solve a draw."""

    def measure(f, expected, gap):
        r = local.residual(f, expected) if residuals else None
        return [(local.mean_joint(f), local.dispersion(f), *((local.rms(r), *local.participation(r)[:3], gap) if residuals else (None,) * 5))]

    names = ["mean", "dispersion", "rms", "participation", "participation_abs", "participation_raw", "margin_gap"]
    return draws(o, replicates, seed, measure, ", ".join(f"{x} double" for x in names), trades, chains, thin, residuals)


CHAINS, CHAIN_DRAWS, APART = 4, 25, 25  # as published: chains, draws of each, trades by which burn-ins differ


def chain_draws(o: DataFrame, seed: int = 0) -> DataFrame:
    """chain, t, x: the rms residual of the draws of chains whose burn-ins differ, from the trimmed table; whether they have
    mixed is for `statistics.gelman_rubin`."""
    measure = lambda f, expected, gap: [(local.rms(local.residual(f, expected)),)]
    return draws(stored(trim_degenerate(o), "trimmed"), CHAINS * CHAIN_DRAWS, seed, measure, "x double", chains=CHAINS, apart=APART).where("chain >= 0")


def calibrated(stats: DataFrame, statistic: str, *more) -> DataFrame:
    """One row: observed, null mean and deviation, standardised effect (null if the deviation is 0), ratio, one-sided p.
    One pass over the draws, of which there are hundreds.  more: further aggregates to keep."""
    x = F.col(statistic)
    seen, null = F.when(F.col("chain") < 0, x), F.when(F.col("chain") >= 0, x)
    t = stats.agg(F.max(seen).alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), F.count(null).alias("n_null"), F.collect_list(null).alias("draws"), *more)
    above = F.size(F.filter("draws", lambda d: d >= F.col("observed")))
    return t.select(
        "observed", "null_mean", "null_sd", "n_null",
        F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")).alias("ses"),
        (F.col("observed") / F.col("null_mean")).alias("ratio"), ((1 + above) / (1 + F.col("n_null"))).alias("p"),
        *t.columns[5:],
    )


def n_effective(o: DataFrame, replicates: int = 40, seed: int = 0, trades: int = TRADES) -> DataFrame:
    """One row: the calibrated participation, with negative eigenvalues clipped, absolute and kept."""
    seen = lambda c, name: F.max(F.when(F.col("chain") < 0, F.col(c))).alias(name)
    size = o.agg(F.count_distinct("entity").alias("n_entities"))
    stats = calibrated(null_statistics(o, replicates, seed, trades), "participation", seen("participation_abs", "n_eff_abs"), seen("participation_raw", "n_eff_raw"), seen("margin_gap", "margin_gap"))
    head = ["n_entities", F.col("observed").alias("n_eff"), "n_eff_abs", "n_eff_raw", "margin_gap"]
    return size.crossJoin(stats).select(*head, *(["null_mean", "null_sd", "ses", "ratio", "n_null"] if replicates else []))


def convergence(o: DataFrame, seed: int = 0, at: tuple[int, ...] = (1, 2, 5, 10, 20, 50, 100, 200)) -> DataFrame:
    """trades an entity, changed (share of cells that differ from the start), dispersion: one chain."""
    load, (n, _), _, _ = _bits(o)

    def run(k: int) -> pd.DataFrame:
        f, rows = load(), []
        note = lambda a: lambda x: rows.append((a, float((x != f).mean()), local.dispersion(x.astype(np.uint8))))
        local.trades(f, max(at) * n, np.random.default_rng([seed, k]), {a * n: note(a) for a in at})
        return pd.DataFrame(rows, columns=["trades", "changed", "dispersion"])

    return _replicates(o.sparkSession, [0], run, "trades int, changed double, dispersion double")


RUNGS = ("fixed_margins", "rows_permuted", "columns_permuted", "bernoulli_constant", "bernoulli_rasch")


def noise_floor(o: DataFrame, replicates: int = 6, seed: int = 0, rungs: tuple[str, ...] = RUNGS, extra: bool = False) -> DataFrame:
    """rung, n, rms_mean, rms_sd and the analytic 1 / sqrt(M - 3): rms residual under several nulls.  Nulls that change
    margins are trimmed and fitted again, the fixed-margin one keeps the fit.  extra: two-parameter and factor models."""
    load, (n, m), _, _ = _bits(o)
    names = list(rungs) + (["two_parameter", *[f"factors_{q}" for q in (2, 3, 4, 5)]] if extra else [])

    def rms_refit(x: np.ndarray) -> float:
        x = local.trim(x)
        return local.rms(local.residual(x, local.margin_model(x)[0])) if min(x.shape, default=0) >= 10 else float("nan")

    def run(k: int) -> pd.DataFrame:
        name, rep = names[k // replicates], k % replicates
        f, rng = load(), np.random.default_rng([seed, k])
        if name == "fixed_margins":
            value = local.rms(local.residual(local.trades(f, TRADES * n, rng), local.margin_model(f)[0]))
        elif name == "rows_permuted":
            value = rms_refit(rng.permuted(f, axis=1))
        elif name == "columns_permuted":
            value = rms_refit(rng.permuted(f, axis=0))
        else:
            p = {"bernoulli_constant": lambda: np.full((n, 1), f.mean()), "bernoulli_rasch": lambda: local.fit(f)[0], "two_parameter": lambda: local.fit_2pl(f)}.get(name)
            p = p() if p else local.fit_factors(f, int(name[-1]), seed=rep)
            value = rms_refit(local.below(lambda at: p[at], f.shape, rng))
        return pd.DataFrame([(name, rep, value)], columns=["rung", "rep", "rms"])

    runs = _replicates(o.sparkSession, list(range(len(names) * replicates)), run, "rung string, rep int, rms double")
    out = runs.groupBy("rung").agg(F.count(F.lit(1)).alias("n"), F.avg("rms").alias("rms_mean"), F.stddev_samp("rms").alias("rms_sd"))
    return out.withColumn("analytic", F.lit(1 / math.sqrt(m - 3)))


def held_out_dimension(o: DataFrame, most: int = 4, seed: int = 0) -> DataFrame:
    """q, log_likelihood: mean over a held-out tenth of the cells, of factor models fitted with those cells at their
    margin expectation.  (0: the margin model.)"""
    load, _, _, _ = _bits(o)

    def run(q: int) -> pd.DataFrame:
        f = load()
        out = np.random.default_rng(seed).random(f.shape) < 0.1
        p, _ = local.fit(f)
        if q:
            p = local.fit_factors(np.where(out, p > 0.5, f).astype(np.uint8), q)
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return pd.DataFrame([(q, float(np.where(f == 1, np.log(p), np.log(1 - p))[out].mean()))], columns=["q", "log_likelihood"])

    return _replicates(o.sparkSession, list(range(most + 1)), run, "q int, log_likelihood double")


def detection_power(spark: SparkSession, conditions: list[tuple[str, float]], trials: int = 20, n: int = 400, m: int = 700, draws: int = 15, seed: int = 0) -> DataFrame:
    """kind, strength, power: share of trials whose rms residual is above mean + 1.6449 deviations of its null draws.  A
    task a trial."""

    def run(k: int) -> pd.DataFrame:
        kind, strength = conditions[k // trials]
        rng = np.random.default_rng([seed, k])
        f = local.trim(local.planted(kind, n, m, strength, rng))
        expected = local.expected_gram(local.fit(f)[0])
        seen = local.rms(local.residual(f, expected))
        null = [local.rms(local.residual(local.trades(f, 20 * len(f), rng), expected)) for _ in range(draws)]
        return pd.DataFrame([(kind, strength, seen > np.mean(null) + 1.6449 * np.std(null, ddof=1), (seen - np.mean(null)) / np.std(null, ddof=1))], columns=["kind", "strength", "found", "ses"])

    runs = _replicates(spark, list(range(len(conditions) * trials)), run, "kind string, strength double, found boolean, ses double")
    return runs.groupBy("kind", "strength").agg(F.count(F.lit(1)).alias("trials"), F.avg(F.col("found").cast("int")).alias("power"), F.avg("ses").alias("mean_ses"))


def synthetic(spark: SparkSession, n: int, m: int, kind: str = "rasch", strength: float = 0.0, seed: int = 0, groups: int = 8) -> DataFrame:
    """entity, item, f of a planted matrix, generated row by row in tasks from hash-seeded parameters."""

    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                source = int(i) - n // 2 if kind == "clone" and i >= n // 2 else int(i)
                items = np.random.default_rng([seed, 1])
                logits = items.normal(0, 1.5, m) + np.random.default_rng([seed, 2, source]).normal(0, 1.2)
                if kind == "groups":
                    logits = logits + strength * np.random.default_rng([seed, 3, source % groups]).normal(0, 1, m)
                u = np.random.default_rng([seed, 4, source]).random(m)
                yield pd.DataFrame({"entity": int(i), "item": np.arange(m), "f": (u < 1 / (1 + np.exp(-logits))).astype("int32")})

    return spark.range(0, n, 1, 8).mapInPandas(run, "entity long, item long, f int")


def fiber_visits(spark: SparkSession, rows: list[int], columns: list[int], draws: int, seed: int = 0, tasks: int = 8) -> tuple[DataFrame, int]:
    """(k, one row a matrix of the fiber that was drawn; number of matrices with these margins)."""
    fiber = local.enumerate_fiber(rows, columns)
    start, place = np.array(fiber[0], dtype=np.uint8), {x: i for i, x in enumerate(fiber)}

    def run(k: int) -> pd.DataFrame:
        rng, counts, x = np.random.default_rng([seed, k]), np.zeros(len(fiber), dtype=np.int64), start
        for _ in range(draws // tasks):
            x = local.trades(x, 4 * len(rows), rng)
            counts[place[tuple(map(tuple, x.tolist()))]] += 1
        return pd.DataFrame({"matrix": range(len(fiber)), "k": counts})

    visits = _replicates(spark, list(range(tasks)), run, "matrix int, k long")
    return visits.groupBy("matrix").agg(F.sum("k").alias("k")).where("k > 0"), len(fiber)
