"""Regressions and test statistics over small derived tables; every one is a single aggregate over its input."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType


def slope(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.round(F.regr_slope(y, x), 8).alias("slope"), F.round(F.corr(y, x), 8).alias("correlation"))


def poisson_cuts(most: int = 8) -> list[float]:
    """The distribution function of a Poisson count of mean 1 at 0, 1, ..."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


def _weights(seed: int, key: str, draws: int) -> np.ndarray:
    """The Poisson weights of a row in all draws, of mean 1, by a hash of seed, draw and row."""
    tail, md5 = f"|{key}".encode(), hashlib.md5
    hashed = b"".join([md5(head + tail).digest()[:4] for head in _heads(seed, draws)])
    return np.searchsorted(CUTS, np.frombuffer(hashed, ">u4") / 4294967296.0, side="right")


@lru_cache(maxsize=4)
def _heads(seed: int, draws: int) -> list[bytes]:
    return [b"%d|%d" % (seed, d) for d in range(draws)]


CUTS = np.array(poisson_cuts())

WEIGHTS = 1 << 23  # that a task hashes, about
GROUPS = 64  # whose sums a task holds at once


def weighted_sums(df: DataFrame, key: str, columns: dict, draws: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """by, draw, w (sum of the weights), and for each column the weighted sum.  A task keeps one vector of `draws` sums a
    column and group, and puts out these alone: a row is never made into `draws` rows."""
    by = by or []
    names = list(columns)
    rows = df.select(*by, F.col(key).cast("string").alias("_key"), *[c.cast("double").alias(f"_{n}") for n, c in columns.items()])
    rows = rows.repartition(max(1, -(-df.count() * draws // WEIGHTS)))  # a small file is one partition, and much work

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            for group, total in sums.items():
                given = [pa.array([g] * draws, kinds[i]) for i, g in enumerate(group)]
                yield pa.RecordBatch.from_arrays([*given, pa.array(np.arange(draws, dtype=np.int32)), *(pa.array(t) for t in total)], [*by, "draw", "w", *names])
            sums.clear()

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            groups = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            values = np.column_stack([np.ones(batch.num_rows), *(batch.column(f"_{n}").to_numpy(zero_copy_only=False) for n in names)])
            for group, k, x in zip(groups, batch.column("_key").to_pylist(), values, strict=True):
                if np.isnan(x).any():
                    continue
                if group not in sums:
                    if len(sums) >= GROUPS:
                        yield from flush()
                    sums[group] = np.zeros((len(names) + 1, draws))
                sums[group] += x[:, None] * _weights(seed, k, draws)
        yield from flush()

    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("draw", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in ("w", *names))])
    return rows.mapInArrow(run, schema).groupBy(*by, "draw").agg(*[F.sum(n).alias(n) for n in ("w", *names)])


def _interval(x: str, name: str) -> list:
    return [F.round(F.avg(x), 8).alias(name), F.round(F.percentile(x, F.lit(0.025)), 8).alias("low"), F.round(F.percentile(x, F.lit(0.975)), 8).alias("high")]


def bootstrap_mean(df: DataFrame, key: str, x: str, draws: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """One row (a row a group of `by`): mean and 95 % interval of Poisson-bootstrap means.  Weights come from a hash of
    seed, draw and row, by the inverse distribution function, so that a draw needs no shuffle of rows; rows without x or
    with NaN have no weight."""
    by = by or []
    means = weighted_sums(df, key, {"x": F.col(x)}, draws, seed, by).select(*by, (F.col("x") / F.nullif(F.col("w"), F.lit(0.0))).alias("mean"))
    return means.groupBy(*by).agg(*_interval("mean", "mean"))


def bootstrap_slope(df: DataFrame, key: str, y: str, x: str, draws: int = 400, seed: int = 0) -> DataFrame:
    """One row: mean and 95 % interval of Poisson-bootstrap slopes of y on x."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = weighted_sums(df, key, {"a": a, "b": b, "aa": a * a, "ab": a * b}, draws, seed)
    slopes = sums.select(((F.col("ab") * F.col("w") - F.col("a") * F.col("b")) / F.nullif(F.col("aa") * F.col("w") - F.col("a") * F.col("a"), F.lit(0.0))).alias("slope"))
    return slopes.agg(*_interval("slope", "slope"))


def gelman_rubin(draws: DataFrame) -> DataFrame:
    """One row: R-hat of draws(chain, t, x)."""
    chains = draws.groupBy("chain").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("w"), F.count(F.lit(1)).alias("n"))
    t = chains.agg(F.var_samp("mean").alias("b"), F.avg("w").alias("w"), F.max("n").alias("n"))
    return t.select(F.round(F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w")), 8).alias("r_hat"))


@F.pandas_udf(DoubleType())
def erfc(x):
    return x.map(math.erfc)


def chi_square_uniform(counts: DataFrame, cells: int) -> DataFrame:
    """One row: chi-square of counts(k) against equal frequencies in `cells` cells (those not listed count 0), and its
    upper tail by the cube-root normal approximation."""
    t = counts.agg(F.sum("k").cast("double").alias("n"), F.sum(F.col("k") * F.col("k")).cast("double").alias("kk"))
    chi = F.col("kk") * cells / F.col("n") - F.col("n")
    df = cells - 1
    z = (F.pow(F.col("chi") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return t.select(chi.alias("chi")).select(F.round("chi", 8).alias("chi_square"), F.lit(df).alias("df"), F.round(0.5 * erfc(z / math.sqrt(2)), 8).alias("p"))


def normal_equations(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n with a constant, in one aggregate whatever the number of rows."""
    columns = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    k = len(columns)
    sums = [F.sum(columns[a] * columns[b]).alias(f"s{a}_{b}") for a in range(k) for b in range(a, k)]
    row = df.agg(*sums).head()
    full = np.zeros((k, k))
    for a in range(k):
        for b in range(a, k):
            full[a, b] = full[b, a] = row[f"s{a}_{b}"]
    return full[:-1, :-1], full[:-1, -1], float(full[-1, -1]), int(full[0, 0])


def ols(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Least squares with a rank check: coefficients (minimum norm if rank-deficient), rank, R^2, residual sum, n."""
    a, b, yy, n = normal_equations(df, y, xs)
    values, vectors = np.linalg.eigh(a)
    good = values > values.max() * 1e-12
    beta = vectors[:, good] @ ((vectors[:, good].T @ b) / values[good])
    rss = max(0.0, yy - float(beta @ b))
    return {"coefficients": beta.tolist(), "rank": int(good.sum()), "r2": float(1 - rss / (yy - b[0] ** 2 / n)), "rss": float(rss), "n": n}


def partial_f(small: dict, large: dict) -> tuple[float, int, float]:
    """F of the larger of two nested models, its numerator degrees by rank, and the upper tail by the cube-root normal
    approximation."""
    q, df = large["rank"] - small["rank"], large["n"] - large["rank"]
    if q <= 0:
        return 0.0, 0, 1.0
    if df <= 0 or large["rss"] <= 1e-12 * max(small["rss"], 1e-300):
        return math.inf, q, 0.0
    f = (small["rss"] - large["rss"]) / q / (large["rss"] / df)
    third = max(f, 0.0) ** (1 / 3)
    z = (third * (1 - 2 / (9 * df)) - (1 - 2 / (9 * q))) / math.sqrt(2 / (9 * q) + third * third * 2 / (9 * df))
    return float(f), q, 0.5 * math.erfc(z / math.sqrt(2))


def zscored(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column centred and divided by its population deviation."""
    stats = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*[(F.col(c) - F.col(f"{c}_m")) / F.nullif(f"{c}_s", F.lit(0.0)) if c in columns else F.col(c) for c in df.columns]).toDF(*df.columns)


def log_likelihood(df: DataFrame, p: str, f: str) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    return df.agg(F.avg(F.when(F.col(f) == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("mean_log_likelihood"))
