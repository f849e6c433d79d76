"""Studies that put a statistic beside its null: variances of pairs, rank windows, kinds of chains, redundancy, panels.

A null draw is a task that returns rows of statistics; what those rows are compared by are aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import verdicts
from ..sources.storage import stored
from . import dedup, local, nulls, pairs, residual, responses, statistics, windows
from .margins import entity_margins, entity_rates, trim_degenerate

# Fixed values, equal to those of the definitions.
THRESHOLDS = (1.01, 0.99, 0.97, 0.95, 0.90)
BAND_SIZES = (3, 5, 7, 9, 11, 15, 21)
STRATEGY_SIZES = (3, 5, 7, 9, 11, 15)


def beside_null(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, observed, null_mean, null_sd, ses of the rows of `nulls.draws` (chain -1 is the observed matrix).  ses is null
    where the draws differ by rounding only."""
    seen, null = F.when(F.col("chain") < 0, F.col(value)), F.when(F.col("chain") >= 0, F.col(value))
    t = rows.groupBy(*keys).agg(F.max(seen).alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"))
    return t.withColumn("ses", F.when(F.col("null_sd") > 1e-12 * F.abs("null_mean"), (F.col("observed") - F.col("null_mean")) / F.col("null_sd")))


def reconciliation(o: DataFrame, replicates: int = 30, seed: int = 0, long_trades: int = 2000) -> DataFrame:
    """term, observed, null_mean, null_sd, ses, long_run: the terms of Var(C) = Var(E) + 2 Cov(E, D) + Var(D) beside those of
    null draws, and of one draw after `long_trades` trades an entity.  Var(E) depends on margins only and cannot move."""
    measure = lambda f, expected, gap: list(local.variance_terms(f, expected).items())
    rows = nulls.draws(o, replicates, seed, measure, "term string, value double")
    far = nulls.draws(o, 1, seed + 1, measure, "term string, value double", long_trades).where("chain = 0")
    return beside_null(rows, ["term"], "value").join(far.select("term", F.col("value").alias("long_run")), "term")


def _profile(f: np.ndarray, r: np.ndarray | local.Residual, count: int) -> list[tuple[int, float, float]]:
    """(window, accuracy, mean residual of its pairs) over ranks by failures, then by place."""
    order = np.argsort(f.sum(1, dtype=np.int64), kind="stable")
    out = []
    for k, start, width in windows.rank_windows(len(f), count):
        inside = order[start - 1 : start - 1 + width]
        if isinstance(r, local.Residual):
            total = r.within(inside)
        else:
            block = r[np.ix_(inside, inside)]
            total = float(block.sum() - np.trace(block))
        out.append((k, float(1 - f[inside].mean()), total / (width * (width - 1))))
    return out


def rank_redundancy(o: DataFrame, replicates: int = 10, count: int = 25, seed: int = 0) -> DataFrame:
    """chain, t, window, centre_accuracy, residual: mean residual correlation in windows of accuracy ranks, observed and
    null.  Draws keep margins and therefore ranks."""
    measure = lambda f, expected, gap: _profile(f, local.residual(f, expected), count)
    return nulls.draws(o, replicates, seed, measure, "window int, centre_accuracy double, residual double", chains=min(replicates, 8))


def rank_redundancy_profile(rows: DataFrame) -> DataFrame:
    """window, centre_accuracy, observed, null_mean, null_sd, z of `rank_redundancy`."""
    t = beside_null(rows, ["window"], "residual").drop("ses")
    centre = rows.where("chain < 0").select("window", "centre_accuracy")
    return centre.join(t, "window").withColumn("z", (F.col("observed") - F.col("null_mean")) / F.greatest("null_sd", F.lit(1e-12)))


def rank_redundancy_summary(rows: DataFrame) -> DataFrame:
    """One row: Spearman correlation of accuracy and residual over windows, its mean under the null, the top window, the
    median one, z of the top one, and whether redundancy rises with accuracy."""
    place = lambda c: F.row_number().over(Window.partitionBy("chain", "t").orderBy(c, "window")).cast("double")
    rho = rows.select("chain", "t", place("centre_accuracy").alias("x"), place("residual").alias("y")).groupBy("chain", "t").agg(F.corr("x", "y").alias("rho"))
    both = rho.agg(F.max(F.when(F.col("chain") < 0, F.col("rho"))).alias("spearman"), F.avg(F.when(F.col("chain") >= 0, F.col("rho"))).alias("spearman_null"))
    top = rank_redundancy_profile(rows).agg(F.max(F.when(F.col("window") == 0, F.col("observed"))).alias("top"), F.median("observed").alias("median"), F.max(F.when(F.col("window") == 0, F.col("z"))).alias("top_z"))
    return both.crossJoin(top).withColumn("rises", verdicts.redundancy_rises(F.col("spearman"), F.col("top"), F.col("median")))


def chain_comparison(o: DataFrame, replicates: int = 400, seed: int = 0, thin: int = nulls.THIN, participations: int = 60) -> DataFrame:
    """statistic, kind (independent, single), null_mean, null_sd, ses, ratio, lag1, sd_inflation: dispersion, and the
    effective number (participation) over fewer draws, against draws that each start anew and against thinned draws of one
    chain.  sd_inflation: deviation of the independent ones over this kind's."""
    out = None
    for statistic, count in (("dispersion", replicates), ("participation", participations)):
        for kind, chains, t in (("independent", None, "chain"), ("single", 1, "t")):
            rows = stored(nulls.null_statistics(o, count, seed, chains=chains, thin=thin, residuals=statistic == "participation"), f"draws-{kind}")
            lag = windows.autocorrelation(rows.where("chain >= 0"), t, statistic)
            one = nulls.calibrated(rows, statistic).crossJoin(lag).select(F.lit(statistic).alias("statistic"), F.lit(kind).alias("kind"), "observed", "null_mean", "null_sd", "ses", "ratio", "lag1", "n_null")
            out = one if out is None else out.union(one)
    first = out.where("kind = 'independent'").select("statistic", F.col("null_sd").alias("base"))
    return out.join(F.broadcast(first), "statistic").withColumn("sd_inflation", F.col("base") / F.nullif("null_sd", F.lit(0.0))).drop("base")  # two rows


def null_edge(o: DataFrame, replicates: int = 20, seed: int = 0) -> float:
    """Mean largest eigenvalue of the residual correlation of null draws."""
    measure = lambda f, expected, gap: [(float(local.participation(local.residual(f, expected))[3][0]),)]
    rows = nulls.draws(o, replicates, seed, measure, "largest double", chains=min(replicates, 8))
    return rows.where("chain >= 0").agg(F.avg("largest")).head()[0]


def redundancy_sweep(o: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, replicates: int = 10, seed: int = 0, count: int = 25) -> DataFrame:
    """threshold, n_removed, sizes, rms and participation beside null draws of the entities that are left, the mean largest
    eigenvalue of the draws (edge) and how many eigenvalues are above it, and the residual rank profile.  A threshold
    above 1 removes nothing.  The thresholds are a short list; each population is fitted and drawn anew."""
    agree = dedup.links(o, min([1.0, *thresholds]))
    n, out = entity_margins(o).count(), None

    def measure(f, expected, gap):
        r = local.residual(f, expected)
        spectrum = local.participation(r)
        steps = [(v, a) for _, a, v in _profile(f, r, count)]
        return [(local.rms(r), spectrum[0], float(spectrum[3][0]), spectrum[3].tolist(), [v for v, _ in steps], [a for _, a in steps])]

    for k, threshold in enumerate(thresholds):
        kept = dedup.keep_accurate(o, threshold, agree) if threshold <= 1 else entity_margins(o).select("entity")
        left = stored(trim_degenerate(o.join(kept, "entity", "left_semi")), "left")
        rows = stored(nulls.draws(left, replicates, seed + k, measure, "rms double, participation double, largest double, spectrum array<double>, profile array<double>, accuracy array<double>", chains=min(replicates, 8)), "draws")
        seen = rows.where("chain < 0").select(F.col("rms"), F.col("participation"), "spectrum", "profile", "accuracy")
        null = rows.where("chain >= 0").agg(F.avg("rms").alias("rms_null"), F.avg("participation").alias("participation_null"), F.avg("largest").alias("edge"))
        size = left.agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("item").alias("n_items"))
        profile = rows.where("chain < 0").select(F.posexplode(F.arrays_zip("accuracy", "profile")).alias("window", "p")).select("window", "p.accuracy", "p.profile")
        rank = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c, "window")).cast("double")  # noqa: E731  `count` rows
        shape = profile.select("window", "profile", rank("accuracy").alias("x"), rank("profile").alias("y")).agg(
            F.corr("x", "y").alias("spearman"), F.max(F.when(F.col("window") == 0, F.col("profile"))).alias("top"), F.median("profile").alias("median")
        )
        one = size.crossJoin(seen).crossJoin(null).crossJoin(shape).select(
            F.lit(float(threshold)).alias("threshold"), F.lit(n - kept.count()).alias("n_removed"), "n_entities", "n_items", "rms", "rms_null", (F.col("rms") / F.col("rms_null")).alias("rms_ratio"),
            "participation", "participation_null", (F.col("participation") / F.col("participation_null")).alias("participation_ratio"), "edge",
            F.size(F.filter("spectrum", lambda x: x > F.col("edge"))).alias("n_above_edge"), "spearman", "top", "median", (F.col("top") / F.nullif("median", F.lit(0.0))).alias("top_over_median"),
        )
        out = one if out is None else out.union(one)
    return stored(out, "sweep")


def duplication_verdict(sweep: DataFrame, full: float, reduced: float) -> DataFrame:
    """statistic, full, reduced, move_factor, driven: how far each statistic of a sweep moves between two thresholds."""
    names = ("rms_ratio", "participation_ratio", "n_above_edge")
    at = lambda c, t: F.max(F.when(F.col("threshold") == t, F.col(c).cast("double")))
    wide = sweep.agg(*[e for c in names for e in (at(c, full).alias(f"{c}_full"), at(c, reduced).alias(f"{c}_reduced"))])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(f"{c}_full").alias("full"), F.col(f"{c}_reduced").alias("reduced")) for c in names])).alias("s")).select("s.*")
    count = F.col("statistic") == "n_above_edge"
    below = F.when(count, F.greatest("reduced", F.lit(1.0))).otherwise(F.col("reduced"))
    return long.withColumn("move_factor", F.when((F.col("full") > 0) & (below > 0), F.greatest(F.col("full") / below, below / F.col("full")))).withColumn(
        "driven", F.coalesce(verdicts.duplication_driven(F.col("move_factor")), ~count)
    )


def band_panels(o: DataFrame, sizes: tuple[int, ...] = BAND_SIZES, draws: int = 6000, width: float = 0.25, seed: int = 0) -> DataFrame:
    """panel, size, entity: `draws` panels over the sizes, each drawn without repetition from a random band of accuracy,
    lo <= accuracy <= lo + width; from all entities where the band has too few.  Sizes above the number of entities are
    left out.  Only the distinct margins come to the driver; a member is a rank there and an entity after a join."""
    m = o.agg(F.count_distinct("item")).head()[0]
    classes = entity_margins(o).groupBy("r").agg(F.count(F.lit(1)).alias("k")).orderBy("r").collect()
    accuracy, ends = 1 - np.array([c.r for c in classes]) / m, np.cumsum([c.k for c in classes])
    starts, n, rng, rows = ends - np.array([c.k for c in classes]), int(ends[-1]), np.random.default_rng(seed), []
    for size in sizes:
        for _ in range(draws // len(sizes) if size <= n else 0):
            low = rng.uniform(0, 1 - width)
            inside = np.flatnonzero((accuracy >= low) & (accuracy <= low + width))
            a, b = (int(starts[inside[0]]), int(ends[inside[-1]])) if len(inside) else (0, 0)
            a, b = (a, b) if b - a >= size else (0, n)
            panel = rows[-1][0] + 1 if rows else 0
            rows += [(panel, size, int(x) + a + 1) for x in rng.choice(b - a, size, replace=False)]
    members = o.sparkSession.createDataFrame(rows, "panel int, size int, rank long")
    return members.join(windows.by_accuracy(o).select("entity", "rank"), "rank").select("panel", "size", "entity")


def halves(r: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failures on the selection half, responses on the evaluation half, key): the halves split the items with a key, so
    that no choice is judged on the items that made it."""
    gold = stored(responses.recover_gold(r).where("gold >= 0").select("item", "gold"), "gold")
    half = stored(responses.item_halves(gold, seed), "halves")
    on = lambda k: half.where(F.col("half") == k).select("item")
    chosen = r.join(on(1), "item", "left_semi").select("entity", "item", (1 - F.col("acc")).cast("int").alias("f"))
    return stored(trim_degenerate(chosen), "selection"), stored(r.join(on(2), "item", "left_semi"), "evaluation"), gold.join(on(2), "item", "left_semi")


def panel_measures(o: DataFrame, panels: DataFrame) -> DataFrame:
    """panel, size, member_accuracy, residual, disagreement, double_fault: means over members and their pairs.  Only pairs
    that sit in a panel are counted."""
    two = panels.select("panel", F.col("entity").alias("i")).join(panels.select("panel", F.col("entity").alias("j")), "panel").where("i < j")
    counts = stored(pairs.counts_of(o, two), "panel-pairs")
    values = residual.residual_pairs(o, wanted=counts).select("i", "j", "residual").join(counts, ["i", "j"])
    per_pair = two.join(values, ["i", "j"]).groupBy("panel").agg(
        F.avg("residual").alias("residual"), F.avg((F.col("ri") + F.col("rj") - 2 * F.col("g")) / F.col("m")).alias("disagreement"), F.avg(F.col("g") / F.col("m")).alias("double_fault")
    )
    own = panels.join(entity_rates(o), "entity").groupBy("panel", "size").agg((1 - F.avg("p")).alias("member_accuracy"))
    return own.join(per_pair, "panel")


def panel_study(r: DataFrame, sizes: tuple[int, ...] = BAND_SIZES, draws: int = 6000, seed: int = 0) -> DataFrame:
    """The measures of banded panels on one half of the items, and `vote`, their majority's accuracy on the other half."""
    o, other, gold = halves(r, seed)
    panels = stored(band_panels(o, sizes, draws, seed=seed), "panels")
    votes = responses.majority_vote(other, panels.select("panel", "entity"), gold, seed)
    return stored(panel_measures(o, panels).join(votes.select("panel", F.col("accuracy").alias("vote")), "panel"), "study")


def incremental_models(study: DataFrame) -> DataFrame:
    """model, r2, gain, rank, partial_f, q, p, coefficient (of the last variable), adds: nested regressions of the vote on
    size and accuracy (M0), also on disagreement and double fault (M1), also on the residual (M2), and M0 with one measure
    alone.  Predictors are standardised."""
    base, classical = ["member_accuracy", "size"], ["disagreement", "double_fault"]
    z = statistics.zscored(study.select("vote", *[F.col(c).cast("double").alias(c) for c in (*base, *classical, "residual")]), [*base, *classical, "residual"]).na.fill(0.0)
    m0, m1, m2, only_r, only_d = (statistics.ols(z, "vote", base + x) for x in ([], classical, [*classical, "residual"], ["residual"], ["double_fault"]))
    rows = [("M0", m0["r2"], None, m0["rank"], None, None, None, None, None)]
    for name, small, large in (("M1", m0, m1), ("M2", m1, m2), ("M0+residual", m0, only_r), ("M0+double_fault", m0, only_d)):
        f, q, p = statistics.partial_f(small, large)
        gain, last = large["r2"] - small["r2"], large["coefficients"][-1]
        rows.append((name, large["r2"], gain, large["rank"], f, q, p, last, verdicts.adds_information(p, gain) if name == "M2" else None))
    return study.sparkSession.createDataFrame(rows, "model string, r2 double, gain double, rank int, partial_f double, q int, p double, coefficient double, adds boolean")


STRATEGIES = ("random", "top_accuracy", "gated_disagreement", "gated_residual", "all_disagreement", "all_residual")


def strategy_members(o: DataFrame, size: int, gate: int, seed: int = 0) -> DataFrame:
    """strategy, place (from 0), entity, pair_residual: the members in the order in which they are chosen, and the mean
    residual of all pairs up to that place.  A panel of k is the first k places.  Gated strategies choose among the `gate`
    most accurate entities; diversity starts at the most accurate one.  One task, which holds the outcome matrix and, of pairs, a member's row."""
    load, (n, _), entities, _ = nulls._bits(o)

    def run(k: int) -> pd.DataFrame:
        f, rows = load(), []
        r, differ = local.residual(f, local.margin_model(f, dense=False)[0]), local.Differences(f)
        order = np.argsort(differ.fails, kind="stable")
        pool = order[: min(gate, n)]
        among = lambda sim, sign: [int(pool[x]) for x in local.least_similar(sim, 0, size, sign)]
        chosen = {
            "random": np.random.default_rng([seed, 0]).permutation(n)[:size].tolist(), "top_accuracy": order[:size].tolist(),
            "gated_disagreement": among(local.Differences(f[pool]), -1), "gated_residual": among(r.take(pool), 1),
            "all_disagreement": local.least_similar(differ, int(order[0]), size, -1), "all_residual": local.least_similar(r, int(order[0]), size, 1),
        }
        for name in STRATEGIES:
            for place, x in enumerate(chosen[name]):
                inside = chosen[name][: place + 1]
                rows.append((name, place, entities[x], r.within(np.array(inside)) / (place * (place + 1)) if place else None))
        return pd.DataFrame(rows, columns=["strategy", "place", "entity", "pair_residual"])

    return nulls._replicates(o.sparkSession, [0], run, f"strategy string, place int, entity {dict(o.dtypes)['entity']}, pair_residual double")


def panel_strategies(r: DataFrame, sizes: tuple[int, ...] = STRATEGY_SIZES, gate: int = 100, splits: int = 8, seed: int = 0) -> DataFrame:
    """split, size, strategy, vote, member_accuracy (both on the evaluation half), pair_residual (on the selection half)."""
    spark, out = r.sparkSession, None
    wanted = spark.createDataFrame([(s,) for s in sizes], "size int")
    for split in range(splits):  # a few random halves of the items
        o, other, gold = halves(r, seed + split)
        members = stored(strategy_members(o, max(sizes), gate, seed + split), "members")
        panels = members.join(F.broadcast(wanted), F.col("place") < F.col("size")).withColumn("panel", F.concat_ws("|", "strategy", "size"))  # rows of `sizes`
        rates = other.groupBy("entity").agg(F.avg("acc").alias("rate"))
        own = panels.join(rates, "entity", "left").groupBy("panel", "strategy", "size").agg(F.avg("rate").alias("member_accuracy"), F.max_by("pair_residual", "place").alias("pair_residual"))
        votes = responses.majority_vote(other, panels.select("panel", "entity"), gold, seed + split)
        one = own.join(votes.select("panel", F.col("accuracy").alias("vote")), "panel").select(F.lit(split).alias("split"), "size", "strategy", "vote", "member_accuracy", "pair_residual")
        one = stored(one, "strategies")
        out = one if out is None else out.union(one)
    return out


def strategy_contrast(rows: DataFrame, draws: int = 20000, seed: int = 0) -> DataFrame:
    """size, difference, low, high, positive, member_gap: votes of the gated residual panel less those of the gated
    disagreement panel, paired by split, with a bootstrap interval; member_gap is that of the members' accuracy."""
    pick = lambda c, s: F.max(F.when(F.col("strategy") == s, F.col(c)))
    gap = lambda c: pick(c, "gated_residual") - pick(c, "gated_disagreement")
    d = rows.groupBy("size", "split").agg(gap("vote").alias("d"), gap("member_accuracy").alias("g"))
    means = d.groupBy("size").agg(F.avg("d").alias("difference"), F.avg("g").alias("member_gap"))
    return means.join(statistics.bootstrap_mean(d, "split", "d", draws, seed, ["size"]).drop("mean"), "size").withColumn("positive", verdicts.interval_positive(F.col("low")))
