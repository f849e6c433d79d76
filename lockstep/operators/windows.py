"""Ranks, rank windows, profiles and run-to-run deltas.

A global rank is a range-partitioned sort, written once, and the counts of the partitions before: no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .margins import entity_margins, item_margins
from .pairs import joint_weights


def ordinal(df: DataFrame, by: list, name: str = "rank") -> DataFrame:
    """df with its 1-based place in the order `by` (which must be total)."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in the partition
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(parts.withColumn("_part", F.spark_partition_id()).withColumn("_place", within), "ranks")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select("_part", (F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("k")).alias("_before"))  # a row a partition
    out = placed.join(F.broadcast(before), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name))


def by_accuracy(o: DataFrame) -> DataFrame:
    """entity, r, rank: most accurate (fewest failures) first, then by entity."""
    return ordinal(entity_margins(o), [F.col("r"), F.col("entity")])


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One row: correlation of ordinal ranks of x and y; ties in the order of `key`."""
    both = ordinal(ordinal(df, [F.col(x), F.col(key)], "rx"), [F.col(y), F.col(key)], "ry")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(F.col("rx").cast("double"), F.col("ry").cast("double")), 8).alias("spearman"))


def rank_windows(n: int, windows: int = 25, share: float = 0.10, least: int = 10) -> list[tuple[int, int, int]]:
    """(window, first rank, width): `windows` starts spread evenly over n ranks."""
    width = max(int(n * share), least)
    return [(k, k * (n - width) // (windows - 1) + 1, width) for k in range(windows)] if n >= width else []


def inside_windows(o: DataFrame, windows: int) -> DataFrame:
    """window, start, width, entity, r: the members of each window of accuracy ranks."""
    ranked = stored(by_accuracy(o), "ranked")
    spans = o.sparkSession.createDataFrame(rank_windows(ranked.count(), windows), "window int, start int, width int")
    return ranked.join(F.broadcast(spans), (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("width"))).select("window", "start", "width", "entity", "r")  # `windows` rows


def window_profile(o: DataFrame, windows: int = 25) -> DataFrame:
    """window, start, centre_accuracy, mean_agreement within each window of accuracy ranks: sums over entities and items of
    a window, no pairs."""
    inside = inside_windows(o, windows)
    m = item_margins(o).agg(F.count(F.lit(1)).alias("m"))
    joint = joint_weights(o, inside.select("window", "entity", F.lit(1).cast("long").alias("weight")), ["window"])
    t = inside.crossJoin(F.broadcast(m)).groupBy("window", "start", "width").agg(F.avg(1 - F.col("r") / F.col("m")).alias("accuracy"), F.sum("r").alias("all"), F.max("m").alias("m"))
    pairs = F.col("width") * (F.col("width") - 1) / 2
    same = F.col("m") * pairs - (F.col("width") - 1) * F.col("all") + 2 * F.coalesce("joint", F.lit(0.0))
    return t.join(joint, "window", "left").select("window", "start", F.round("accuracy", 8).alias("centre_accuracy"), F.round(same / (F.col("m") * pairs), 8).alias("mean_agreement"))


def residual_profile(o: DataFrame, windows: int = 25) -> DataFrame:
    """window, start, centre_accuracy, mean_residual: the mean residual correlation within each window of accuracy ranks.
    Observed shares are a sum over items, expected ones a sum over classes of margins."""
    from .residual import class_deviations, expected_in_group, fit_margins

    model, inside = fit_margins(o), inside_windows(o, windows)
    spark = o.sparkSession
    own = F.broadcast(spark.createDataFrame(list(zip(model.r.tolist(), (1 / class_deviations(model)).tolist(), strict=True)), "r long, weight double"))  # distinct margins
    joint = joint_weights(o, inside.join(own, "r").select("window", "entity", "weight"), ["window"])
    t = inside.groupBy("window", "start", "width").agg(F.avg(1 - F.col("r") / model.m).alias("accuracy"))
    classes: dict[int, dict[int, int]] = {}
    for row in inside.groupBy("window", "r").agg(F.count(F.lit(1)).alias("k")).collect():  # windows x distinct margins
        classes.setdefault(row.window, {})[row.r] = row.k
    expected = spark.createDataFrame([(w, expected_in_group(model, k)) for w, k in classes.items()], "window int, expected double")
    pairs = F.col("width") * (F.col("width") - 1) / 2
    mean = (F.coalesce("joint", F.lit(0.0)) / model.m - F.col("expected")) / pairs
    return t.join(joint, "window", "left").join(expected, "window").select("window", "start", F.round("accuracy", 8).alias("centre_accuracy"), F.round(mean, 8).alias("mean_residual"))


def profile_summary(profile: DataFrame) -> DataFrame:
    """One row: the top window's value, the median window's, and their ratio."""
    return profile.agg(F.max_by("mean_agreement", -F.col("window")).alias("top"), F.round(F.median("mean_agreement"), 8).alias("median")).select("top", "median", F.round(F.col("top") / F.col("median"), 6).alias("top_over_median"))


def window_z(profile: DataFrame, null_profiles: DataFrame) -> DataFrame:
    """z of each window's value against replicates (window, mean_agreement)."""
    null = null_profiles.groupBy("window").agg(F.avg("mean_agreement").alias("mu"), F.stddev_samp("mean_agreement").alias("sd"))
    return profile.join(null, "window").select("window", ((F.col("mean_agreement") - F.col("mu")) / F.greatest("sd", F.lit(1e-12))).alias("z"))


def runs_by_day(events: DataFrame) -> DataFrame:
    """day, bench (event type), n_models: distinct users, as monitor runs."""
    return events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("bench")).agg(F.count_distinct("user_id").alias("n_models"))


def delta_vs_previous(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("bench").orderBy("day")
    return runs.withColumn("delta", F.col("n_models") - F.lag("n_models", 1, 0).over(order))


def last_value(runs: DataFrame) -> DataFrame:
    return runs.groupBy("bench").agg(F.max_by("n_models", "day").alias("n_models"))


def autocorrelation(series: DataFrame, t: str, x: str) -> DataFrame:
    """One row: lag-1 autocorrelation of x in the order of t (without ties)."""
    s = series.select(F.col(t).alias("t"), F.col(x).alias("x"))
    centred = s.crossJoin(F.broadcast(s.agg(F.avg("x").alias("mean")))).select("t", (F.col("x") - F.col("mean")).alias("d"))
    c = ordinal(centred, [F.col("t")])
    after = c.select((F.col("rank") - 1).alias("rank"), F.col("d").alias("e"))
    return c.join(after, "rank", "left").agg(F.round(F.sum(F.col("d") * F.col("e")) / F.sum(F.col("d") * F.col("d")), 8).alias("lag1"))
