"""Margins, trimming, domain checks, and the mean statistics that depend on margins alone.

N and M are the numbers of distinct entities and items.  Means over pairs never need pairs: they are two group-bys with
map-side sums and a one-row join of their totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_margins(o: DataFrame) -> DataFrame:
    return o.groupBy("item").agg(F.sum("f").cast("long").alias("c"))


def entity_margins(o: DataFrame) -> DataFrame:
    return o.groupBy("entity").agg(F.sum("f").cast("long").alias("r"))


def entity_rates(o: DataFrame) -> DataFrame:
    """entity, r, p = r / M."""
    m = item_margins(o).agg(F.count(F.lit(1)).alias("m"))
    return entity_margins(o).crossJoin(F.broadcast(m)).select("entity", "r", (F.col("r") / F.col("m")).alias("p"))


def totals(o: DataFrame) -> DataFrame:
    """One row: n, m and the sums of c, c^2, r, r^2, all exact integers."""
    items = item_margins(o).agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("sc"), F.sum(F.col("c") * F.col("c")).alias("scc"))
    entities = entity_margins(o).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("r")).alias("srr"))
    return items.crossJoin(entities)


def _d(name: str):
    return F.col(name).cast("double")


def mean_joint():
    """Mean over ordered pairs of the share of items that both fail."""
    return (_d("scc") - _d("sc")) / (_d("m") * _d("n") * (_d("n") - 1))


def expected_joint():
    return (_d("sc") * _d("sc") - _d("srr")) / (_d("m") * _d("m") * _d("n") * (_d("n") - 1))


def margin_artifact():
    mean = _d("sc") / (_d("m") * _d("n"))
    var_items = _d("scc") / (_d("m") * _d("n") * _d("n")) - mean * mean
    var_entities = _d("srr") / (_d("n") * _d("m") * _d("m")) - mean * mean
    return (_d("n") * var_items + var_entities - mean * (1 - mean)) / (_d("n") - 1)


def joint_failure_record(o: DataFrame) -> DataFrame:
    """mean_joint, naive_excess, its closed form from margins, and whether the two agree."""
    return record_of_totals(totals(o))


def record_of_totals(t: DataFrame) -> DataFrame:
    """The record of one row of `totals`, wherever its sums come from."""
    t = t.select("n", "m", mean_joint().alias("mean_joint"), (mean_joint() - expected_joint()).alias("excess"), margin_artifact().alias("closed"))
    return t.select(
        F.col("n").alias("n_entities"),
        F.col("m").alias("n_items"),
        F.round("mean_joint", 10).alias("mean_joint"),
        F.round(F.col("excess") * 1e6, 4).alias("naive_excess_e6"),
        F.round(F.col("closed") * 1e6, 4).alias("margin_artifact_e6"),
        (F.abs(F.col("excess") - F.col("closed")) < 1e-9).alias("closed_form_holds"),
    )


def decomposition(o: DataFrame) -> DataFrame:
    """How much of the naive excess the margins explain, measured."""
    t = totals(o).select((mean_joint() - expected_joint()).alias("naive"), margin_artifact().alias("explained"))
    return t.select(F.round(F.col("naive") * 1e6, 4).alias("naive_e6"), F.round(F.col("explained") * 1e6, 4).alias("explained_e6"), (F.abs(F.col("naive") - F.col("explained")) < 1e-9).alias("all_explained"))


def trim_degenerate(o: DataFrame, columns_first: bool = False) -> DataFrame:
    """Without entities, then items, whose failures are none or all of what is left.  One pass, not to a fixpoint."""
    for key, other in ([("item", "entity"), ("entity", "item")] if columns_first else [("entity", "item"), ("item", "entity")]):
        size = o.select(other).distinct().agg(F.count(F.lit(1)).alias("size"))
        sums = o.groupBy(key).agg(F.sum("f").alias("s")).crossJoin(F.broadcast(size)).where("s > 0 AND s < size").select(key)
        o = o.join(sums, key, "left_semi")
    return o.select("entity", "item", "f")


def min_support(o: DataFrame, least_items: int, least_entities: int) -> DataFrame:
    """Cells of entities with at least `least_items` cells and of items with at least `least_entities` cells of those."""
    rich = o.groupBy("entity").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least_items).select("entity")
    left = o.join(rich, "entity", "left_semi")
    common = left.groupBy("item").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least_entities).select("item")
    return left.join(common, "item", "left_semi").select(*o.columns)


def domain_check(o: DataFrame) -> DataFrame:
    """One row: cells, cells outside {0, 1}, cells given twice."""
    cells = o.groupBy("entity", "item").agg(F.count(F.lit(1)).alias("k"), F.sum((~F.col("f").isin(0, 1) | F.col("f").isNull()).cast("int")).alias("bad"))
    return cells.agg(F.sum("k").alias("n_cells"), F.sum("bad").alias("n_not_binary"), F.sum((F.col("k") > 1).cast("long")).alias("n_repeated"))


def require_binary(o: DataFrame) -> DataFrame:
    """o, or an error when it is computed if a value is outside {0, 1}."""
    bad = ~F.col("f").isin(0, 1) | F.col("f").isNull()
    return o.withColumn("f", F.when(bad, F.raise_error(F.lit("outcomes must be 0 or 1")).cast("int")).otherwise(F.col("f")))


def flip(correct: DataFrame) -> DataFrame:
    return correct.select("entity", "item", (1 - F.col("correct")).alias("f"))


def rowcount_guard(o: DataFrame) -> DataFrame:
    """entity, n_rows, status: kept, or why it is rejected (another number of rows than most; a value outside {0, 1})."""
    counts = o.groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col("f").isin(0, 1).cast("int")).alias("binary"))
    mode = counts.groupBy("n_rows").agg(F.count(F.lit(1)).alias("k")).agg(F.max_by("n_rows", F.struct("k", -F.col("n_rows"))).alias("mode"))
    out = counts.crossJoin(F.broadcast(mode))
    reason = F.when(F.col("n_rows") != F.col("mode"), F.concat(F.lit("rowcount:"), F.col("n_rows"), F.lit("!="), F.col("mode")))
    return out.select("entity", "n_rows", F.coalesce(reason, F.when(F.col("binary") == 0, F.lit("non-binary")), F.lit("kept")).alias("status"))


def margins_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both margins of two outcome tables are the same."""
    gaps = []
    for key in ("entity", "item"):
        left = a.groupBy(key).agg(F.sum("f").alias("x")).where("x > 0")
        right = b.groupBy(key).agg(F.sum("f").alias("y")).where("y > 0")
        gaps.append(left.join(right, key, "full_outer").select((F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).alias("gap")))
    return gaps[0].union(gaps[1]).agg(F.coalesce(F.max(F.abs("gap")), F.lit(0)).alias("largest_gap")).select("largest_gap", (F.col("largest_gap") == 0).alias("equal"))


def fraction_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("f", "g"), ["entity", "item"], "full_outer")
    return both.agg(F.round(F.avg((F.coalesce("f", F.lit(0)) != F.coalesce("g", F.lit(0))).cast("int")), 10).alias("fraction_changed"))


def closed_form_terms(o: DataFrame) -> DataFrame:
    """n, m, mean, naive, forced: unrounded."""
    return totals(o).select("n", "m", mean_joint().alias("mean"), (mean_joint() - expected_joint()).alias("naive"), margin_artifact().alias("forced"))
