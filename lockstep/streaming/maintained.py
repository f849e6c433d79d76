"""Margins that are maintained as results come in, and the monitor's time series.

A run takes up what is new in a folder of result files (trigger availableNow) in one streaming query:
- the first sight of each (entity, item, f) passes a keyed deduplication, in the JVM; that is all that is kept of cells;
- of what passes, the margins of entities and of items are state, by buckets of their keys, and each key that is touched puts
  out what its margin gains: 1 if it is new, the failures, and the difference of the squares;
- a batch's gains are one row of sums, in a folder named after the batch, so that a batch which is repeated writes the same.
The joint-failure record follows from the sums of those rows.  So a run costs what its new cells cost, and a copy
of the margins in the buckets that it touches; no cell and no margin is ever aggregated again.  For states beyond the executors' memory set spark.sql.streaming.stateStore.providerClass to
Spark's RocksDB provider.

The time series has a folder for each (run, batch): the measured rows with their change against the run before and their
changelog line, written by one commit.  A run that is repeated replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.margins import record_of_totals
from ..sources.storage import exists

GAINS = "kind string, key long, fresh long, failures long, squares long, margin long"
BUCKETS = 128  # of the keys of either kind, each a row of state: a batch calls Python by buckets, not by keys


def _gains(at: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """What the margins of a bucket's keys gain by new cells; its state is the sorted keys and their margins."""
    keys, margins = (np.frombuffer(x, dtype=np.int64) for x in (state.get if state.exists else (b"", b"")))
    found, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        found, place = np.unique(np.concatenate([found, b["key"].to_numpy()]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, np.concatenate([sums, b["f"].to_numpy().astype(np.int64)]))
        sums = total
    place = np.searchsorted(keys, found)
    known = np.zeros(len(found), dtype=bool) if not len(keys) else keys[np.minimum(place, len(keys) - 1)] == found
    before = np.zeros(len(found), np.int64)
    before[known] = margins[place[known]]
    after = before + sums
    margins = margins.copy()
    margins[place[known]] = after[known]
    new = place[~known]
    state.update((np.insert(keys, new, found[~known]).tobytes(), np.insert(margins, new, after[~known]).tobytes()))
    yield pd.DataFrame({"kind": at[0], "key": found, "fresh": (~known).astype(np.int64), "failures": sums, "squares": after * after - before * before, "margin": after})


def take_up(cells: DataFrame, state: str) -> None:
    """One run over a stream of (entity, item, f), f in 0 and 1, entities and items integers; ends when all is read."""
    first = cells.select(F.col("entity").cast("long").alias("entity"), F.col("item").cast("long").alias("item"), F.col("f").cast("int").alias("f")).dropDuplicates(["entity", "item", "f"])
    ends = F.explode(F.array(F.struct(F.lit("entity").alias("kind"), F.col("entity").alias("key")), F.struct(F.lit("item").alias("kind"), F.col("item").alias("key"))))
    margins = first.select(ends.alias("end"), "f").select("end.kind", "end.key", "f", F.pmod(F.xxhash64("end.key"), F.lit(BUCKETS)).alias("bucket"))
    gains = margins.groupBy("kind", "bucket").applyInPandasWithState(_gains, GAINS, "keys binary, margins binary", "append", "NoTimeout")

    def put(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, f"{state}/margins/batch={number}"
        batch.select("kind", "key", "margin", "fresh", "failures", "squares").write.mode("overwrite").parquet(rows)
        of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("long")
        sums = [of("entity", "fresh").alias("n"), of("item", "fresh").alias("m"), of("item", "failures").alias("sc"), of("item", "squares").alias("scc"), of("entity", "squares").alias("srr")]
        spark.read.parquet(rows).agg(*sums).coalesce(1).write.mode("overwrite").parquet(f"{state}/sums/batch={number}")

    query = gains.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def sums(spark: SparkSession, state: str) -> DataFrame:
    """One row: n, m, sc, scc, srr as of the last run; a row a batch is read."""
    names = ("n", "m", "sc", "scc", "srr")
    if not exists(spark, f"{state}/sums"):
        return spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in names])
    return spark.read.schema(", ".join(f"{c} long" for c in names) + ", batch long").parquet(f"{state}/sums").agg(*[F.sum(c).alias(c) for c in names])


def margins(spark: SparkSession, state: str, kind: str) -> DataFrame:
    """key, margin of all entities or items as of the last run."""
    rows = spark.read.schema("kind string, key long, margin long, batch long").parquet(f"{state}/margins")
    return rows.where(F.col("kind") == kind).groupBy("key").agg(F.max("margin").alias("margin"))


def record(spark: SparkSession, state: str) -> DataFrame:
    """The joint-failure record as of the last run."""
    return record_of_totals(sums(spark, state))


# --- the time series ----------------------------------------------------------------------------------------------------

SERIES = "bench string, n_models long, n_items long, mean_joint double, naive_excess_e6 double, n_models_delta long, line string"


def publish(measured: DataFrame, state: str, run: str, batch: int = 0) -> None:
    """Adds measured(bench, n_models, n_items, mean_joint, naive_excess_e6) as the rows of a run (a name that sorts by time)
    and batch: with the change against the newest run before this one, and a changelog line.  The same run and batch again
    replaces them."""
    spark = measured.sparkSession
    before = _read(spark, state)
    if before is not None:
        newest = Window.partitionBy("bench").orderBy(F.desc("run"), F.desc("batch"))
        before = before.where(F.col("run") < run).withColumn("k", F.row_number().over(newest)).where("k = 1").select("bench", F.col("n_models").alias("known"))
        measured = measured.join(before, "bench", "left")
    else:
        measured = measured.withColumn("known", F.lit(None).cast("long"))
    rows = measured.withColumn("n_models_delta", F.col("n_models") - F.coalesce("known", F.lit(0))).drop("known")
    line = F.format_string("- %s %s: %d models (%+d), %d items, mean joint failure %.6f", F.lit(run), "bench", "n_models", "n_models_delta", "n_items", "mean_joint")
    names = [f.split()[0] for f in SERIES.split(", ")]
    rows.withColumn("line", line).select(*names).coalesce(1).write.mode("overwrite").parquet(f"{state}/series/run={run}/batch={batch}")


def _read(spark: SparkSession, state: str) -> DataFrame | None:
    if not exists(spark, f"{state}/series"):
        return None
    return spark.read.schema(SERIES + ", run string, batch long").parquet(f"{state}/series")


def series(spark: SparkSession, state: str) -> DataFrame:
    """run, batch, bench, n_models, n_items, mean_joint, naive_excess_e6, n_models_delta, line of all runs."""
    found = _read(spark, state)
    return spark.createDataFrame([], SERIES + ", run string, batch long") if found is None else found
