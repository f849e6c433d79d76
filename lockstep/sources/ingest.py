"""Ingest: result files of several layouts, manifests, lineage, incremental selection, and the report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import first_argmax, parents, retryable, text_key
from ..operators.windows import ordinal


def read_correctness(spark: SparkSession, path: str, metric: str = "acc", model: str = "model", position: str = "item") -> DataFrame:
    """entity, item, correct from Parquet where the metric is a column or a field of a `metrics` struct; only that is read."""
    df = spark.read.parquet(path)
    kind = df.schema["metrics"].dataType if "metrics" in df.columns else None
    value = F.col(f"metrics.{metric}") if isinstance(kind, StructType) and metric in kind.names else F.col(metric)
    return df.select(F.col(model).alias("entity"), F.col(position).alias("item"), _number(value).alias("correct"))


def _number(value):
    """A metric as a number; the words true and false count as 1 and 0."""
    text = F.lower(value.cast("string"))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def read_choices(spark: SparkSession, path: str, model: str = "model", position: str = "item") -> DataFrame:
    """entity, item, choice (index of the largest prediction, -1 if unusable), nchoice."""
    df = spark.read.parquet(path)
    return df.select(F.col(model).alias("entity"), F.col(position).alias("item"), first_argmax(F.col("predictions")).alias("choice"), F.size("predictions").alias("nchoice"))


def length_check(choices: DataFrame) -> DataFrame:
    """entity, n, reason (null: kept): the number of an entity's responses against the first entity's, by name, and whether
    any choice is outside of the item's options (-1 is an answer that cannot be read)."""
    sizes = choices.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("choice") < -1) | (F.col("choice") >= F.col("nchoice")) | F.col("choice").isNull()).alias("bad"))
    first = sizes.agg(F.min_by("n", "entity").alias("expected"))
    short = F.concat(F.lit("length:"), F.col("n"), F.lit("!="), F.col("expected"))
    return sizes.crossJoin(F.broadcast(first)).select("entity", "n", F.when(F.col("n") != F.col("expected"), short).when(F.col("bad") > 0, "choice-range").alias("reason"))


def item_keys(df: DataFrame) -> DataFrame:
    """position, key: the hash of the item's text, of `query` where the layout has it, else of `example`."""
    text = F.col("query") if "query" in df.columns else F.col("example")
    return df.select("position", text_key(text).alias("key"))


SAMPLE = "struct<acc:string,acc_norm:string,predictions:string,pred:string,filtered_resps:string,target:string,gold:string,doc:struct<answerKey:string>>"


def sample_correctness(files: DataFrame) -> DataFrame:
    """model, item, correct from JSON text: a list of samples, an object with a list `samples`, or an object of samples.
    `acc` counts if present, 0 too; then `acc_norm`; then whether the prediction is the target."""
    text = F.trim("json")
    direct = F.from_json(text, f"array<{SAMPLE}>")
    wrapped = F.from_json(F.get_json_object("json", "$.samples"), f"array<{SAMPLE}>")
    valued = F.map_values(F.from_json(text, f"map<string,{SAMPLE}>"))
    rows = F.when(text.startswith("["), direct).when(F.get_json_object("json", "$.samples").isNotNull(), wrapped).otherwise(valued)
    s = files.select("model", F.posexplode(rows).alias("item", "s"))
    pred = F.coalesce("s.predictions", "s.pred", "s.filtered_resps")
    pred = F.coalesce(F.get_json_object(pred, "$[0]"), pred)
    gold = F.coalesce("s.target", "s.gold", "s.doc.answerKey")
    correct = F.coalesce(F.rint(F.coalesce(_number(F.col("s.acc")), _number(F.col("s.acc_norm")))).cast("int"), (pred == gold).cast("int"))
    return s.select("model", "item", correct.alias("correct"))


def latest_snapshot(paths: DataFrame) -> DataFrame:
    """model, bench, path: the last path of each, by name (names start with an ISO day)."""
    return paths.groupBy("model", "bench").agg(F.max("path").alias("path"))


def newest_directory(paths: DataFrame) -> DataFrame:
    """All paths of each (model, bench) that are in its newest first directory."""
    top = paths.withColumn("dir", F.split("path", "/")[0])
    newest = top.groupBy("model", "bench").agg(F.max("dir").alias("dir"))
    return top.join(newest, ["model", "bench", "dir"], "left_semi").select("model", "bench", "path")


def not_yet_read(models: DataFrame, done: DataFrame, errors: DataFrame, at_most: int | None = None) -> DataFrame:
    """Models neither done nor failed for good; transient errors are tried again.  at_most: work of one run."""
    failed = errors.where(~retryable(F.col("error")))
    todo = models.join(done, "model", "left_anti").join(failed, "model", "left_anti")
    return todo.orderBy("model").limit(at_most) if at_most else todo


def with_lineage(models: DataFrame, lineage: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return models.join(lineage, "model", "left").select("model", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("parents", none).alias("parents"))


def lineage_gate(models: DataFrame, lineage: DataFrame) -> DataFrame:
    """One row: models, models with a parent, coverage, distinct parents."""
    joined = models.join(lineage, "model", "left")
    known = F.size(F.coalesce("parents", F.array().cast("array<string>"))) > 0
    head = joined.agg(F.count(F.lit(1)).alias("n_models"), F.count_if(known).alias("n_with_parent"))
    distinct = joined.select(F.explode("parents").alias("p")).distinct().agg(F.count(F.lit(1)).alias("n_parents"))
    return head.crossJoin(distinct).select("n_models", "n_with_parent", F.round(F.col("n_with_parent") / F.col("n_models"), 8).alias("coverage"), "n_parents")


def source_breakdown(models: DataFrame, lineage: DataFrame) -> DataFrame:
    """source, n: where the lineage of the models was found; `none` for those without."""
    return with_lineage(models, lineage).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def top_parents(lineage: DataFrame, k: int = 25) -> DataFrame:
    return lineage.select(F.explode("parents").alias("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "parent").limit(k)


def parsed_lineage(cards: DataFrame) -> DataFrame:
    """model, parents, source from card (array) and tags (array)."""
    has_card = F.size(F.coalesce("card", F.array().cast("array<string>"))) > 0
    return cards.select("model", parents(F.col("card"), F.col("tags")).alias("parents"), F.when(has_card, F.lit("card")).when(F.size("tags") > 0, F.lit("tags")).alias("source"))


def key_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct keys of both sides, shared keys, share of the smaller side."""
    x, y = a.select("key").distinct(), b.select("key").distinct()
    both = x.join(y, "key", "left_semi").agg(F.count(F.lit(1)).alias("shared"))
    n = x.agg(F.count(F.lit(1)).alias("n_a")).crossJoin(y.agg(F.count(F.lit(1)).alias("n_b"))).crossJoin(both)
    return n.select("n_a", "n_b", "shared", F.round(F.col("shared") / F.least("n_a", "n_b"), 8).alias("overlap"))


def first_per_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """The row of smallest position of each key: an aggregate, combined map-side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("r")).select(key, "r.*")


def row_order_audit(reference: DataFrame, other: DataFrame) -> DataFrame:
    """One row: positions, mismatches, first ten mismatching positions, aligned; both sides (position, key)."""
    both = reference.join(other.withColumnRenamed("key", "other"), "position", "full_outer").withColumn("bad", ~F.col("key").eqNullSafe(F.col("other")))
    first = F.slice(F.array_sort(F.collect_list(F.when((F.col("bad")) & (F.col("k") <= 10), F.col("position")))), 1, 10)
    ranked = both.where("bad").orderBy("position").limit(10).select("position").withColumn("k", F.lit(1)).withColumn("bad", F.lit(True))
    head = both.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_mismatch"))
    return head.crossJoin(ranked.agg(first.alias("first"))).select("n", "n_mismatch", F.array_join(F.transform("first", lambda p: p.cast("string")), ",").alias("first_mismatches"), (F.col("n_mismatch") == 0).alias("aligned"))


def stratified_by_date(models: DataFrame, k: int) -> DataFrame:
    """k models spread evenly over the order of (day, model)."""
    ranked = ordinal(models, [F.col("day"), F.col("model")])
    n = ranked.count()
    picks = [(i * n // k + 1,) for i in range(min(k, n))]
    return ranked.join(F.broadcast(models.sparkSession.createDataFrame(picks, "rank long")), "rank").select("model", "day", "rank")


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def changelog(rows: DataFrame) -> DataFrame:
    """One Markdown line a bench."""
    return rows.select(F.format_string("- %s: %d models (%+d), PR ratio %.3f", "bench", "n_models", "delta", "pr_ratio").alias("line"))
