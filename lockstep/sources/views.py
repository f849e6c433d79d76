"""Outcome tables over the driver's tables: (entity, item, f), f = 1 for a failure; cells that are not listed are 0.

Every view scans only the columns that it needs.  SQL holds the same views for DuckDB, as the body of a CTE `o`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector x dimension; a negative component is a failure.  Dense."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("item", "x"))
    return e.select(F.col("vec_id").alias("entity"), F.col("item").cast("long").alias("item"), (F.col("x") < 0).cast("int").alias("f"))


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x hour of day; any error event is a failure.  Hours without events are not listed."""
    e = read(spark, sf_dir, "events").select("user_id", F.hour("ts").cast("long").alias("item"), (F.col("event_type") == "error").cast("int").alias("f"))
    return e.groupBy(F.col("user_id").alias("entity"), "item").agg(F.max("f").alias("f"))


def ret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x part; any returned line is a failure.  Sparse."""
    e = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("f"))
    return e.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("item")).agg(F.max("f").alias("f"))


def brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x brand number; any returned part of the brand is a failure.  Nearly all cells are 1."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("item"))
    e = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("f"))
    return e.join(part, e.l_partkey == part.p_partkey).groupBy(F.col("l_suppkey").alias("entity"), "item").agg(F.max("f").alias("f"))


CHOICES = ["click", "error", "purchase", "signup", "view"]


def resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x hour with a choice (0..4, the type of the user's latest event in that hour) and acc (1 if it is the
    hour's key, hour mod 5)."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    latest = e.groupBy(F.col("user_id").alias("entity"), F.hour("ts").cast("long").alias("item")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    choice = F.array_position(F.array(*[F.lit(c) for c in CHOICES]), F.col("kind")).cast("int") - 1
    out = latest.select("entity", "item", choice.alias("choice"))
    return out.withColumn("acc", (F.col("choice") == F.col("item") % 5).cast("int"))


VIEWS = {"emb": emb, "evt": evt, "ret": ret, "brand": brand}

SQL = {
    "emb": "SELECT vec_id AS entity, CAST(i - 1 AS BIGINT) AS item, CAST(embedding[i] < 0 AS INTEGER) AS f FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)",
    "evt": "SELECT user_id AS entity, CAST(hour(ts) AS BIGINT) AS item, max(CAST(event_type = 'error' AS INTEGER)) AS f FROM events GROUP BY 1, 2",
    "ret": "SELECT l_suppkey AS entity, l_partkey AS item, max(CAST(l_returnflag = 'R' AS INTEGER)) AS f FROM lineitem GROUP BY 1, 2",
    "brand": r"SELECT l_suppkey AS entity, CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS item, max(CAST(l_returnflag = 'R' AS INTEGER)) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "resp": "SELECT entity, item, choice, CAST(choice = item % 5 AS INTEGER) AS acc FROM (SELECT user_id AS entity, CAST(hour(ts) AS BIGINT) AS item, list_position(['click','error','purchase','signup','view'], arg_max(event_type, (ts, event_id))) - 1 AS choice FROM events GROUP BY 1, 2)",
}
