"""Connected components of a link table by contraction, without ever gathering a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, stored, stored_at


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is one node of the component, the same for all of it.

    A round lets each node point to the smallest of itself and its neighbours, follows the pointers to their ends, and
    replaces the nodes of the remaining links by those ends.  At least half of the nodes that still have links go in
    each round, so the number of rounds is logarithmic.  Minima are combined map-side, so that a hub costs one row a
    task; the joins are plain equi-joins that adaptive execution can split.  Each step is written to the shared folder.
    Loops and repeated links do no harm; null ends are ignored.
    """
    spark = edges.sparkSession
    links, used = stored_at(_distinct(edges.select("a", "b")), "links")
    found: DataFrame | None = None
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to, path = stored_at(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "to")
        while True:
            nxt = to.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped, new = stored_at(to.join(nxt, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "to")
            delete(spark, path)
            to, path = jumped.select("node", "root"), new
            if jumped.where("moved").isEmpty():
                break
        for end in ("a", "b"):
            links = links.join(to.select(F.col("node").alias(end), F.col("root").alias("r")), end).withColumn(end, F.col("r")).drop("r")
        links, new = stored_at(_distinct(links.select("a", "b")), "links")
        delete(spark, used)
        used = new
        if found is None:
            found = to
        else:
            last = to.select(F.col("node").alias("root"), F.col("root").alias("further"))
            found = stored(found.join(last, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "roots")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
