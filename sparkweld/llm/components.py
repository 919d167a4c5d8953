"""Connected components over an edge table, by alternating large-star and small-star steps.

Each step is an aggregation with map-side combine and a salted join, so a hub with very many neighbours
is dealt over several tasks. The edge table is written to the shared folder after each round, and the one before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, salted_join, save


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = salted_join(both.where("v > u"), low, ["u"], ["v"])
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    out = salted_join(e, low, ["u"], ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)``, long ids, any direction; returns ``(node, root)``, a saved table, the root being the smallest id of its component.

    Nodes without an edge do not appear; loops, repeats and null ends are ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = save(e, "edges"), None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.min(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            break
        before = now
        old, e = e, save(_small_star(_large_star(e)), "edges")
        drop(old)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = save(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots")
    drop(e)
    return out
