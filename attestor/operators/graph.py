"""Connected components and hierarchies as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestor.durable import drop, keep


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): the least node reachable.

    Alternating large-star and small-star contraction: every round rewrites the links, at most one per node and
    side, and ends when they are stars.  No node's neighbours are gathered into one row.
    """
    links = keep(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(), "links")
    for _ in range(rounds):
        both = links.unionByName(links.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        # large star: each greater neighbour points to the least of the neighbourhood
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        # small star: all lesser neighbours and the node itself point to the least
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").selectExpr("v AS u", "m AS v").where("u <> v").unionByName(floor.selectExpr("u", "m AS v"))
        new = keep(small.distinct(), "links")
        settled = new.join(links, ["u", "v"], "left_anti").isEmpty() and links.join(new, ["u", "v"], "left_anti").isEmpty()
        drop(links)
        links = new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.selectExpr("v AS node").distinct().selectExpr("node", "node AS root")
    return links.selectExpr("u AS node", "v AS root").unionByName(roots)


def follow_merges(pointers: DataFrame, hops: int = 5) -> DataFrame:
    """pointers (id, merged_into): (id, target), following merges for at most ``hops`` steps."""
    now = pointers.select("id", F.coalesce("merged_into", "id").alias("target"))
    step = pointers.where(F.col("merged_into").isNotNull()).select(F.col("id").alias("target"), "merged_into")
    for _ in range(hops - 1):
        now = now.join(step, "target", "left").select("id", F.coalesce("merged_into", "target").alias("target"))
    return now


def hierarchy_paths(edges: DataFrame, depth: int = 10) -> DataFrame:
    """edges (parent, child): every descendant of every node with its distance; cycles end at ``depth``."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("attestor_edges")
    return spark.sql(f"""
        WITH RECURSIVE walk(ancestor, node, level) AS (
          SELECT parent, child, 1 FROM attestor_edges
          UNION ALL SELECT w.ancestor, e.child, w.level + 1 FROM walk w JOIN attestor_edges e ON e.parent = w.node WHERE w.level < {int(depth)})
        SELECT ancestor, node, min(level) AS level FROM walk GROUP BY ancestor, node""")
