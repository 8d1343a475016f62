"""Connected components by joins: small-star steps and pointer jumping, nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b) to rows (node, component); component is the smallest node reachable. Nodes without links are absent.

    Each round: every node takes its smallest smaller neighbour as parent (an aggregate with map-side combine), its
    other neighbours are linked to that parent, and parents are replaced by grandparents. It ends when all links
    point to roots. Links shrink from round to round; each round is checkpointed.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = cut(links)
    while True:
        parent = links.groupBy("a").agg(F.min("b").alias("p"), F.count("*").alias("n"))
        grand = parent.select(F.col("a").alias("p"), F.col("p").alias("g"))
        jumped = cut(parent.join(grand, "p", "left").select("a", "p", "n", F.coalesce("g", "p").alias("root"), F.col("g").isNotNull().alias("moved")))
        open_ = jumped.agg(F.count_if(F.col("moved") | (F.col("n") > 1))).first()[0]
        if not open_:
            return jumped.select(F.col("a").alias("node"), F.col("root").alias("component")).unionByName(jumped.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct())
        several = jumped.filter("n > 1").select("a", "p")
        others = links.join(several, "a").filter("b <> p").select(F.col("b").alias("a"), F.col("p").alias("b"))
        links = cut(jumped.select("a", F.col("root").alias("b")).unionByName(others.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())
