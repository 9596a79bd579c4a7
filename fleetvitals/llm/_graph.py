"""Connected components of an edge table, by passing minima and jumping to a label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm._scratch import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node it can reach.

    Each step is two grouped minima and a join; minima are taken before rows travel, so a node with
    very many edges is no burden. Steps are written to the shared folder. Labels only fall, and the
    longest path halves with each jump, so the number of steps grows with its logarithm."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("to"), "label")
        target = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = lower.join(target, lower["to"] == target["at"]).select("node", F.least("to", "next").alias("label"), (F.least("to", "next") != F.col("label")).alias("moved"))
        step = settle(jumped)
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) as ``components`` would give them with ``edges`` (a, b) added; nodes
    that no edge had before are added.

    Only labels that the new edges join are gone through again, so this costs steps over the new
    edges and one pass over the old labels, not steps over all edges."""
    ends = edges
    for c in ("a", "b"):
        own = labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
        ends = ends.join(own, c, "left")
    ends = settle(ends)
    at = [F.coalesce(f"of_{c}", c).alias(c) for c in ("a", "b")]
    merged = components(ends.select(*at).where("a != b")).select(F.col("node").alias("root"), F.col("label").alias("least"))
    fresh = ends.where("of_a is null").select("a").union(ends.where("of_b is null").select("b")).distinct().toDF("node")
    known = labels.select("node", "label").unionByName(fresh.withColumn("label", F.col("node")))
    return settle(known.join(merged, known["label"] == merged["root"], "left").select("node", F.coalesce("least", "label").alias("label")))
