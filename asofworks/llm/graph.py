"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links but the roots themselves; root: the component's smallest node.

    Alternating stars: in the large-star step each node points its larger
    neighbours at its smallest one, in the small-star step its smaller ones.
    Minima are partial aggregates, so a node with very many links does not
    gather them in a task; rounds grow with the logarithm of the longest path.
    Each round is written to the checkpoint folder.
    """
    pairs = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root").distinct()
    pairs = checkpoint(pairs)
    for _ in range(most_rounds):
        before = pairs
        # large star: over all neighbours, m = the smallest of the node and them; larger neighbours get m
        both = pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root").distinct()
        # small star: over the smaller neighbours, all of them and the node get the smallest
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root")
        pairs = checkpoint(small.unionByName(least.select("node", F.col("m").alias("root"))).distinct())
        # done if every node has one root and no root is a node: stars only
        odd = pairs.groupBy("node").agg(F.count("*").alias("n"), F.lit(0).alias("is_root")).where("n > 1").limit(1).count()
        if not odd and not pairs.join(pairs.select(F.col("root").alias("node")).distinct(), "node", "left_semi").limit(1).count():
            break
        del before
    else:
        raise RuntimeError(f"the components were not complete after {most_rounds} rounds")
    return pairs
