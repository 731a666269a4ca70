"""Connected components of a graph that may be as large as the corpus.

Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is an aggregation
with partial sums and an equi-join that Spark may split where a node has very many neighbours; no
list of neighbours is ever held. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.storage import materialize

#: Rounds needed grow with the square of the logarithm of the nodes at most; this is never met.
MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node that has an edge; root is the smallest node of its component.

    edges: two long columns u and v; direction, order, loops and repeats do not matter.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
