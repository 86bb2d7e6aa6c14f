"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, store


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node in `links` (a, b: long).

    Each round takes the smallest label of all neighbours and then the label
    of that label, so stars take two rounds and long chains a logarithm of
    their length. Labels are written each round; nothing is collected."""
    both = store(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("seen"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        lower = store(lower, "labels")
        roots = lower.select(F.col("node").alias("root"), F.col("comp").alias("up"))
        jumped = lower.join(roots, lower.comp == roots.root).select("node", "old", F.col("up").alias("comp"))
        jumped = store(jumped, "labels")
        discard(labels, lower)
        labels = jumped.select("node", "comp")
        if jumped.where("old <> comp").isEmpty():
            discard(both)
            return labels
