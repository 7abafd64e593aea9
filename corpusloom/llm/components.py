"""Connected components over an edge table, by least labels with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, label) for each end of an edge; label is the least node of its component.

    Each round takes the least label among a node's neighbours, then the label of that label, so that long chains take
    a logarithmic number of rounds. Rounds are tables in the shared folder. Null ends and loops are left out.
    """
    pairs = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    both = pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).unionByName(pairs.select(F.col(right).alias("u"), F.col(left).alias("v")))
    graph = materialize(both.distinct(), "edges")
    labels = materialize(graph.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = graph.join(labels.select(F.col("u").alias("v"), F.col("label").alias("_l")), "v").groupBy("u").agg(F.min("_l").alias("_n"))
        hooked = labels.join(near, "u").select("u", F.least("label", "_n").alias("_m"), F.col("label").alias("_was"))
        hooked = materialize(hooked, "hooked")
        jumped = hooked.join(hooked.select(F.col("u").alias("_m"), F.col("_m").alias("_j")), "_m", "left")
        new = materialize(jumped.select("u", F.least("_m", F.coalesce("_j", "_m")).alias("label"), "_was"), "labels")
        changed = new.where("label <> _was").limit(1).count()
        discard(labels)
        discard(hooked)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    discard(graph)
    return labels.select(F.col("u").alias("node"), "label")
