"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hint_for, staged


def components(edges: DataFrame, tag: str = "components", max_rounds: int = 200) -> DataFrame:
    """``edges``: columns ``a, b``.  Returns ``node, comp``: the smallest node of each component.

    Each round gives a node the least label among its own and its neighbours',
    then replaces that label by the label's own label, which halves the depth
    that is left.  The rounds end when no label changes.  Labels are staged after
    every round, so a lost executor costs one round.  Minima are pre-aggregated
    before each shuffle, and the staged tables leave plain exchanges under the
    joins, whose hot keys (a hub's label) Spark broadcasts or splits.  Labels of few
    edges are broadcast, so that a round of a small graph shuffles minima only.
    """
    both = staged(
        edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        .where("node <> near")
        .distinct(),
        f"{tag}-edges",
    )
    hinted = hint_for(both)
    labels = staged(
        both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("comp")), f"{tag}-labels"
    )
    for _ in range(max_rounds):
        heard = both.join(hinted(labels.withColumnRenamed("node", "near")), "near").groupBy("node").agg(F.min("comp").alias("heard"))
        lower = staged(
            labels.join(hinted(heard), "node", "left").select("node", "comp", F.least("comp", "heard").alias("low")), f"{tag}-round"
        )
        up = lower.select(F.col("node").alias("low"), F.col("low").alias("top"))
        jumped = staged(
            lower.join(hinted(up), "low", "left").select("node", F.coalesce("top", "low").alias("comp"), F.col("comp").alias("was")), f"{tag}-labels"
        )
        labels = jumped.select("node", "comp")
        if jumped.where("comp <> was").isEmpty():
            return labels
    raise RuntimeError(f"components: labels still change after {max_rounds} rounds")
