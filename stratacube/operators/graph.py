"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.sources.workspace import Workspace


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id reachable.

    Each round a node takes the smallest label among its own and its neighbours', then the
    label of that label.  Hooking plus jumping needs about log(diameter) rounds; each round is
    equi-joins and map-side combined aggregates, and its result is one written table, so
    neither lineage nor driver memory grows.  Null ends are ignored; no edges, no rows.
    """
    spark = edges.sparkSession
    ws = Workspace(spark, "components")
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = ws.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = ws.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels0")
    for k in range(1, max_rounds + 1):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.id == near.a, "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        # a root that sees a smaller label through any member takes it, so that long chains collapse
        pull = hooked.where("component < before").groupBy(F.col("before").alias("root")).agg(F.min("component").alias("pulled"))
        hooked = hooked.join(pull, hooked.id == pull.root, "left").select("id", F.least("component", "pulled").alias("component"), "before")
        # onward by the labels that the round began with, so that a round writes one table
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("onward"))
        moved = hooked.join(jump, hooked.component == jump["at"], "left").select("id", F.least("component", "onward").alias("component"), "before")
        new = ws.save(moved, f"labels{k}")
        changed = new.where("component <> before").limit(1).count()
        ws.drop(f"labels{k - 1}")
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
