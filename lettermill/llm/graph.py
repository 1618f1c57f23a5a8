"""Connected components by minimum label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm._common import Written, join_by_key


def components(edges: DataFrame, *, max_rounds: int = 60) -> Written:
    """edges: a, b (long, not null; either direction, repeats and loops allowed). Returns the table of node and root: each
    node that an edge names with the smallest node that it reaches. An empty table gives an empty table.

    Every round each node takes the smallest label among itself and its neighbours, then the label of that label
    (pointer jumping), so a chain of n nodes settles in about log n rounds. Labels are written to the shared folder
    between rounds; only counts come to the driver. A hub with very many edges, or a label that very many nodes have,
    is met where the edges and the nodes lie (join_by_key).
    """
    pairs = edges.filter("a <> b")
    both = Written(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a")).distinct(), "edges")
    links = both.df.count()
    # Of each node its label and its number of edges.
    labels = Written(both.df.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root"), F.count(F.lit(1)).alias("n")), "labels")
    nodes = labels.df.count()
    for _ in range(max_rounds):
        near = join_by_key(both.df, labels.df.select(F.col("node").alias("y"), F.col("root").alias("to"), "n"), ["y"], "n", links)
        near = near.groupBy("x").agg(F.min("to").alias("near"))
        step = Written(labels.df.join(near, labels.df.node == near.x).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"), "n"), "step")
        used = step.df.groupBy("root").agg(F.count(F.lit(1)).alias("uses"))
        tops = Written(used.join(labels.df.select(F.col("node").alias("root"), F.col("root").alias("top")), "root"), "tops")
        jumped = join_by_key(step.df, tops.df, ["root"], "uses", nodes)
        new = Written(jumped.select("node", "old", F.least("root", "top").alias("root"), "n"), "labels")
        changed = new.df.filter("old <> root").limit(1).count()
        for done in (labels, step, tops):
            done.drop()
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    both.drop()
    return labels
