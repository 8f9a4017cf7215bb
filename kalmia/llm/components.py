"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalmia.llm._common import materialize


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """edges (a, b) to (id, root) for every id with an edge; root is the smallest id reached.

    Each round gives a vertex the least label around it, then the label of its label. The state is
    a written table after each round; nothing but one count per round comes to the driver. Star-like
    groups, such as copies around an original, end after two or three rounds.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    state = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")))
    for _ in range(most_rounds):
        near = both.join(state.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        moved = state.join(near, "id", "left").select("id", "root", F.least("root", "near").alias("label"))
        jump = moved.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = materialize(moved.join(jump, "label", "left").select("id", F.least("label", "further").alias("root"), (F.least("label", "further") != F.col("root")).alias("changed")))
        changed = new.filter("changed").limit(1).count()
        state = new.select("id", "root")
        if not changed:
            return state
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
