"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u != v: neighbours of u are linked to the smallest node seen from u.

    The minimum is a partial aggregate, so a hub costs one row per task; the join back is a plain equi-join whose edge side
    AQE can split where one hub holds most edges.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    joined = both.join(low, both.u == low.k)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns u, v); root is the smallest node reachable.

    Rows with a null end and self loops carry no link. An empty table gives an empty result. Each round is written to the
    shared folder, and the round before is deleted once its successor stands.
    """
    state = materialize(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct(), "components")
    before = None
    for _ in range(max_rounds):
        after = materialize(_star(_star(state, True), False), "components")
        discard(state)
        state = after
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
