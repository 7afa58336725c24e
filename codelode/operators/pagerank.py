"""Weighted PageRank of many graphs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import forget, written


def ranks_of(vertices: pd.DataFrame, shares: pd.DataFrame, damping: float, tolerance: float, most: int, iterations: int | None) -> np.ndarray:
    """The ranks of one graph's vertices (``_v``), by the same steps and stop rule."""
    at = pd.Index(vertices["_v"])
    n, s, d, w = len(at), at.get_indexer(shares["_s"]), at.get_indexer(shares["_d"]), shares["_share"].to_numpy()
    dangling = np.ones(n, bool)
    dangling[s] = False
    r = np.full(n, 1.0 / n)
    for _ in range(iterations if iterations is not None else most):
        new = (1 - damping) / n + damping * (np.bincount(d, weights=w * r[s], minlength=n) + r[dangling].sum() / n)
        change, r = np.abs(new - r).sum(), new
        if iterations is None and change < n * tolerance:
            return r
    if iterations is None:
        raise RuntimeError(f"PageRank didn't converge in {most} steps")
    return r


def pagerank(vertices: DataFrame, edges: DataFrame, group: str, vertex: str, src: str, dst: str, weight: str, damping: float = 0.85, tolerance: float = 1e-6, iterations: int | None = None, most: int = 100, small: int = 200_000) -> DataFrame:
    """``group, vertex, rank``: one PageRank for each value of ``group``.

    Ranks start at 1/N, a vertex passes its rank on by its edges' shares of its outgoing weight, vertices
    without edges pass theirs to all. Loops, edges with an unknown end and repeated edges (the first
    weight counts: the smallest) are dropped; repeated vertices are one. A group stops when its ranks
    change by less than N * ``tolerance`` in sum and keeps them then; if one hasn't after ``most`` steps
    an error is raised. With ``iterations`` every group takes exactly that many steps.

    Graphs of at most ``small`` vertices and edges together are ranked in one task each. For the others a step is
    one join and two aggregates over all of them, written to the shared folder (the step before is removed
    then), so lost executors cost one step; the driver sees one number a step."""
    v = vertices.select(group, F.col(vertex).alias("_v")).dropna().distinct()
    n = v.groupBy(group).agg(F.count("*").alias("_n"))
    e = edges.select(group, F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(weight).cast("double").alias("_w")).where("_s <> _d").groupBy(group, "_s", "_d").agg(F.min("_w").alias("_w"))
    e = e.join(v.withColumnRenamed("_v", "_s"), [group, "_s"], "left_semi").join(v.withColumnRenamed("_v", "_d"), [group, "_d"], "left_semi")
    out = e.groupBy(group, "_s").agg(F.sum("_w").alias("_out"))
    shares = written(e.join(out, [group, "_s"]).select(group, "_s", "_d", (F.col("_w") / F.col("_out")).alias("_share")), "pagerank-edges")
    v = written(v, "pagerank-vertices")
    every = v.select(group).unionByName(shares.select(group)).groupBy(group).agg(F.count("*").alias("_size"))
    sizes = written(every.select(group, (F.col("_size") <= small).alias("_small")), "pagerank-sizes")
    little = sizes.where("_small").select(group)
    kind = {c: t for c, t in v.dtypes}

    def whole(mine: pd.DataFrame, edges_: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: mine[group], vertex: mine["_v"], "rank": ranks_of(mine, edges_, damping, tolerance, most, iterations)})

    result = v.join(little, group).groupBy(group).cogroup(shares.join(little, group).groupBy(group)).applyInPandas(whole, f"`{group}` {kind[group]}, `{vertex}` {kind['_v']}, rank double")
    large = sizes.where("NOT _small").select(group)
    if large.limit(1).count() == 0:
        return result
    v, shares, n = v.join(large, group), written(shares.join(large, group), "pagerank-large-edges"), n.join(large, group)
    sends = shares.select(group, F.col("_s").alias("_v"), F.lit(True).alias("_sends")).distinct()
    state = v.join(n, group).join(sends, [group, "_v"], "left").select(group, "_v", "_n", F.coalesce("_sends", F.lit(False)).alias("_sends"), (1 / F.col("_n")).alias("_r"), F.lit(False).alias("_done"))
    state = before = written(state, "pagerank-start")
    for _ in range(iterations if iterations is not None else most):
        given = shares.join(state.where("NOT _done").select(group, F.col("_v").alias("_s"), "_r"), [group, "_s"]).groupBy(group, F.col("_d").alias("_v")).agg(F.sum(F.col("_share") * F.col("_r")).alias("_in"))
        lost = state.where("NOT _done").groupBy(group).agg(F.sum(F.when(F.col("_sends"), 0.0).otherwise(F.col("_r"))).alias("_lost"))
        new = (1 - damping) / F.col("_n") + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") / F.col("_n"))
        moved = state.join(given, [group, "_v"], "left").join(lost, group, "left").withColumn("_new", F.when(F.col("_done"), F.col("_r")).otherwise(new))
        if iterations is not None:
            state = written(moved.select(group, "_v", "_n", "_sends", F.col("_new").alias("_r"), "_done"), "pagerank-step")
            forget(before)
            before = state
            continue
        moved = written(moved.select(group, "_v", "_n", "_sends", F.col("_new").alias("_r"), "_done", F.abs(F.col("_new") - F.col("_r")).alias("_change")), "pagerank-step")
        forget(before)
        before = moved
        still = moved.groupBy(group).agg((F.sum("_change") < F.max("_n") * tolerance).alias("_ok"))
        state = moved.join(still, group).select(group, "_v", "_n", "_sends", "_r", (F.col("_done") | F.col("_ok")).alias("_done"))
        if still.where("NOT _ok").limit(1).count() == 0:
            break
    else:
        if iterations is None:
            raise RuntimeError(f"PageRank didn't converge in {most} steps")
    return result.unionByName(state.select(group, F.col("_v").alias(vertex), F.col("_r").alias("rank")))
