"""Weighted edges: collapsing, degrees, incoming weight, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.exprs import log_count, round4, scaled


def collapse(pairs: DataFrame, by: list[str], weight: str = "weight", drop_loops: tuple[str, str] | None = None) -> DataFrame:
    """Equal pairs counted; rows with a null end are left out."""
    rows = pairs.dropna(subset=by)
    if drop_loops:
        rows = rows.where(F.col(drop_loops[0]) != F.col(drop_loops[1]))
    return rows.groupBy(*by).agg(F.count("*").alias(weight))


def degrees(vertices: DataFrame, edges: DataFrame, group: list[str], vertex: str, src: str, dst: str) -> DataFrame:
    """Each vertex with the number of distinct neighbours it points to and is pointed at from."""
    ends = edges.select(*group, F.col(src).alias(vertex), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(*group, F.col(dst).alias(vertex), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy(*group, vertex).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return vertices.join(sums, [*group, vertex], "left").fillna(0, ["out_degree", "in_degree"])


def incoming_weight(edges: DataFrame, group: list[str], dst: str, weight: str, name: str) -> DataFrame:
    return edges.groupBy(*group, dst).agg(F.sum(weight).alias(name))


def min_max(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``value`` scaled to 0..1 within each group (0.5 where all are equal). The bounds are aggregated
    and joined back, not windowed, so that a large group is no task of its own."""
    low, high = "_low", "_high"
    if group:
        bounds = rows.groupBy(*group).agg(F.min(value).alias(low), F.max(value).alias(high))
        both = rows.join(bounds, group)
    else:
        both = rows.crossJoin(F.broadcast(rows.agg(F.min(value).alias(low), F.max(value).alias(high))))  # one row
    return both.withColumn(name, scaled(value, low, high)).drop(low, high)


def log_scores(rows: DataFrame, group: list[str], count: str, name: str) -> DataFrame:
    return min_max(rows.withColumn("_log", log_count(count)), group, "_log", name).drop("_log")


def blend(centrality: str, churn: str, churn_available: str | None = None, w_centrality: float = 0.7, w_churn: float = 0.3):
    """Importance: the weighted mean of both scores, without churn where there is no history."""
    k = F.lit(w_churn) if churn_available is None else F.when(F.col(churn_available), F.lit(w_churn)).otherwise(F.lit(0.0))
    return round4((F.lit(w_centrality) * F.col(centrality) + k * F.col(churn)) / (F.lit(w_centrality) + k))


def value_at_rank(rows: DataFrame, by: list[str], value: str, ranks: DataFrame, rank: str, bins: int = 4096) -> DataFrame:
    """``by..., value``: the value at place ``rank`` of each group, from 1, largest first; equal values take a
    place each, nulls none. ``ranks``: by..., rank.

    A group isn't sorted: its values are counted by bins of equal width, and only the distinct values of the bin
    that holds the place are looked at. Groups with fewer values than the rank have no row."""
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    ends = v.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    bin_ = F.when(F.col("_high") == F.col("_low"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins)))
    binned = v.join(ends, by).select(*by, "_v", bin_.cast("int").alias("_bin"))

    def hit(counts: DataFrame, order: str, rank: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("_upto", F.sum("_c").over(w)).where((F.col("_upto") >= F.col(rank)) & (F.col("_upto") - F.col("_c") < F.col(rank)))

    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_c")).join(ranks.select(*by, F.col(rank).alias("_k")), by)
    at = hit(counts, "_bin", "_k").select(*by, "_bin", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"))
    inside = binned.join(at, [*by, "_bin"]).groupBy(*by, "_k", "_v").agg(F.count("*").alias("_c"))
    return hit(inside, "_v", "_k").select(*by, F.col("_v").alias(value))
