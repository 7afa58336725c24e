"""The explorer's data side: folder clusters, framing, labels, focus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.exprs import basename, dirname
from codelode.operators.edges import value_at_rank


def plan_clusters(folders: list[tuple[str, int]], target: int = 40, most: int = 80) -> dict[str, str]:
    """folder -> cluster of one repository, from its folders' file counts (never from its files).

    The largest group that can be split is split by its next path segment until there are about
    ``target`` groups; a chain of single subfolders is followed for free; groups with more than twice the
    average share go on being split up to ``most``. Where a split would give too many groups, the largest
    children are kept and the others share the group ``prefix/+N``."""
    total = sum(n for _, n in folders)
    groups: dict[str, list[tuple[str, int]]] = {"": list(folders)}
    done: set[str] = set()

    def split(prefix: str) -> dict[str, list[tuple[str, int]]]:
        out: dict[str, list[tuple[str, int]]] = {}
        for f, n in groups[prefix]:
            rest = f[len(prefix) :].lstrip("/") if f != prefix else ""
            child = prefix if not rest else (prefix + "/" if prefix else "") + rest.split("/")[0]
            out.setdefault(child, []).append((f, n))
        return out

    size = lambda members: sum(n for _, n in members)
    while True:
        open_ = [g for g in groups if g not in done and "/+" not in "/" + g]
        if not open_:
            break
        g = max(open_, key=lambda x: (size(groups[x]), x))
        if len(groups) >= target and (size(groups[g]) <= 2 * total / target or len(groups) >= most):
            break
        children = split(g)
        if list(children) == [g]:
            done.add(g)
            continue
        members = groups.pop(g)
        limit = most if len(groups) + 1 >= target else target
        room = max(1, limit - len(groups))
        if len(children) > room and len(children) > 1:
            share = size(members) / max(1, total)
            keep = max(1, min(room - 1, int((target - 1) * share)))
            ordered = sorted(children, key=lambda c: (-size(children[c]), c))
            folded = [m for c in ordered[keep:] for m in children[c]]
            children = {c: children[c] for c in ordered[:keep]}
            children[(g + "/" if g else "") + f"+{len(ordered) - keep}"] = folded
        for c, m in children.items():
            groups.setdefault(c, []).extend(m)
            if c == g:
                done.add(c)
    return {f: g for g, members in groups.items() for f, _ in members}


def folder_clusters(files: DataFrame, target: int = 40, most: int = 80) -> DataFrame:
    """``repo_id, path, cluster``: every file in exactly one cluster of its repository. The plan is made
    from one row a folder, each repository's on its own; files get their cluster by a join."""
    rows = files.select("repo_id", "path", dirname("path").alias("folder"))
    counts = rows.groupBy("repo_id", "folder").agg(F.count("*").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        got = plan_clusters(sorted(zip(pdf["folder"], pdf["n"].astype(int))), target, most)
        return pd.DataFrame({"repo_id": pdf["repo_id"], "folder": pdf["folder"], "cluster": pdf["folder"].map(got)})

    return rows.join(counts.groupBy("repo_id").applyInPandas(plan, "repo_id long, folder string, cluster string"), ["repo_id", "folder"]).select("repo_id", "path", "cluster")


def cluster_labels(clusters: DataFrame) -> DataFrame:
    """``repo_id, cluster, label``: the last segment; where several clusters share it the last two; where
    they share those too the whole path. The root's label is ``/``."""
    one = clusters.select("repo_id", "cluster").distinct().withColumns({"l1": F.substring_index("cluster", "/", -1), "l2": F.substring_index("cluster", "/", -2)})
    n1, n2 = F.count("*").over(Window.partitionBy("repo_id", "l1")), F.count("*").over(Window.partitionBy("repo_id", "l2"))
    label = F.when(F.col("cluster") == "", "/").when(n1 == 1, F.col("l1")).when(n2 == 1, F.col("l2")).otherwise(F.col("cluster"))
    return one.select("repo_id", "cluster", label.alias("label"))


def cluster_stats(points: DataFrame, by: list[str], x: str, y: str, z: str, weight: str) -> DataFrame:
    """Centre, size, greatest weight and spread of each cluster; the spread is the distance at place
    floor(0.9 n) of the sorted ones (a value that occurs, no interpolation)."""
    c = points.groupBy(*by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.avg(z).alias("cz"), F.max(weight).alias("importance"), F.count("*").alias("members"))
    d = points.join(c, by).withColumn("d", F.sqrt(sum((F.col(a) - F.col(b)) ** 2 for a, b in ((x, "cx"), (y, "cy"), (z, "cz")))))
    return c.join(percentile(d, by, "d").withColumnRenamed("d", "spread"), by)


def percentile(rows: DataFrame, by: list[str], value: str, share: float = 0.9) -> DataFrame:
    """``by..., value``: the value at place floor(share * n) of the sorted ones, from 0."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    place = F.least(F.col("_n") - 1, F.floor(F.col("_n") * share))
    return value_at_rank(rows, by, value, n.select(*by, (F.col("_n") - place).alias("_rank")), "_rank")


def cluster_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """``repo_id, src_cluster, dst_cluster, weight``: how many edges (whatever their weight) go between
    two clusters; edges inside one are left out."""
    a = clusters.select("repo_id", F.col("path").alias("src"), F.col("cluster").alias("src_cluster"))
    b = clusters.select("repo_id", F.col("path").alias("dst"), F.col("cluster").alias("dst_cluster"))
    both = edges.join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).where("src_cluster <> dst_cluster")
    return both.groupBy("repo_id", "src_cluster", "dst_cluster").agg(F.count("*").alias("weight"))


# Names of files that say nothing without their folder.
GENERIC = (*[f"index.{c}{kind}{x}" for c in ("", "c", "m") for kind in ("js", "ts") for x in ("", "x")], "__init__.py", "mod.rs", "main.py", "main.go")


def file_labels(files: DataFrame) -> DataFrame:
    """``repo_id, path, label``: the file's name, with its folder where the name is generic."""
    name = basename("path")
    return files.select("repo_id", "path", F.when(name.isin(*GENERIC), F.substring_index("path", "/", -2)).otherwise(name).alias("label"))


def top_rows(rows: DataFrame, by: list[str], order: list, most: int, salts: int = 32) -> DataFrame:
    """The first ``most`` rows of each group with their ``place`` from 1. Each of ``salts`` parts of a group gives
    its first rows, so no task sorts a whole group. ``order`` must tell all rows apart."""
    first = lambda w: F.row_number().over(w.orderBy(*order))
    parts = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in by]), F.lit(salts)))
    some = parts.withColumn("_place", first(Window.partitionBy(*by, "_salt"))).where(F.col("_place") <= most).drop("_salt", "_place")
    return some.withColumn("place", first(Window.partitionBy(*by)).cast("long")).where(F.col("place") <= most)


def focus_set(rows: DataFrame, by: list[str], importance: str, key: str) -> DataFrame:
    """The most important rows of each group: min(all, 300, max(10, a fifth))."""
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    many = F.least(F.col("_n"), F.lit(300), F.greatest(F.lit(10), F.floor(F.col("_n") * 0.2 + 0.5)))
    return top_rows(rows, by, [F.desc(importance), F.asc(key)], 300).join(n, by).where(F.col("place") <= many).drop("_n")


def _distance(x: str, y: str, z: str, to: tuple[str, str, str]):
    return F.sqrt(sum((F.col(a) - F.col(b)) ** 2 for a, b in zip((x, y, z), to)))


def layout(points: DataFrame, by: list[str], key: str, x: str, y: str, z: str, importance: str) -> DataFrame:
    """What the camera frames: the centre of the most important points (``focus_set``), weighted by squared
    importance (plain where all are 0), and the 90th percentile of their distance from it (100 where that is
    0); the same percentile of all points from their middle (``overview``); the furthest point (``extent``)."""
    focus = focus_set(points, by, importance, key)
    w = F.col(importance) ** 2
    centre = lambda c: F.when(F.sum(w) > 0, F.sum(w * F.col(c)) / F.sum(w)).otherwise(F.avg(c))
    c = focus.groupBy(*by).agg(centre(x).alias("cx"), centre(y).alias("cy"), centre(z).alias("cz"))
    m = points.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"))
    far = lambda rows, to, name: rows.withColumn(name, _distance(x, y, z, to))
    or_100 = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(100.0)
    radius = percentile(far(focus.join(c, by), ("cx", "cy", "cz"), "_r"), by, "_r")
    overview = percentile(far(points.join(m, by), ("mx", "my", "mz"), "_o"), by, "_o")
    extent = far(points.join(c, by), ("cx", "cy", "cz"), "_e").groupBy(*by).agg(F.max("_e").alias("_e"))
    out = c.join(m, by).join(radius, by).join(overview, by).join(extent, by)
    return out.select(*by, "cx", "cy", "cz", "mx", "my", "mz", or_100("_r").alias("radius"), or_100("_o").alias("overview"), F.greatest("_e", or_100("_r")).alias("extent"))


def cluster_frame(clusters: DataFrame, by: list[str], x: str, y: str, z: str, least: float = 100.0) -> DataFrame:
    """Middle of the bounding box of all clusters, and 1.4 times the distance of the furthest, at least ``least``."""
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    m = clusters.groupBy(*by).agg(mid(x).alias("mx"), mid(y).alias("my"), mid(z).alias("mz"))
    far = clusters.join(m, by).groupBy(*by).agg(F.max(_distance(x, y, z, ("mx", "my", "mz"))).alias("_far"))
    return m.join(far, by).select(*by, "mx", "my", "mz", F.greatest(F.col("_far") * 1.4, F.lit(least)).alias("radius"))


def scales(value: str, count: str, most: str, weight: str, heaviest: str) -> dict:
    """Sizes the explorer draws with: a node's radius as a share of the frame, the place on the colour ramp, a
    bubble's share, an edge's tint."""
    return {
        "ramp": F.sqrt(value), "radius_share": 0.006 + 0.018 * F.sqrt(value), "bubble_share": 0.025 + 0.075 * F.sqrt(F.col(count) / F.greatest(F.col(most), F.lit(1))),
        "tint": F.log1p(weight) / F.log1p(heaviest),
    }


def frame(points: DataFrame, by: list[str], x: str, y: str, z: str, importance: str) -> DataFrame:
    """Middle of the bounding box, centre weighted by squared importance (plain where all are 0), and the
    radius: 1.4 times the longest half side, at least 100."""
    w = F.col(importance) ** 2
    total = F.sum(w)
    centre = lambda c: F.when(total > 0, F.sum(w * F.col(c)) / total).otherwise(F.avg(c))
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    half = F.greatest(*[(F.max(c) - F.min(c)) / 2 for c in (x, y, z)])
    return points.groupBy(*by).agg(centre(x).alias("cx"), centre(y).alias("cy"), centre(z).alias("cz"), mid(x).alias("mx"), mid(y).alias("my"), mid(z).alias("mz"), F.greatest(half * 1.4, F.lit(100.0)).alias("radius"))
