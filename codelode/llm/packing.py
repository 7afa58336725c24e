"""Problem 6: fill containers of fixed capacity by minimum bin slack.

Only the histogram of item lengths is solved, and it has at most ``capacity`` entries however many
items there are. Each step takes the largest length that is left and picks, by a bitset subset-sum
over the remaining multiset of lengths, the fill that comes closest to the capacity; the counts are
backtracked from the stored bitsets, and the same pattern is used as often as the counts allow. So
the number of patterns is bounded by the lengths (about ``capacity * ln(capacity)``), not by the items.

Items get their places on Spark: an item's rank among those of its length (salted, so that a length
that a third of all items have is spread over many tasks) picks the pattern and the container. What is
broadcast are the patterns and the first rank of each (length, salt), ``capacity * salts`` numbers; there
are 64 salts, more only beyond some hundred million items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import written


def best_fill(target: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """Counts of the lengths (given in descending order) whose sum is closest to, and not over, the target."""
    mask = (1 << (target + 1)) - 1
    reach, stages, goal = 1, [], 1 << target
    for n in lengths:
        if n > target:
            continue
        count, k = min(left[n], target // n), 1
        while count > 0:
            k = min(k, count)
            stages.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            count -= k
            k *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(stages):
        if not before >> at & 1:
            at -= n * k
            used[n] = used.get(n, 0) + k
    return used


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, counts by length) until every item has a place. Lengths are 1 to capacity."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    lengths, out = list(left), []
    while lengths:
        top = lengths[0]
        left[top] -= 1
        used = best_fill(capacity - top, lengths, left)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        out.append((times, used))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                lengths.remove(n)
    return out


def _allocations(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """By (length, rank of its first item): first container and items a container; sorted."""
    rows, taken, base = [], {}, 0
    for times, used in plan:
        for n, k in used.items():
            first = taken.get(n, 0)
            rows.append((n, first, base, k))
            taken[n] = first + times * k
        base += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "first": a[:, 1], "container": a[:, 2], "each": a[:, 3]}


def pack(df: DataFrame, key: str, size: str, capacity: int = 4096, salts: int | None = None) -> DataFrame:
    """Every item's place: ``key, piece_no, start, length, container``.

    ``key`` must be unique. An item larger than the capacity is cut into full pieces and one rest
    (``piece_no`` from 0, ``start`` is the offset of the piece); nothing else is cut. Items without a
    size (null or 0, or less) take no room and go to container 0. Rows with a null key are left out.
    Equal sizes are ranked by a hash of the key, then the key, so every run gives the same result."""
    items = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    items = written(items, "pack-sizes")
    salts = salts or int(min(4096, max(64, items.count() >> 21)))
    pieces = items.select("key", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("n", F.lit(1)) - 1) / capacity).cast("long"))).alias("piece_no", "_")).select(
        "key", "piece_no", (F.col("piece_no") * capacity).cast("long").alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).cast("long").alias("length"),
        F.pmod(F.xxhash64("key", "piece_no"), F.lit(salts)).alias("salt"),
    )
    counts = pieces.where("length > 0").groupBy("length", "salt").agg(F.count("*").alias("c")).toPandas()  # at most capacity x salts rows
    table = np.zeros((capacity + 1, salts), np.int64)
    table[counts["length"].to_numpy(np.int64), counts["salt"].to_numpy(np.int64)] = counts["c"].to_numpy(np.int64)
    each = table.sum(1)
    plan = _allocations(patterns({int(n): int(each[n]) for n in np.flatnonzero(each)}, capacity))
    where = df.sparkSession.sparkContext.broadcast((plan, np.cumsum(table, axis=1) - table))
    ranked = pieces.where("length > 0").withColumn("rank", (F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece_no")) - 1).cast("long"))

    @F.pandas_udf("long")
    def container(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.Series:
        a, before = where.value
        n = length.to_numpy()
        at = rank.to_numpy() + before[n, salt.to_numpy()]
        top = int(max(a["first"].max(initial=0), at.max(initial=0))) + 2
        i = np.searchsorted(a["length"] * top + a["first"], n * top + at, side="right") - 1
        return pd.Series(a["container"][i] + (at - a["first"][i]) // a["each"][i])

    placed = ranked.select("key", "piece_no", "start", "length", container("length", "salt", "rank").alias("container"))
    nothing = pieces.where("length = 0").select("key", "piece_no", "start", "length", F.lit(0).cast("long").alias("container"))
    return placed.unionByName(nothing).withColumnRenamed("key", key)


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, tokens, room left unused, the least number of containers that could do, fill."""
    by = packed.groupBy("container").agg(F.sum("length").alias("n")).where("n > 0")
    t = by.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"))
    return t.select("containers", "tokens", "fullest", (F.col("containers") * capacity - F.col("tokens")).alias("unused"), F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1))).alias("fill"))
