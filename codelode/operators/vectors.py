"""Exact vector search: a set of queries against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codelode.session import written

BLOCK = 8192  # queries at a time: what is broadcast has at most about BLOCK x dimension x 8 bytes


def norm(v: str | Column) -> Column:
    """Length of an ARRAY<FLOAT>, summed in double."""
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: str) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(F.col(v))


def usable(v: str, dim: int) -> Column:
    return F.col(v).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def search(rows: DataFrame, queries: DataFrame, key: str, vector: str, within: list[str], kind: str, k: int, dim: int) -> DataFrame:
    """``query, key, within..., kind, score``: at least the k best rows of each kind for each query (with
    ties at the k-th place), by cosine in double; ``rank`` and ``balance`` pick the answer from them.

    ``queries`` are rows of the same shape; a row is compared with queries of equal ``within`` columns
    and never with itself. Vectors that aren't usable take no part. Queries are cut into blocks of about
    ``BLOCK``; each block is broadcast and passed over all rows, whose vectors are never shuffled: tasks
    keep their own best and only those are gathered."""
    spark = rows.sparkSession
    cols = [key, *within, kind, vector]
    data, asked = rows.select(*cols).where(usable(vector, dim)), queries.select(*cols).where(usable(vector, dim))
    if asked.limit(BLOCK + 1).count() > BLOCK:  # several passes over the rows
        data, asked = written(data, "search-rows"), written(asked, "search-questions")
    blocks = max(1, -(-asked.count() // BLOCK))
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"query {kinds[key]}", f"{key} {kinds[key]}", *[f"{w} {kinds[w]}" for w in within], f"{kind} {kinds[kind]}", "score double"])
    parts, shape = [], to_arrow_schema(T.StructType.fromDDL(schema))
    for b in range(blocks):
        q = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas()
        m = np.stack([np.asarray(x, dtype=float) for x in q[vector]]) if len(q) else np.zeros((0, dim))
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((q[key].to_numpy(), [tuple(x) for x in q[within].itertuples(index=False)], m))

        def best(batches, shared=shared):
            ids, groups, m = shared.value
            for rb in batches:
                v = rb.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                v /= np.linalg.norm(v, axis=1, keepdims=True) if len(v) else 1
                pdf = pa.Table.from_batches([rb]).select([key, *within, kind]).to_pandas()
                of = pd.MultiIndex.from_frame(pdf[[*within, kind]]) if len(pdf) else []
                codes, names = pd.factorize(of)
                for c, name in enumerate(names):
                    at = np.flatnonzero(codes == c)
                    mine = [i for i, g in enumerate(groups) if g == tuple(name)[:-1]]
                    if not mine:
                        continue
                    score = v[at] @ m[mine].T
                    score[pdf[key].to_numpy()[at][:, None] == ids[mine][None, :]] = -9
                    cut = np.partition(score, max(0, len(at) - k), axis=0)[max(0, len(at) - k)]
                    i, j = np.nonzero((score >= cut[None, :]) & (score > -2))
                    out = pdf.iloc[at[i]][[key, *within, kind]].copy()
                    out.insert(0, "query", ids[mine][j])
                    out["score"] = score[i, j]
                    yield pa.RecordBatch.from_pandas(out, schema=shape, preserve_index=False)

        parts.append(data.mapInArrow(best, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank(hits: DataFrame, by: list, k: int) -> DataFrame:
    """The k best hits of each query, ``place`` from 1."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*by)).cast("long")).where(F.col("place") <= k)


def balance(hits: DataFrame, kind: str, by: list, k: int) -> DataFrame:
    """floor(k / 2) best hits of each kind, places left over to the best others of any kind; sorted again."""
    in_kind = F.row_number().over(Window.partitionBy("query", kind).orderBy(*by))
    quota = hits.withColumn("_quota", (in_kind <= k // 2).cast("int"))
    first = quota.withColumn("_turn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_quota"), *by))).where(F.col("_turn") <= k)
    return rank(first, by, k).drop("_quota", "_turn")
