"""The dirty tables of the pipeline, cleaned as far as several operators need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_kind(id_col: str = "id", kind_col: str = "kind") -> Column:
    """``file`` or ``function``: by the prefix of the id, else by the recorded kind in lower case."""
    i = F.col(id_col)
    return (
        F.when(i.startswith("file:"), F.lit("file"))
        .when(i.startswith("fn:"), F.lit("function"))
        .otherwise(F.lower(F.trim(F.col(kind_col))))
    )


def latest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: of repeated rows the one with the largest ``order`` (null counts as
    smallest; ties are broken by the columns' values, so that the result is the same in every run).
    Rows without a key are left out. A partial aggregate runs before the shuffle."""
    picked = F.max(F.struct(F.col(order).isNotNull().alias("_has"), F.col(order).alias("_o"), *[F.col(c) for c in columns])).alias("_m")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, *[F.col(f"_m.{c}").alias(c) for c in columns])


def trimmed_source(col: str = "source") -> Column:
    return F.lower(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))


EXTENSIONS = {  # fixed values: extension -> language
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript",
    "mts": "typescript", "tsx": "tsx", "java": "java", "go": "go",
}


def path_language(path_col: str = "path") -> Column:
    """Language by the extension of the path, null for other files."""
    ext = F.lower(F.regexp_extract(F.col(path_col), r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.element_at(table, ext)
