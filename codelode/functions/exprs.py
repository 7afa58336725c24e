"""Column expressions shared by the operators; all but ``fixed3`` stay inside generated code."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round4(c: str | Column) -> Column:
    """Four decimals, halves toward plus infinity."""
    return F.floor(col(c) * 10000 + 0.5) / 10000


def trim_ws(c: str | Column) -> Column:
    """Without white space at either end, of any kind (``trim`` takes blanks only)."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^\s+", ""), r"\s+$", "")


def scaled(v: str | Column, low: str | Column, high: str | Column) -> Column:
    """Min-max to 0..1; where all values are equal, 0.5."""
    v, low, high = col(v), col(low), col(high)
    return F.when(high == low, F.lit(0.5)).otherwise((v - low) / (high - low))


def log_count(c: str | Column) -> Column:
    return F.log1p(F.greatest(col(c), F.lit(0)).cast("double"))


def _fixed3(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if pd.isna(x) else str(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP)))


def fixed3(c: str | Column) -> Column:
    """Three decimals of the exact binary value, halves up; no built-in rounds the binary value."""
    return F.pandas_udf(_fixed3, "string")(col(c))


# -- paths, with forward slashes


def dirname(c: str | Column) -> Column:
    """The folder, empty for a file at the root."""
    return F.when(F.instr(col(c), "/") > 0, F.regexp_replace(col(c), r"/[^/]*$", "")).otherwise(F.lit(""))


def basename(c: str | Column) -> Column:
    return F.substring_index(col(c), "/", -1)


def joined(folder: str | Column, rest: str | Column) -> Column:
    """``folder/rest`` without ``.`` and ``..`` segments; a path that leads above the root is null."""
    segments = F.split(F.concat_ws("/", col(folder), col(rest)), "/")
    kept = F.aggregate(
        F.filter(segments, lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(acc.isNull() | ((s == "..") & (F.size(acc) == 0)), F.lit(None)).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(kept.isNotNull(), F.array_join(kept, "/"))


LANGUAGE_OF = {  # fixed values: extension -> language
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx", "py": "python", "pyi": "python", "java": "java", "go": "go",
}


def language_of(path: str | Column) -> Column:
    """Language by the lower-cased extension, null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1)))


# -- addresses of repositories


def is_repo_url(c: str | Column) -> Column:
    return col(c).rlike(r"(?i)^(https?|git|ssh)://") | col(c).rlike(r"^[\w.\-]+@[\w.\-]+:")


def redact_url(c: str | Column) -> Column:
    """User and password of an address hidden; other text unchanged."""
    return F.regexp_replace(col(c), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/@\s]+@", "$1<redacted>@")


def redact_urls(c: str | Column) -> Column:
    """The same for every address inside a text."""
    return F.regexp_replace(col(c), r"([A-Za-z][A-Za-z0-9+.\-]*://)[^/@\s]+@", "$1<redacted>@")


def redact_secret(c: str | Column, secret: str | Column) -> Column:
    """Every occurrence of the secret hidden; a secret of fewer than 4 characters is left."""
    return F.when(F.length(col(secret)) >= 4, F.replace(col(c), col(secret), F.lit("<redacted>"))).otherwise(col(c))


def repo_name(c: str | Column) -> Column:
    """Last segment of an address or path, without ``.git``."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(col(c), r"/+$", ""), r"([^/:]+)$", 1), r"\.git$", "")


def compact_count(c: str | Column) -> Column:
    """69000 -> 69K, 1200000 -> 1.2M."""
    v = col(c)
    one = lambda x: F.regexp_replace(F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10), r"\.0$", "")
    return F.when(v >= 1_000_000, F.concat(one(v / 1_000_000), F.lit("M"))).when(v >= 1000, F.concat(one(v / 1000), F.lit("K"))).otherwise(v.cast("string"))


def cache_folder(url: str | Column) -> Column:
    """host/owner/name of an address, each segment with safe characters only, dot segments dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"^[^/@]+@", ""), r"\.git/?$", "")
    parts = F.transform(F.split(F.regexp_replace(bare, ":", "/"), "/"), lambda s: F.regexp_replace(s, r"[^A-Za-z0-9._\-]", "_"))
    return F.array_join(F.filter(parts, lambda s: ~s.rlike(r"^\.*$")), "/")
