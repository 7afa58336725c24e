"""Problem 3: source files that aren't valid in the language of their extension.

Each file's tokens are run through a grammar by memoised derivatives (``syntax``): an empty derivative
marks the failing token, a final state that can't end marks a text that was cut off. The grammars are
small Python helpers of the workers; files are spread, joined and counted by Spark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import tables

_LANGUAGES: dict = {}


def checker(language: str):
    """The worker's parser of a language, made once: its memo serves all files that the worker reads."""
    if language not in _LANGUAGES:
        from codelode.llm.syntax import ecma, golang, java17, python3

        make = {"python": python3.language, "javascript": ecma.javascript, "typescript": ecma.typescript, "tsx": ecma.tsx, "java": java17.language, "go": golang.language}
        _LANGUAGES[language] = make[language]()
    return _LANGUAGES[language]


def syntax_flags(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """``key, language, has_errors, error_line, cut_off`` for each file of the six languages.

    ``error_line`` is the line (from 1) of the first token that can't follow what is before it, or the
    last line where the text is cut off; null in valid files. Empty files and blank ones are valid. Files with null
    content, null path or another extension have no row; repeated rows are flagged each."""

    def run(batches):
        for pdf in batches:
            got = [checker(lang).check(text) if text.strip() else (True, None, False) for lang, text in zip(pdf["language"], pdf["content"])]
            yield pd.DataFrame({"key": pdf["key"], "language": pdf["language"], "has_errors": [not g[0] for g in got], "error_line": pd.array([g[1] for g in got], "Int32"), "cut_off": [g[2] for g in got]})

    kind = dict(files.dtypes)[key]
    rows = files.select(F.col(key).alias("key"), tables.path_language(path).alias("language"), F.col(content).alias("content")).where("language IS NOT NULL AND content IS NOT NULL")
    return rows.mapInPandas(run, f"key {kind}, language string, has_errors boolean, error_line int, cut_off boolean").withColumnRenamed("key", key)


def error_rates(flags: DataFrame, *by: str) -> DataFrame:
    """``by..., files, with_errors, cut_off, error_rate`` of flagged files."""
    return flags.groupBy(*by).agg(F.count("*").alias("files"), F.count_if("has_errors").alias("with_errors"), F.count_if("cut_off").alias("cut_off"), F.avg(F.col("has_errors").cast("double")).alias("error_rate"))
