"""Texts of chunks, prompts, and the incremental index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.functions.exprs import fixed3, trim_ws


def file_text(path: str, language: str, importance: str, in_degree: str, out_degree: str, churn: str, loc: str, declares: str, summary: str | None = None) -> Column:
    """Text of a file's chunk; ``declares`` is an array of lines, null or empty for none, ``summary`` the name of a
    column, null where there is none."""
    none = F.lit("No declarations.")
    listed = F.when(F.size(F.coalesce(F.col(declares), F.array().cast("array<string>"))) > 0, F.concat(F.lit("Declares:\n"), F.array_join(declares, "\n"))).otherwise(none)
    facts = [("importance", fixed3(importance)), ("importers", F.col(in_degree)), ("imports", F.col(out_degree)), ("commits", F.col(churn)), ("lines", F.col(loc))]
    graph = F.concat_ws("; ", *[F.concat(F.lit(f"{name} "), value) for name, value in facts])
    said = F.col(summary) if summary else F.lit(None).cast("string")
    return F.concat_ws("\n", F.concat(F.col(path), F.lit(" ("), F.coalesce(F.col(language), F.lit("unknown")), F.lit(")")), said, graph, listed)


def function_text(name: str, path: str, line: str, kind: str, exported: str, signature: str, calls: str) -> Column:
    listed = F.coalesce(F.concat(F.lit("Calls: "), F.col(calls)), F.lit("It calls nothing in this repository."))
    how = F.concat(F.lit("Kind: "), F.col(kind), F.when(F.col(exported), F.lit(", exported")).otherwise(F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("Function: "), name), F.concat(F.lit("In file: "), F.col(path), F.lit(" (line "), F.col(line), F.lit(")")), how, F.concat(F.lit("Signature: "), signature), F.lit(""), listed)


def signature(content: str, line: str, name: str, last: str | None = None, most: int = 120) -> Column:
    """First line of a declaration that holds more than annotations (its ``last`` line at the latest), without the
    bracket or colon at its end; cut at ``most`` characters; the name where the file has no such line."""
    lines = F.split(F.col(content), "\n", -1)
    only = r"^\s*(@[\w.]+(\([^)]*\))?\s*)+$"
    start = F.greatest(F.col(line), F.lit(1))
    own = F.get(lines, start - 1)
    span = F.slice(lines, start, F.greatest(F.col(last) - start + 1, F.lit(1)) if last else F.greatest(F.size(lines), F.lit(1)))
    rest = F.filter(span, lambda x: ~x.rlike(only))
    # all that follows is looked through only where the line itself is an annotation
    found = F.when(own.rlike(only), F.coalesce(F.get(rest, F.lit(0)), F.element_at(span, -1))).otherwise(own)
    bare = trim_ws(F.regexp_replace(F.regexp_replace(trim_ws(found), r"\s*\{\s*$", ""), r"\s*:\s*$", ""))
    cut = F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most - 3), F.lit("..."))).otherwise(bare)
    return F.when((F.col(line) >= 1) & cut.isNotNull(), cut).otherwise(F.col(name))


def text_hash(text: str | Column) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def reuse(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """New chunks with the stored vector where key and hash agree (``reused``), else null. ``stored`` may
    repeat a key and hash; any of its vectors does, the smallest is taken."""
    have = stored.groupBy(*key, "hash").agg(F.min("embedding").alias("embedding"))
    both = new.join(have, [*key, "hash"], "left")
    return both.withColumn("reused", F.col("embedding").isNotNull())


def embed(rows: DataFrame, text: str, name: str, backend: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """Vectors of an injected embedding backend, a few texts a request; one per text or an error."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for i in range(0, len(pdf), batch):
                texts = pdf[text].iloc[i : i + batch].tolist()
                got = backend(texts)
                if len(got) != len(texts) or len({len(g) for g in got}) > 1:
                    raise ValueError("the embedding backend must give one vector of equal length for each text")
                out += got
            yield pdf.assign(**{name: out})

    return rows.mapInPandas(run, schema)


def answer_prompt(blocks: str, question: str) -> Column:
    head = F.lit("Answer from the numbered excerpts below and cite them as [n]. Say so if they don't hold the answer.")
    return F.concat_ws("\n\n", head, F.col(blocks), F.concat(F.lit("Question: "), F.col(question)))


def loose_json(text: str) -> Column:
    """The JSON object inside a reply: the whole text, a fenced block, or from the first to the last brace."""
    t = F.col(text)
    fenced = F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1)
    braced = F.regexp_extract(t, r"(\{[\s\S]*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & trim_ws(c).startswith("{"), trim_ws(c))
    return F.coalesce(ok(t), ok(fenced), ok(braced))
