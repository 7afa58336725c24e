"""Summaries and answers through injected model backends; everything around the model call is Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.functions.exprs import fixed3, round4
from codelode.operators import chunks as C
from codelode.operators import vectors as V
from codelode.session import written

PROMPT_VERSION = 1


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    model: str

    def generate(self, prompt: str) -> str: ...


class BagOfWords:
    """Offline embedder: how often each of a few words occurs."""

    def __init__(self, words: list[str]):
        self.words, self.model = [w.lower() for w in words], "bag-of-words"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(w)) for w in self.words] for t in texts]


def content_hash(path: str, content: str) -> Column:
    """Key of a summary: differs by path and by content."""
    return F.sha2(F.concat_ws("\u0000", F.col(path), F.col(content)), 256)


def file_prompt(path: str, language: str, loc: str, declares: str, content: str, most: int = 6000) -> Column:
    """What a file's summary is asked with: facts, declarations and the head of its text."""
    long = F.length(content) > most
    head = F.when(long, F.concat(F.lit(f"Source (first {most} of "), F.length(content), F.lit(" characters):"))).otherwise(F.lit("Source:"))
    listed = F.coalesce(F.nullif(F.array_join(declares, "\n"), F.lit("")), F.lit("(no declarations)"))
    return F.concat_ws("\n", F.concat(F.lit("Summarise the file "), F.col(path), F.lit(" ("), F.coalesce(F.col(language), F.lit("unknown")), F.lit(", "), F.coalesce(F.col(loc), F.lit(0)), F.lit(" lines).")),
                       F.lit("Declarations:"), listed, head, F.substring(content, 1, most), F.lit('Reply with JSON: {"summary": "...", "functions": [{"name": "...", "summary": "..."}]}'))


REPLY = "struct<summary:string,functions:array<struct<name:string,summary:string>>>"


def summarise(files: DataFrame, cache: DataFrame, chat: Chat, key: list[str], prompt: str, hash_: str, tasks: int | None = None) -> DataFrame:
    """``files`` with ``reply`` (a struct), ``source``: ``cache``, ``model`` or ``failed``, and ``failure``.

    ``cache`` has (hash, model, prompt_version, reply). Only files that it doesn't hold are sent to the
    model, by at most ``tasks`` tasks (by default as many as there are cores); one that fails is counted, it doesn't stop the others."""
    held = cache.where((F.col("model") == chat.model) & (F.col("prompt_version") == PROMPT_VERSION)).groupBy("hash").agg(F.any_value("reply").alias("reply"))
    both = files.join(held.withColumnRenamed("hash", hash_), hash_, "left")
    hits = both.where("reply IS NOT NULL").select(*files.columns, "reply", F.lit("cache").alias("source"), F.lit(None).cast("string").alias("failure"))
    schema = T.StructType([*files.schema.fields, T.StructField("_text", T.StringType()), T.StructField("failure", T.StringType())])

    def run(batches):
        for pdf in batches:
            texts, failures = [], []
            for p in pdf[prompt]:
                try:
                    texts.append(chat.generate(p))
                    failures.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    failures.append(str(e)[:300])
            yield pdf.assign(_text=texts, failure=failures)

    asked = both.where("reply IS NULL").select(*files.columns).repartition(tasks or files.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, schema)
    parsed = asked.withColumn("reply", F.from_json(C.loose_json("_text"), REPLY))
    got = parsed.select(*files.columns, "reply", F.when(F.col("reply").isNotNull(), "model").otherwise("failed").alias("source"), F.when(F.col("reply").isNull(), F.coalesce("failure", F.lit("no JSON in the reply"))).alias("failure"))
    return hits.unionByName(got)


def declared_only(replies: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """Function summaries whose name the file declares (simple or qualified, any letter case):
    ``key..., qualified_name, summary``. ``names``: key..., fn_name, qualified_name."""
    said = replies.select(*key, F.explode("reply.functions").alias("f")).select(*key, F.lower(F.trim("f.name")).alias("_k"), F.trim("f.summary").alias("summary"))
    known = names.select(*key, "qualified_name", F.explode(F.array_distinct(F.array(F.lower("fn_name"), F.lower("qualified_name")))).alias("_k"))
    return said.join(known, [*key, "_k"]).groupBy(*key, "qualified_name").agg(F.min("summary").alias("summary"))


@dataclass
class Answer:
    ok: bool
    text: str = ""
    message: str = ""
    sources: list = None


def ask(spark: SparkSession, question: str, index: DataFrame, embedder: Embedder, chat: Chat, k: int = 8, balanced: bool = True) -> Answer:
    """An answer with cited sources; every failure is a message, never an exception. ``index``:
    chunk_no BIGINT, model, kind, path, ref, importance, text, embedding."""
    try:
        own = index.where(F.col("model") == embedder.model)
        dims = [r.n for r in own.select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
        if not dims:
            return Answer(False, message=f"There is no index for {embedder.model}; build it first.")
        vector = [float(x) for x in embedder.embed([question])[0]]
        if dims != [len(vector)]:
            return Answer(False, message=f"The index has vectors of {dims[0]} numbers, the question one of {len(vector)}; build the index again.")
        rows = own.select("chunk_no", "model", "kind", "embedding")
        asked = spark.createDataFrame([(-1, embedder.model, "file", vector)], rows.schema)
        hits = V.search(rows, asked, "chunk_no", "embedding", ["model"], "kind", k, len(vector)).join(own.select("chunk_no", "path", "ref", "importance", "text"), "chunk_no")
        by = [F.desc("score"), F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("chunk_no")]
        best = (V.balance(hits, "kind", by, k) if balanced else V.rank(hits, by, k)).withColumn("score", round4("score"))
        block = F.concat(F.lit("["), F.col("place"), F.lit("] (relevance "), fixed3("score"), F.lit(")\n"), F.col("text"))
        found = best.select("place", "kind", "path", "ref", "score", block.alias("block")).orderBy("place").toPandas()  # k rows
        prompt = spark.createDataFrame(pd.DataFrame({"b": ["\n\n".join(found["block"])], "q": [question]})).select(C.answer_prompt("b", "q")).first()[0]
        return Answer(True, chat.generate(prompt), sources=found.drop(columns="block").to_dict("records"))
    except Exception as e:  # noqa: BLE001
        return Answer(False, message=str(e)[:300])


def question_for(path: str) -> Column:
    """What to ask about a file."""
    return F.concat(F.lit("What is "), F.col(path), F.lit(" for, and what relies on it?"))


def question_for_folder(folder: str) -> Column:
    where = F.when(F.col(folder) == "", F.lit("the repository's root")).otherwise(F.col(folder))
    return F.concat(F.lit("What is "), where, F.lit(" responsible for, and which of its files matter most?"))


def counters(done: DataFrame) -> DataFrame:
    """One row for what ``summarise`` gave: selected, from the cache, generated, failed."""
    of = lambda s, name: F.count_if(F.col("source") == s).alias(name)
    return done.agg(F.count("*").alias("selected"), of("cache", "from_cache"), of("model", "generated"), of("failed", "failed"))


@dataclass
class Backends:
    chat: Chat
    embedder: Embedder
    note: str | None = None  # set where another provider embeds


def choose_backends(name: str, chats: dict, embedders: dict, fallback: str) -> Backends:
    """The chat backend of a provider with its own embeddings where it has any, else the fallback's, with a note.
    ``chats`` and ``embedders`` give a backend for a provider's name."""
    if name not in chats:
        raise ValueError(f"no provider {name}; there are {', '.join(sorted(chats))}")
    if name in embedders:
        return Backends(chats[name](), embedders[name]())
    embedder = embedders[fallback]()
    return Backends(chats[name](), embedder, f"{name} has no embeddings; {fallback} ({embedder.model}) embeds and must be running")


@dataclass
class IndexReport:
    ran: bool
    model: str
    total: int = 0
    embedded: int = 0
    reused: int = 0
    dim: int = 0
    message: str = ""


def build_index(chunks: DataFrame, stored: DataFrame, embedder: Embedder, key: list[str], save: Callable[[DataFrame], None]) -> IndexReport:
    """Brings an index up to date: vectors of chunks whose text is unchanged are kept, the others are embedded, all are
    brought to unit length and handed to ``save``. ``chunks``: key..., text and more; ``stored``: key..., hash,
    embedding of the embedder's model. On any failure nothing is saved and the report says why."""
    try:
        new = C.reuse(chunks.withColumn("hash", C.text_hash("text")), stored, key)
        counts = new.agg(F.count("*").alias("n"), F.count_if("reused").alias("r")).first()
        if not counts.n:
            return IndexReport(True, embedder.model, message="There is nothing to index.")
        made = C.embed(new.where("NOT reused").drop("embedding", "reused"), "text", "embedding", embedder.embed)
        every = written(new.where("reused").drop("reused").unionByName(made).withColumn("embedding", V.unit("embedding")), "index-new")
        dims = [r.n for r in every.select(F.coalesce(F.size("embedding"), F.lit(0)).alias("n")).distinct().limit(2).collect()]
        if len(dims) != 1 or dims[0] < 1:
            return IndexReport(False, embedder.model, reused=counts.r, message="The embedding model gave vectors of different lengths.")
        save(every)
        return IndexReport(True, embedder.model, counts.n, counts.n - counts.r, counts.r, dims[0])
    except Exception as e:  # noqa: BLE001
        return IndexReport(False, embedder.model, message=str(e)[:300])
