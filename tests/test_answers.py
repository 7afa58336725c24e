"""Summaries and answers with fake backends."""

import json

from pyspark.sql import functions as F

from codelode.operators import answers as A


def Fake(reply):  # the class is local, so that it travels to the workers with its code
    class Chat:
        model = "fake"

        def generate(self, prompt):
            if "broken" in prompt:
                raise RuntimeError("the model is away")
            return reply

    return Chat()


def test_summaries(spark):
    files = spark.createDataFrame([(1, "a.ts", "x" * 18_000), (2, "b.ts", "y"), (3, "broken.ts", "z")], "id long, path string, content string")
    files = files.withColumn("language", F.lit("typescript")).withColumn("loc", F.lit(3)).withColumn("declares", F.array(F.lit("- f")))
    files = files.withColumn("hash", A.content_hash("path", "content")).withColumn("prompt", A.file_prompt("path", "language", "loc", "declares", "content"))
    p = files.where("id = 1").first().prompt
    assert "first 6000 of 18000 characters" in p and p.count("x") >= 6000 and p.count("x") < 6100
    reply = json.dumps({"summary": " s ", "functions": [{"name": "F", "summary": "does f"}, {"name": "ghost", "summary": "no"}]})
    cache = files.where("id = 2").select("hash", F.lit("fake").alias("model"), F.lit(A.PROMPT_VERSION).alias("prompt_version"), F.from_json(F.lit(reply), A.REPLY).alias("reply"))
    got = {r.id: r for r in A.summarise(files, cache, Fake(f"Here:\n```json\n{reply}\n```"), ["id"], "prompt", "hash").collect()}
    assert {k: r.source for k, r in got.items()} == {1: "model", 2: "cache", 3: "failed"} and got[3].failure == "the model is away"
    other = {r.id: r.source for r in A.summarise(files, cache.withColumn("model", F.lit("other")), Fake("nothing"), ["id"], "prompt", "hash").collect()}
    assert other == {1: "failed", 2: "failed", 3: "failed"}
    names = spark.createDataFrame([(1, "f", "f"), (1, "g", "A.g")], "id long, fn_name string, qualified_name string")
    out = A.declared_only(A.summarise(files, cache, Fake(reply), ["id"], "prompt", "hash").where("reply IS NOT NULL"), names, ["id"])
    assert [(r.id, r.qualified_name, r.summary) for r in out.collect()] == [(1, "f", "does f")]
    assert A.summarise(files.limit(0), cache, Fake(reply), ["id"], "prompt", "hash").count() == 0


def test_ask(spark):
    e = A.BagOfWords(["registry", "helper"])
    rows = [(i, "bag-of-words", "file" if i % 2 else "function", f"p{i}", None, 0.5, t, e.embed([t])[0]) for i, t in enumerate(["registry registry", "helper", "registry helper"])]
    index = spark.createDataFrame(rows, "chunk_no long, model string, kind string, path string, ref string, importance double, text string, embedding array<float>")
    got = A.ask(spark, "where is the registry?", index, e, Fake("in [1]"), k=2, balanced=False)
    assert got.ok and got.text == "in [1]" and [s["path"] for s in got.sources] == ["p0", "p2"] and got.sources[0]["score"] == 1.0
    assert "no index" in A.ask(spark, "x", index.limit(0), e, Fake("")).message
    assert "again" in A.ask(spark, "x", index, A.BagOfWords(["a", "b", "c"]), Fake("")).message
    assert not A.ask(spark, "broken registry", index, e, Fake("")).ok


def test_build_index(spark):
    e = A.BagOfWords(["registry", "helper"])
    chunks = spark.createDataFrame([("a", "registry registry"), ("b", "helper"), ("c", "nothing")], "id string, text string")
    saved = []
    none = spark.createDataFrame([], "id string, hash string, embedding array<float>")
    r = A.build_index(chunks, none, e, ["id"], lambda df: saved.append(df.select("id", "hash", "embedding")))
    assert (r.ran, r.total, r.embedded, r.reused, r.dim) == (True, 3, 3, 0, 2) and {x.id: list(x.embedding) for x in saved[0].collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.0, 0.0]}
    edited = chunks.withColumn("text", F.when(F.col("id") == "b", "helper registry").otherwise(F.col("text")))
    r = A.build_index(edited, saved[0], e, ["id"], lambda df: saved.append(df))
    assert (r.embedded, r.reused) == (1, 2) and len(saved) == 2
    assert A.build_index(chunks.limit(0), none, e, ["id"], saved.append).message == "There is nothing to index."

    class Ragged:
        model = "ragged"

        def embed(self, texts):
            return [[1.0] * (1 + len(t) % 2) for t in texts]

    bad = A.build_index(chunks, none, Ragged(), ["id"], saved.append)
    assert not bad.ran and bad.message and len(saved) == 2


def test_counters_and_backends(spark):
    done = spark.createDataFrame([("cache",), ("model",), ("model",), ("failed",)], "source string")
    assert tuple(A.counters(done).first()) == (4, 1, 2, 1) and tuple(A.counters(done.limit(0)).first()) == (0, 0, 0, 0)
    own = A.choose_backends("a", {"a": lambda: "chat"}, {"a": lambda: "embed"}, "b")
    assert own.note is None and own.embedder == "embed"
    other = A.choose_backends("a", {"a": lambda: "chat"}, {"b": lambda: A.BagOfWords(["x"])}, "b")
    assert "b (bag-of-words)" in other.note
    df = spark.createDataFrame([("src/a.py", ""), ("b.py", "src")], "p string, f string")
    assert [r[0] for r in df.select(A.question_for("p")).collect()][0].startswith("What is src/a.py ") and "root" in df.select(A.question_for_folder("f")).first()[0]
