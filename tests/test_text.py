"""Expressions, chunk texts, sources and clusters."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codelode.functions import exprs as X
from codelode.operators import chunks as C
from codelode.operators import explore as O
from codelode.operators import extract as P
from codelode.operators import vectors as V
from codelode.sources import store, tree


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


def test_numbers(spark):
    assert one(spark, 0.2345, X.fixed3, "double") == "0.234" and one(spark, 0.0625, X.fixed3, "double") == "0.063" and one(spark, None, X.fixed3, "double") is None
    assert one(spark, 0.12345, X.round4, "double") == 0.1235
    assert [one(spark, n, X.compact_count, "long") for n in (7, 999, 1000, 69000, 1234, 2_500_000)] == ["7", "999", "1K", "69K", "1.2K", "2.5M"]


def test_addresses(spark):
    assert one(spark, "https://u:p@host.example/a", X.redact_url) == "https://<redacted>@host.example/a"
    assert one(spark, "git@host.example:o/r.git", X.redact_url) == "git@host.example:o/r.git"
    assert one(spark, "see HTTPS://me@h/x and ssh://a:b@h/y", X.redact_urls) == "see HTTPS://<redacted>@h/x and ssh://<redacted>@h/y"
    assert [one(spark, v, X.is_repo_url) for v in ("https://h/x", "git@h:o/r", "./here", "ssh://h/x")] == [True, True, False, True]
    assert [one(spark, v, X.repo_name) for v in ("https://h/o/r.git", "git@h:o/r.git", "/tmp/x/")] == ["r", "r", "x"]
    assert one(spark, "https://u@h.example/../o/r e.git", X.cache_folder) == "h.example/o/r_e"
    assert one(spark, "abcabc", lambda c: X.redact_secret(c, F.lit("abc"))) == "abcabc" and one(spark, "xabcdx", lambda c: X.redact_secret(c, F.lit("abcd"))) == "x<redacted>x"


def test_paths(spark):
    assert one(spark, "a/b", lambda c: X.joined(c, F.lit("../c/./d.js"))) == "a/c/d.js"
    assert one(spark, "a", lambda c: X.joined(c, F.lit("../../d"))) is None
    assert one(spark, "x.PY", X.language_of) == "python" and one(spark, "x.rb", X.language_of) is None
    assert one(spark, "\u00a0 \tx\n", X.trim_ws) in ("x", "\u00a0 \tx")


def test_signature_and_loc(spark):
    src = "@x\n@y\ndef f(a):\n    pass\n"
    df = spark.createDataFrame([(src, 1, "f"), (src, 99, "g"), (None, 1, "h"), ("x" * 200 + " {", 1, "i")], "c string, n int, name string")
    got = [r.s for r in df.select(C.signature("c", "n", "name").alias("s")).collect()]
    assert got[:3] == ["def f(a)", "g", "h"] and len(got[3]) == 120 and got[3].endswith("...")
    assert [one(spark, t, lambda c: P.loc("v")) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 2, 2]


def test_extraction(spark):
    src = {"typescript": "import a from './a';\nexport { b } from \"./b\";\nconst c = require('c');\nexport const f = async (x: T) => {\nclass W {", "python": "from .x import y\nimport os.path\nclass A:\n    def m(self):", "java": "import static com.acme.A.*;\npublic final class B {\n  public int f(int x) {", "go": 'import (\n\t"fmt"\n\tst "git.example/store"\n)\nfunc (s *S) Run() {\ntype S struct {\nfunc main() {'}
    files = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(src.items())], "id int, language string, content string")
    lines = P.lines(files, "id", "language", "content")
    assert sorted((r.id, r.specifier) for r in P.matches(lines, "id", P.IMPORTS, "specifier").collect()) == [(0, "./a"), (0, "./b"), (0, "c"), (1, ".x"), (1, "os.path"), (2, "com.acme.A.*"), (3, "fmt"), (3, "git.example/store")]
    assert sorted((r.id, r.name) for r in P.matches(lines, "id", P.DECLARATIONS, "name").collect()) == [(0, "W"), (0, "f"), (1, "A"), (1, "m"), (2, "B"), (2, "f"), (3, "Run"), (3, "S"), (3, "main")]


def test_loose_json(spark):
    for reply in ('{"a": 1}', 'Sure:\n```json\n{"a": 1}\n```', 'It is {"a": 1} I think'):
        assert one(spark, reply, lambda c: C.loose_json("v")) == '{"a": 1}'
    assert one(spark, "nothing", lambda c: C.loose_json("v")) is None


def test_search_and_balance(spark):
    rows = [(i, "m", "file" if i < 5 else "function", [1.0, 0.01 * (i if i < 5 else i + 5)]) for i in range(10)] + [(99, "m", "file", [0.0, 0.0]), (98, "m", "file", None), (97, "m", "file", [1.0])]
    df = spark.createDataFrame(rows, "k long, model string, kind string, v array<float>")
    q = spark.createDataFrame([(-1, "m", "file", [1.0, 0.0])], df.schema)
    hits = V.search(df, q, "k", "v", ["model"], "kind", 5, 2)
    by = [F.desc("score"), F.asc("k")]
    pick = lambda n: [r.k for r in V.balance(hits, "kind", by, n).orderBy("place").collect()]
    assert [r.k for r in V.rank(hits, by, 4).orderBy("place").collect()] == [0, 1, 2, 3]
    assert pick(4) == [0, 1, 5, 6] and pick(5) == [0, 1, 2, 5, 6] and pick(1) == [0]
    assert one(spark, [3.0, 4.0], lambda c: V.unit("v"), "array<float>") == pytest.approx([0.6, 0.8]) and one(spark, [0.0, 0.0], lambda c: V.unit("v"), "array<float>") == [0, 0]
    assert V.search(df.limit(0), q, "k", "v", ["model"], "kind", 5, 2).count() == 0


def test_embedding_backend(spark):
    df = spark.createDataFrame([("a b",), ("b",)], "t string")
    got = C.embed(df, "t", "e", lambda ts: [[float(t.count("b"))] for t in ts]).collect()
    assert [r.e for r in got] == [[1.0], [1.0]]
    with pytest.raises(Exception, match="equal length"):
        C.embed(df.coalesce(1), "t", "e", lambda ts: [[1.0] * len(t) for t in ts]).collect()


def test_reuse(spark):
    new = spark.createDataFrame([("a", "h1"), ("b", "h2")], "id string, hash string")
    stored = spark.createDataFrame([("a", "h1", [1.0]), ("a", "h1", [1.0]), ("b", "old", [2.0])], "id string, hash string, embedding array<float>")
    assert {r.id: r.reused for r in C.reuse(new, stored, ["id"]).collect()} == {"a": True, "b": False}


def test_clusters():
    assert set(O.plan_clusters([("", 1), ("src", 2), ("src/lib", 1), ("tests", 2)], 10).values()) == {"", "src", "src/lib", "tests"}
    many = [(f"components/c{i:03}", 1) for i in range(300)] + [("components/huge", 20)]
    got = O.plan_clusters(many, 10, 20)
    assert set(got) == {f for f, _ in many} and len(set(got.values())) <= 10 and got["components/huge"] == "components/huge" and any("+" in c for c in got.values())
    giants = [(f"a/s{i}", 6) for i in range(100)] + [(f"b/s{i}", 5) for i in range(100)]
    got = O.plan_clusters(giants, 20, 40)
    assert len(set(got.values())) <= 40 and {c.split("/")[0] for c in got.values()} == {"a", "b"}


def test_cluster_frames(spark):
    c = spark.createDataFrame([(1, "core/src/a.ts", "core/src"), (1, "web/src/b.ts", "web/src"), (1, "test/c.ts", "test")], "repo_id long, path string, cluster string")
    assert {r.cluster: r.label for r in O.cluster_labels(c).collect()} == {"core/src": "core/src", "web/src": "web/src", "test": "test"}
    e = spark.createDataFrame([(1, "core/src/a.ts", "web/src/b.ts", 7), (1, "core/src/a.ts", "core/src/a.ts", 1)], "repo_id long, src string, dst string, weight int")
    assert [(r.src_cluster, r.dst_cluster, r.weight) for r in O.cluster_edges(e, c).collect()] == [("core/src", "web/src", 1)]
    p = spark.createDataFrame([(1, float(i), 0.0, 0.0, 0.5) for i in range(10)], "g int, x double, y double, z double, w double")
    s = O.cluster_stats(p, ["g"], "x", "y", "z", "w").first()
    assert (s.cx, s.members, s.spread) == (4.5, 10, 4.5)


@pytest.fixture()
def repo(tmp_path):
    for name, text in {"hub.ts": "export const x = 1;", "app.ts": "x", "gen/a.ts": "no", "a.gen.ts": "no", "keep.gen.ts": "yes", "node_modules/z.js": "no", "py/m.py": "x", "py/.gitignore": "loc*\n", "py/local.py": "no", ".gitignore": "gen/\n*.gen.ts\n!keep.gen.ts\n", "package.json": '{"name": "p"}', "go.mod": "module git.example/m\n", "bad.ts": None}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"\xff\xfe\xff" if text is None else text.encode())
    return tmp_path


def test_walk_and_read(spark, repo):
    spark.dataSource.register(tree.TreeSource)
    rows = spark.read.format("tree").load(str(repo))
    got = {r.path: r for r in rows.collect()}
    assert set(got) == {"hub.ts", "app.ts", "keep.gen.ts", "py/m.py", "package.json", "go.mod", "bad.ts"} and got["py/m.py"].language == "python" and got["go.mod"].manifest
    texts = {r.path: r for r in tree.read_text(rows).collect()}
    assert texts["hub.ts"].content.startswith("export") and texts["bad.ts"].content is None and "UnicodeDecodeError" in texts["bad.ts"].failure
    names = {r.path: (r.package, r.module) for r in tree.package_names(tree.read_text(rows.where("manifest"))).collect()}
    assert names == {"package.json": ("p", None), "go.mod": (None, "git.example/m")}


def test_history(spark, repo):
    def git(*a):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    assert tree.history(spark, str(repo / "none")).count() == 0
    git("init", "-q")
    git("add", "hub.ts", "app.ts")
    git("commit", "-qm", "1")
    for i in range(2):
        (repo / "hub.ts").write_text(str(i))
        git("commit", "-qam", "more")
    files = spark.createDataFrame([("hub.ts",), ("app.ts",), ("py/m.py",)], "path string")
    assert {r.path: r.churn for r in tree.churn_counts(files, tree.history(spark, str(repo))).collect()} == {"hub.ts": 3, "app.ts": 1, "py/m.py": 0}


def test_store(spark, tmp_path):
    schema = "id string, model string, embedding array<float>"
    df = spark.createDataFrame([("a", "M 1", [1.0]), ("b", "M 1", [2.0])], schema)
    store.save_index(df, str(tmp_path), ["M 1"])
    assert store.model_slug("Nomic:V1.5 x") == "nomic_v1.5_x"
    assert store.load_index(spark, str(tmp_path), "M 1", "id string, embedding array<float>").count() == 2
    assert store.load_index(spark, str(tmp_path), "other", schema).count() == 0
    store.save_index(spark.createDataFrame([("a", "R", [1.0]), ("b", "R", [2.0, 3.0])], schema), str(tmp_path), ["R"])
    assert store.load_index(spark, str(tmp_path), "R", "id string, embedding array<float>").count() == 0
    nodes, edges = spark.createDataFrame([(1, "a"), (1, "b")], "g int, path string"), spark.createDataFrame([(1, "a", "b", 2)], "g int, src string, dst string, weight int")
    assert store.graph_json(nodes, edges, "g").first().document == '{"nodes":[{"path":"a"},{"path":"b"}],"edges":[{"src":"a","dst":"b","weight":2}]}'
    assert store.prune_cache(df, df.where("id = 'a'"), ["id"]).count() == 1
    assert os.path.exists(tmp_path)


def test_stream(spark, tmp_path):
    from codelode.streaming import refresh as S

    schema = "repo_id long, path string, content string, walked_at timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    load = lambda: spark.read.schema("repo_id long, path string, content string, hash string").parquet(out) if os.path.exists(out) else spark.createDataFrame([], "repo_id long, path string, hash string")
    put = lambda df: df.write.mode("append").parquet(out)
    for text in ("v1", "v1", "v2"):
        spark.createDataFrame([(1, "a.ts", text, None)], schema).withColumn("walked_at", F.current_timestamp()).write.mode("append").parquet(src)
        S.refresh(S.changed_files(spark, src, schema), load, put, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.content for r in spark.read.parquet(out).collect()) == ["v1", "v2"]
