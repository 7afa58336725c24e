"""Imports to files and calls to declarations, as equi-joins.

Every rule that tries one place after another is a list of candidates with priorities, exploded and
joined on (repository, path); the best priority that is a file wins. Prefix and suffix searches are
exploded into all prefixes or suffixes, so nothing is compared pairwise. Specifiers repeat a lot, so
candidates are made once for each distinct (repository, folder, specifier).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.exprs import dirname, joined
from codelode.session import written

JS_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]  # fixed order of trial
RUNTIME_TO_SOURCE = {"js": [".ts", ".tsx", ".js", ".jsx"], "mjs": [".mts", ".mjs"], "cjs": [".cts", ".cjs"]}  # fixed


def js_candidates(base: Column) -> Column:
    """Paths that a JavaScript or TypeScript specifier can mean, best first."""
    ext = F.regexp_extract(base, r"\.([^./]+)$", 1)
    stem = F.regexp_replace(base, r"\.[^./]+$", "")
    swaps = F.array().cast("array<string>")
    for e, to in RUNTIME_TO_SOURCE.items():
        swaps = F.when(ext == e, F.array(*[F.concat(stem, F.lit(x)) for x in to])).otherwise(swaps)
    exact = F.when(ext != "", F.array(base)).otherwise(F.array().cast("array<string>"))
    inside = F.when(base == "", F.lit("index")).otherwise(F.concat(base, F.lit("/index")))
    return F.concat(swaps, exact, F.array(*[F.concat(base, F.lit(x)) for x in JS_EXTENSIONS]), F.array(*[F.concat(inside, F.lit(x)) for x in JS_EXTENSIONS]))


def py_candidates(base: Column) -> Column:
    inside = F.when(base == "", F.lit("__init__")).otherwise(F.concat(base, F.lit("/__init__")))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit(".pyi")), F.concat(inside, F.lit(".py")), F.concat(inside, F.lit(".pyi")))


def parents(folder: Column) -> Column:
    """The root, then the folder and its parents, nearest first."""
    parts = F.split(folder, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), up))


def suffixes(path: Column) -> Column:
    """All suffixes of a path that begin at a segment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve_imports(files: DataFrame, imports: DataFrame, packages: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """Every import with the files it can mean: ``repo_id, file_id, imp_ord, target_ord, target``.

    ``files``: repo_id, file_id, path, language. ``imports``: repo_id, file_id, imp_ord, specifier, kind;
    rows that repeat (file_id, imp_ord) are one. ``packages`` (repo_id, name, folder, ord) are workspace
    packages, ``modules`` (repo_id, module, folder) Go modules. Files of other repositories are never
    meant, nor is the importing file itself. Imports that mean no file have no row."""
    f = files.select("repo_id", "file_id", "path", F.lower("language").alias("language")).where(F.col("path").isNotNull())
    known = f.select("repo_id", "path").distinct()
    asked = imports.select("repo_id", "file_id", "imp_ord", F.trim("specifier").alias("specifier"), "kind").dropDuplicates(["file_id", "imp_ord"])
    asked = asked.join(f.select("file_id", F.col("path").alias("from_path")), "file_id").withColumn("folder", dirname("from_path"))
    asked = written(asked.withColumn("test", F.col("from_path").endswith("_test.go")), "asked")  # several rules read it
    distinct = asked.select("repo_id", "folder", "specifier", "kind", "test").distinct()
    key = ["repo_id", "folder", "specifier", "kind", "test"]
    js = F.col("kind").isin("esm", "require", "dynamic")

    # one file at most: JavaScript and Python
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    single = distinct.where(js | (F.col("kind") == "python")).withColumns({"_dots": dots, "_rest": F.translate(F.regexp_replace("specifier", r"^\.+", ""), ".", "/")})
    tail = F.when(js, F.col("specifier")).otherwise(F.concat(F.lit("./"), F.repeat(F.lit("../"), F.col("_dots") - 1), F.col("_rest")))
    single = single.where((F.col("_dots") > 0) | ((F.col("kind") == "python") & (F.col("specifier") != ""))).withColumn("_base", F.when(F.col("_dots") > 0, joined("folder", tail)))
    bases = F.transform(parents(F.col("folder")), lambda r: F.when(r == "", F.col("_rest")).otherwise(F.concat(r, F.lit("/"), F.col("_rest"))))
    tries = F.when(js, js_candidates(F.col("_base"))).when(F.col("_dots") > 0, py_candidates(F.col("_base"))).otherwise(F.flatten(F.transform(bases, py_candidates)))
    tried = single.select(*key, F.posexplode(tries).alias("_rank", "path"))
    if packages is not None:
        bare = distinct.where(js & ~F.col("specifier").rlike(r"^[./]"))
        parts = F.split("specifier", "/")
        heads = bare.select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("name"))
        first = heads.join(packages.withColumnRenamed("folder", "pkg"), ["repo_id", "name"]).groupBy(*key).agg(F.min_by(F.struct("name", "pkg"), "ord").alias("p"))
        first = first.withColumn("_base", joined("p.pkg", F.expr("substring(specifier, length(p.name) + 2)"))).withColumn("_src", F.concat_ws("/", F.nullif("_base", F.lit("")), F.lit("src")))
        tried = tried.unionByName(first.select(*key, F.posexplode(F.concat(js_candidates(F.col("_base")), js_candidates(F.col("_src")))).alias("_rank", "path")))
    one = tried.where("path IS NOT NULL").join(known, ["repo_id", "path"]).groupBy(*key).agg(F.min_by("path", "_rank").alias("target")).withColumn("target_ord", F.lit(0))

    # packages of several files: Java and Go. A place is (what, at): a file's or folder's suffix, or a folder
    place = lambda what, at: F.struct(F.lit(what).alias("what"), at.alias("at"))
    java_file, go_file = F.col("path").endswith(".java"), F.col("path").endswith(".go")
    no_place = F.array().cast("array<struct<what:string,at:string>>")
    of_java = F.concat(F.transform(suffixes(F.col("path")), lambda x: place("file", x)), F.transform(suffixes(dirname("path")), lambda x: place("folder", x)))
    here = F.array(place("own", dirname("path")))
    places = F.concat(F.when(java_file, of_java).otherwise(no_place), here, F.when(go_file & ~F.col("path").endswith("_test.go"), F.array(place("go", dirname("path")))).otherwise(no_place), F.when(go_file, F.array(place("gotest", dirname("path")))).otherwise(no_place))
    known_places = known.select("repo_id", "path", F.explode(places).alias("_p")).select("repo_id", F.col("path").alias("target"), "_p.what", "_p.at")
    parts = F.split("specifier", r"\.")
    ends = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: (k > 1) | (F.size(parts) == 1))
    want = lambda what, at, end: F.struct(F.lit(what).alias("what"), at.alias("at"), end.cast("int").alias("end"))
    wants = (
        F.when((F.col("kind") == "java") & (F.col("specifier") == "*"), F.array(want("own", F.col("folder"), F.lit(0))))
        .when((F.col("kind") == "java") & F.col("specifier").endswith(".*"), F.array(want("folder", F.translate(F.expr("substring(specifier, 1, length(specifier) - 2)"), ".", "/"), F.lit(0))))
        .when(F.col("kind") == "java", F.transform(ends, lambda k: want("file", F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit(".java")), k)))
        .when((F.col("kind") == "go") & (F.col("specifier") == "."), F.when(F.col("test"), F.array(want("gotest", F.col("folder"), F.lit(0)))).otherwise(F.array(want("go", F.col("folder"), F.lit(0)))))
    )
    wanted = distinct.where(F.col("kind").isin("java", "go")).select(*key, F.explode(wants).alias("_w")).select(*key, "_w.what", "_w.at", "_w.end")
    if modules is not None:
        segments = F.split("specifier", "/")
        heads = distinct.where((F.col("kind") == "go") & (F.col("specifier") != ".")).select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, 1, k), "/"))).alias("module"))
        best = heads.join(modules.withColumnRenamed("folder", "root"), ["repo_id", "module"]).groupBy(*key).agg(F.max_by(F.struct("module", "root"), F.length("module")).alias("m"))
        wanted = wanted.unionByName(best.select(*key, F.lit("go").alias("what"), joined("m.root", F.expr("substring(specifier, length(m.module) + 2)")).alias("at"), F.lit(0).alias("end")))
    hits = wanted.join(known_places, ["repo_id", "what", "at"]).groupBy(*key, "target").agg(F.max("end").alias("end"))
    per = Window.partitionBy(*key)
    many = hits.withColumn("_most", F.max("end").over(per)).where("end = _most").withColumn("target_ord", F.row_number().over(per.orderBy("target")) - 1)
    every = one.unionByName(many.select(*one.columns))
    return asked.join(every, key).where(F.col("target") != F.col("from_path")).select("repo_id", "file_id", "imp_ord", "from_path", "target_ord", "target")


def external_imports(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """Imports that mean no file and aren't implicit."""
    once = imports.dropDuplicates(["file_id", "imp_ord"]).where(~F.coalesce("implicit", F.lit(False)))
    return once.join(resolved.select("file_id", "imp_ord").distinct(), ["file_id", "imp_ord"], "left_anti")


def narrow(resolved: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """Of an import with ``uses`` only the targets that declare a used name (simple or qualified), with
    the names; an explicit Go import keeps all its targets if none does. ``functions``: repo_id, path,
    fn_name, qualified_name. Adds ``used`` (null for imports without ``uses``)."""
    once = imports.dropDuplicates(["file_id", "imp_ord"]).select("file_id", "imp_ord", "kind", "uses", F.coalesce("implicit", F.lit(False)).alias("implicit"))
    both = resolved.join(once, ["file_id", "imp_ord"])
    names = functions.select("repo_id", F.col("path").alias("target"), F.explode(F.array("fn_name", "qualified_name")).alias("name")).distinct()
    declared = both.where(F.col("uses").isNotNull()).select("repo_id", "file_id", "imp_ord", "target", F.explode("uses").alias("name")).join(names, ["repo_id", "target", "name"])
    hit = declared.groupBy("file_id", "imp_ord", "target").agg(F.array_sort(F.collect_set("name")).alias("used"))
    any_hit = hit.groupBy("file_id", "imp_ord").agg(F.count("*").alias("_hits"))
    all_of = both.join(hit, ["file_id", "imp_ord", "target"], "left").join(any_hit, ["file_id", "imp_ord"], "left")
    keep = F.col("uses").isNull() | F.col("used").isNotNull() | (F.col("_hits").isNull() & (F.col("kind") == "go") & ~F.col("implicit"))
    return all_of.where(keep).drop("_hits", "uses", "implicit")


def symbol_index(functions: DataFrame) -> DataFrame:
    """``repo_id, path, name, id``: what a name means inside a file. A declaration outside any class beats
    others of the same simple name (the last of them), otherwise the first counts; of equal qualified
    names the last. ``functions``: repo_id, path, fn_name, qualified_name, id, ord."""
    qualified = functions.groupBy("repo_id", "path", F.col("qualified_name").alias("name")).agg(F.max_by("id", "ord").alias("id")).withColumn("rank", F.lit(0))
    simple = functions.groupBy("repo_id", "path", F.col("fn_name").alias("name")).agg(F.min_by("id", "ord").alias("id")).withColumn("rank", F.lit(1))
    return qualified.unionByName(simple).groupBy("repo_id", "path", "name").agg(F.min_by("id", "rank").alias("id"))


def binding_origins(narrowed: DataFrame, imports: DataFrame) -> DataFrame:
    """``repo_id, path, name, origin``: the file that a local name comes from. Used names come from each
    target that declares them, imported names from the first target; what is written last counts."""
    used = narrowed.where(F.col("used").isNotNull()).select("repo_id", F.col("from_path").alias("path"), F.explode("used").alias("name"), F.col("target").alias("origin"), "imp_ord", F.lit(0).alias("step"), "target_ord")
    first = narrowed.groupBy("repo_id", "file_id", "imp_ord", "from_path").agg(F.min_by("target", "target_ord").alias("origin"))
    names = imports.dropDuplicates(["file_id", "imp_ord"]).select("file_id", "imp_ord", F.explode("names.local_name").alias("name"))
    local = first.join(names, ["file_id", "imp_ord"]).select("repo_id", F.col("from_path").alias("path"), "name", "origin", "imp_ord", F.lit(1).alias("step"), F.lit(0).alias("target_ord"))
    return used.unionByName(local).groupBy("repo_id", "path", "name").agg(F.max_by("origin", F.struct("imp_ord", "step", "target_ord")).alias("origin"))


def resolve_calls(calls: DataFrame, index: DataFrame, origins: DataFrame) -> DataFrame:
    """``repo_id, src, dst`` for each call that is made inside a declaration and whose name is known in
    its own file, else in the file the name was imported from. ``calls``: repo_id, path, callee, enclosing."""
    made = calls.where("enclosing IS NOT NULL AND callee IS NOT NULL")
    own = index.select("repo_id", "path", F.col("name").alias("callee"), F.col("id").alias("own_id"))
    there = origins.join(index.select("repo_id", F.col("path").alias("origin"), "name", F.col("id").alias("there_id")), ["repo_id", "origin", "name"]).select("repo_id", "path", F.col("name").alias("callee"), "there_id")
    both = made.join(own, ["repo_id", "path", "callee"], "left").join(there, ["repo_id", "path", "callee"], "left")
    return both.select("repo_id", F.col("enclosing").alias("src"), F.coalesce("own_id", "there_id").alias("dst")).where("dst IS NOT NULL AND src <> dst")
