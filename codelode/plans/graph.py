"""Queries over the file graph and the call graph of every repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import exprs as X
from codelode.operators import edges as E
from codelode.operators import resolve as R
from codelode.operators.explore import top_rows
from codelode.operators.pagerank import pagerank
from codelode.plans.catalogue import query
from codelode.session import table, written

# -- shared parts


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("repo_id", "file_id", "path", "language", "file_ord")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Of the five files that follow each in its repository, those of its own family of languages, with the first
    name that each declares. The recorded imports hardly name a file of the tables; these do."""
    family = F.when(F.col("path").rlike(r"\.pyi?$"), "python").when(F.col("path").endswith(".java"), "java").when(F.col("path").endswith(".go"), "go").when(F.col("path").rlike(r"\.(m?[jt]s|tsx)$"), "esm")
    f = table(spark, d, "source_files").select("repo_id", "file_id", "path", "file_ord", X.dirname("path").alias("folder"), family.alias("kind")).where("kind IS NOT NULL")
    names = table(spark, d, "function_nodes").groupBy("file_id").agg(F.min("fn_name").alias("fn"), F.min("id").alias("fn_id"))
    f = f.join(names, "file_id", "left")
    a = f.select("repo_id", "kind", "file_id", "folder", "fn_id", "file_ord", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).withColumn("ord", F.col("file_ord") + F.col("k")).drop("file_ord")
    t = f.select("repo_id", "kind", F.col("file_ord").alias("ord"), F.col("path").alias("to_path"), F.col("folder").alias("to_folder"), "fn")
    return a.join(t, ["repo_id", "kind", "ord"]).withColumn("stem", F.regexp_replace("to_path", r"\.[^./]+$", ""))


def _specifier() -> F.Column:
    """How the files of ``_links`` are asked for: by relative and absolute names, by package, module and workspace."""
    k, stem = F.col("k"), F.col("stem")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    dotted = F.translate(stem, "/", ".")
    relative = F.concat(F.when(depth == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), depth)), stem, F.when(k % 3 == 2, ".js").otherwise(""))
    return (
        F.when(F.col("kind") == "python", F.concat(F.when(k % 2 == 1, F.repeat(F.lit("."), depth + 1)).otherwise(""), dotted))
        .when((F.col("kind") == "java") & (k % 2 == 0) & (F.col("to_folder") != ""), F.concat(F.translate("to_folder", "/", "."), F.lit(".*")))
        .when(F.col("kind") == "java", dotted)
        .when(F.col("kind") == "go", F.concat_ws("/", F.concat(F.lit("git.example/m"), F.col("repo_id")), F.nullif("to_folder", F.lit(""))))
        .when(k % 3 == 0, F.concat(F.lit("@m"), F.col("repo_id"), F.lit("/"), stem))
        .otherwise(relative)
    )


def imports(spark: SparkSession, d: str) -> DataFrame:
    """The recorded imports, and those of ``_links``."""
    recorded = table(spark, d, "import_refs").select("repo_id", "file_id", "imp_ord", F.trim("specifier").alias("specifier"), "kind", "names", "uses", "implicit")
    types = dict(recorded.dtypes)
    bound = F.col("kind").isin("esm", "python") & F.col("fn").isNotNull()
    names = F.when(bound, F.array(F.struct(F.col("fn").alias("local_name"), F.col("fn").alias("imported_name")))).otherwise(F.expr("array()").cast(types["names"]))
    uses = F.when(F.col("kind").isin("java", "go"), F.array_compact(F.array("fn")))
    derived = _links(spark, d).select("repo_id", "file_id", (F.col("k") + 1000).cast(types["imp_ord"]).alias("imp_ord"), _specifier().alias("specifier"), "kind", names.cast(types["names"]).alias("names"), uses.cast(types["uses"]).alias("uses"), F.lit(False).alias("implicit"))
    return recorded.unionByName(derived)


def packages(spark: SparkSession, d: str) -> DataFrame:
    """Workspace packages: the top folders of each repository."""
    top = F.substring_index("path", "/", 1)
    named = table(spark, d, "source_files").where("path LIKE '%/%'").select("repo_id", F.concat(F.lit("@m"), F.col("repo_id"), F.lit("/"), top).alias("name"), top.alias("folder")).distinct()
    return named.withColumn("ord", F.lit(0))


def modules(spark: SparkSession, d: str) -> DataFrame:
    """One Go module at the root of each repository."""
    return table(spark, d, "source_files").select("repo_id").distinct().select("repo_id", F.concat(F.lit("git.example/m"), F.col("repo_id")).alias("module"), F.lit("").alias("folder"))


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Declarations once each, with the path of their file and their order in it."""
    f = table(spark, d, "function_nodes").select("id", "repo_id", "file_id", "fn_name", "qualified_name", "kind", "start_line", "end_line", "exported").distinct()
    return f.join(files(spark, d).select("file_id", "path"), "file_id").withColumn("ord", F.struct("start_line", "end_line", "id"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """The recorded calls, and one of the name that each of ``_links`` asks for."""
    c = table(spark, d, "call_refs").select("file_id", "repo_id", "call_ord", "callee", "enclosing").dropDuplicates(["file_id", "call_ord"])
    linked = _links(spark, d).select("file_id", "repo_id", (F.col("k") + 1_000_000).cast(dict(c.dtypes)["call_ord"]).alias("call_ord"), F.col("fn").alias("callee"), F.col("fn_id").alias("enclosing"))
    return c.unionByName(linked).join(files(spark, d).select("file_id", "path"), "file_id")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_imports(files(spark, d), imports(spark, d), packages(spark, d), modules(spark, d))


def narrowed(spark: SparkSession, d: str, i: DataFrame | None = None) -> DataFrame:
    # imports and targets are read several times
    i = written(imports(spark, d), "imports") if i is None else i
    targets = R.resolve_imports(files(spark, d), i, packages(spark, d), modules(spark, d))
    return R.narrow(written(targets, "targets"), i, functions(spark, d))


def file_edges(spark: SparkSession, d: str) -> DataFrame:
    n = narrowed(spark, d).select("repo_id", F.col("from_path").alias("src"), F.col("target").alias("dst"))
    return E.collapse(n, ["repo_id", "src", "dst"])


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    f = functions(spark, d)
    i = written(imports(spark, d), "imports")
    origins = R.binding_origins(written(narrowed(spark, d, i), "narrowed"), i)
    return E.collapse(R.resolve_calls(calls(spark, d), R.symbol_index(f), origins), ["repo_id", "src", "dst"])


def churn(spark: SparkSession, d: str) -> DataFrame:
    """Times a path was touched: rows of the load log, in place of a history."""
    p = table(spark, d, "parsed_files").select("repo_id", F.regexp_replace("path", r"^(\./)+", "").alias("path"))
    return p.groupBy("repo_id", "path").agg(F.count("*").alias("churn"))


def file_scores(spark: SparkSession, d: str, iterations: int | None = None) -> DataFrame:
    """Each file with centrality, churn score and importance, scaled within its repository."""
    return scores_of(spark, d, written(file_edges(spark, d), "file-edges"), iterations)


def scores_of(spark: SparkSession, d: str, e: DataFrame, iterations: int | None = None) -> DataFrame:
    ranks = pagerank(files(spark, d), e, "repo_id", "path", "src", "dst", "weight", iterations=iterations)
    with_churn = ranks.join(churn(spark, d), ["repo_id", "path"], "left").fillna(0, ["churn"]).withColumn("log", X.log_count("churn"))
    rows = written(with_churn, "file-ranks")
    ends = rows.groupBy("repo_id").agg(*[f(c).alias(f"{name}_{c}") for c in ("rank", "log") for name, f in (("low", F.min), ("high", F.max))])
    both = rows.join(ends, "repo_id").withColumns({"centrality": X.scaled("rank", "low_rank", "high_rank"), "churn_score": X.scaled("log", "low_log", "high_log")})
    return both.select("repo_id", "path", "centrality", "churn", "churn_score", E.blend("centrality", "churn_score").alias("importance"))


def file_ranks(spark: SparkSession, d: str, iterations: int | None = None) -> DataFrame:
    r = pagerank(files(spark, d), file_edges(spark, d), "repo_id", "path", "src", "dst", "weight", iterations=iterations)
    return r.withColumn("rank", F.round("rank", 7))


def function_ranks(spark: SparkSession, d: str, iterations: int | None = None) -> DataFrame:
    v, e = functions(spark, d).select("repo_id", "id"), written(call_edges(spark, d), "call-edges")
    return pagerank(v, e, "repo_id", "id", "src", "dst", "weight", iterations=iterations).withColumn("rank", F.round("rank", 7))


def importance(spark: SparkSession, d: str, iterations: int | None = None) -> DataFrame:
    return file_scores(spark, d, iterations).select("repo_id", "path", "importance")


def places(scored: DataFrame) -> DataFrame:
    return top_rows(scored.select("repo_id", "path", "importance"), ["repo_id"], [F.desc("importance"), F.asc("path")], 10).select("repo_id", "path", "place", "importance")


SQL_FILES = r"""
f AS (SELECT repo_id, file_id, path, lower(language) AS language, regexp_replace(path, '/?[^/]*$', '') AS folder FROM source_files),
lf AS (SELECT s.repo_id, s.file_id, s.path, s.file_ord, f.folder, n.fn, n.fn_id, CASE WHEN regexp_matches(s.path, '\.pyi?$') THEN 'python' WHEN ends_with(s.path, '.java') THEN 'java' WHEN ends_with(s.path, '.go') THEN 'go' WHEN regexp_matches(s.path, '\.(m?[jt]s|tsx)$') THEN 'esm' END AS kind
       FROM source_files s JOIN f USING (file_id) LEFT JOIN (SELECT file_id, min(fn_name) AS fn, min(id) AS fn_id FROM function_nodes GROUP BY 1) n USING (file_id)),
lk AS (SELECT a.repo_id, a.file_id, a.kind, a.folder, a.fn_id, a.k, t.folder AS to_folder, t.fn, regexp_replace(t.path, '\.[^./]+$', '') AS stem, CASE WHEN a.folder = '' THEN 0 ELSE len(string_split(a.folder, '/')) END AS depth
       FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM lf) a JOIN lf t ON t.repo_id = a.repo_id AND t.kind = a.kind AND t.file_ord = a.file_ord + a.k),
lr AS (SELECT repo_id, file_id, 1000 + k AS imp_ord, CASE kind
         WHEN 'python' THEN CASE WHEN k % 2 = 1 THEN repeat('.', depth + 1) ELSE '' END || replace(stem, '/', '.')
         WHEN 'java' THEN CASE WHEN k % 2 = 0 AND to_folder <> '' THEN replace(to_folder, '/', '.') || '.*' ELSE replace(stem, '/', '.') END
         WHEN 'go' THEN 'git.example/m' || repo_id || CASE WHEN to_folder = '' THEN '' ELSE '/' || to_folder END
         ELSE CASE WHEN k % 3 = 0 THEN '@m' || repo_id || '/' || stem ELSE CASE WHEN depth = 0 THEN './' ELSE repeat('../', depth) END || stem || CASE WHEN k % 3 = 2 THEN '.js' ELSE '' END END END AS specifier, kind,
         CASE WHEN kind IN ('esm', 'python') AND fn IS NOT NULL THEN [{'local_name': fn, 'imported_name': fn}] ELSE [] END AS names,
         CASE WHEN kind IN ('java', 'go') THEN CASE WHEN fn IS NULL THEN [] ELSE [fn] END END AS uses, false AS implicit FROM lk),
allimp AS (SELECT repo_id, file_id, imp_ord, trim(specifier) AS specifier, kind, names, uses, implicit FROM import_refs UNION ALL SELECT * FROM lr),
imp AS (SELECT DISTINCT ON (i.file_id, i.imp_ord) i.repo_id, i.file_id, i.imp_ord, i.specifier, i.kind, i.names, i.uses,
        coalesce(i.implicit, false) AS implicit, f.path AS from_path, f.folder, ends_with(f.path, '_test.go') AS test
        FROM allimp i JOIN f USING (file_id)),
fn AS (SELECT DISTINCT n.id, n.repo_id, n.file_id, n.fn_name, n.qualified_name, n.kind, n.start_line, n.end_line, n.exported, f.path
       FROM function_nodes n JOIN f USING (file_id)),
dirs AS (SELECT repo_id, path, folder, string_split(path, '/') AS parts, string_split(folder, '/') AS dparts FROM f)
"""

SQL_RESOLVED = (
    SQL_FILES
    + r""",
js0 AS (SELECT *, regexp_extract(specifier, '^((\.{1,2}/)*)', 1) AS pre, regexp_replace(specifier, '^(\.{1,2}/)*', '') AS rest
        FROM imp WHERE kind IN ('esm', 'require', 'dynamic') AND starts_with(specifier, '.')),
js1 AS (SELECT *, (length(pre) - length(replace(pre, '../', ''))) // 3 AS ups, CASE WHEN folder = '' THEN [] ELSE string_split(folder, '/') END AS fp FROM js0),
js2 AS (SELECT repo_id, file_id, imp_ord, from_path,
        array_to_string(list_concat(fp[1:len(fp) - ups], list_filter(string_split(rest, '/'), lambda x: x <> '' AND x <> '.')), '/') AS base FROM js1 WHERE ups <= len(fp)
  UNION ALL SELECT i.repo_id, i.file_id, i.imp_ord, i.from_path, specifier[strpos(specifier, '/') + 1:] AS base FROM imp i
        WHERE kind IN ('esm', 'require', 'dynamic') AND starts_with(specifier, '@m' || repo_id || '/') AND EXISTS (FROM f WHERE f.repo_id = i.repo_id AND starts_with(f.path, split_part(i.specifier, '/', 2) || '/'))),
js3 AS (SELECT *, regexp_extract(base, '\.([^./]+)$', 1) AS ext, regexp_replace(base, '\.[^./]+$', '') AS stem FROM js2),
js4 AS (SELECT repo_id, file_id, imp_ord, from_path, list_concat(
          CASE ext WHEN 'js' THEN [stem || '.ts', stem || '.tsx', stem || '.js', stem || '.jsx'] WHEN 'mjs' THEN [stem || '.mts', stem || '.mjs']
               WHEN 'cjs' THEN [stem || '.cts', stem || '.cjs'] ELSE [] END,
          CASE WHEN ext <> '' THEN [base] ELSE [] END,
          list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'], lambda x: base || x),
          list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'], lambda x: CASE WHEN base = '' THEN 'index' ELSE base || '/index' END || x)) AS cand FROM js3),
py0 AS (SELECT *, length(regexp_extract(specifier, '^(\.*)', 1)) AS dots, replace(regexp_replace(specifier, '^\.+', ''), '.', '/') AS rest,
        CASE WHEN folder = '' THEN [] ELSE string_split(folder, '/') END AS fp FROM imp WHERE kind = 'python' AND specifier <> ''),
py1 AS (SELECT *, CASE WHEN dots > 0 THEN [array_to_string(fp[1:len(fp) - (dots - 1)], '/')]
          ELSE list_concat([''], list_transform(range(len(fp), 0, -1), lambda k: array_to_string(fp[1:k], '/'))) END AS roots
        FROM py0 WHERE dots - 1 <= len(fp)),
py2 AS (SELECT repo_id, file_id, imp_ord, from_path, flatten(list_transform(roots, lambda r: list_transform(['.py', '.pyi', '/__init__.py', '/__init__.pyi'],
          lambda x: ltrim(concat_ws('/', CASE WHEN r = '' THEN NULL ELSE r END, CASE WHEN rest = '' THEN NULL ELSE rest END) || x, '/')))) AS cand FROM py1),
cand AS (SELECT repo_id, file_id, imp_ord, from_path, unnest(cand) AS path, generate_subscripts(cand, 1) AS rank FROM (SELECT * FROM js4 UNION ALL SELECT * FROM py2)),
one AS (SELECT c.repo_id, c.file_id, c.imp_ord, c.from_path, arg_min(c.path, c.rank) AS target FROM cand c JOIN f ON f.repo_id = c.repo_id AND f.path = c.path GROUP BY ALL),
jsuf AS (SELECT repo_id, path, array_to_string(parts[i:], '/') AS suffix FROM (SELECT repo_id, path, parts, unnest(range(1, len(parts) + 1)) AS i FROM dirs WHERE ends_with(path, '.java'))),
jdir AS (SELECT repo_id, path, array_to_string(dparts[i:], '/') AS suffix FROM (SELECT repo_id, path, dparts, unnest(range(1, len(dparts) + 1)) AS i FROM dirs WHERE ends_with(path, '.java'))),
jp AS (SELECT *, string_split(specifier, '.') AS sp FROM imp WHERE kind = 'java' AND NOT ends_with(specifier, '*')),
je AS (SELECT repo_id, file_id, imp_ord, from_path, sp, unnest(range(1, len(sp) + 1)) AS e FROM jp),
jh AS (SELECT je.repo_id, je.file_id, je.imp_ord, je.from_path, je.e, s.path AS target FROM je JOIN jsuf s ON s.repo_id = je.repo_id
        AND s.suffix = array_to_string(je.sp[1:je.e], '/') || '.java' WHERE je.e > 1 OR len(je.sp) = 1),
jm AS (SELECT repo_id, file_id, imp_ord, from_path, target FROM jh QUALIFY e = max(e) OVER (PARTITION BY file_id, imp_ord)),
many AS (SELECT * FROM jm
  UNION SELECT i.repo_id, i.file_id, i.imp_ord, i.from_path, f.path FROM imp i JOIN f ON f.repo_id = i.repo_id AND f.folder = i.folder WHERE i.kind = 'java' AND i.specifier = '*'
  UNION SELECT i.repo_id, i.file_id, i.imp_ord, i.from_path, s.path FROM imp i JOIN jdir s ON s.repo_id = i.repo_id AND s.suffix = replace(i.specifier[1:-3], '.', '/') WHERE i.kind = 'java' AND ends_with(i.specifier, '.*')
  UNION SELECT i.repo_id, i.file_id, i.imp_ord, i.from_path, f.path FROM imp i JOIN f ON f.repo_id = i.repo_id AND f.folder = i.folder
        WHERE i.kind = 'go' AND i.specifier = '.' AND ends_with(f.path, '.go') AND (i.test OR NOT ends_with(f.path, '_test.go'))
  UNION SELECT i.repo_id, i.file_id, i.imp_ord, i.from_path, f.path FROM imp i JOIN f ON f.repo_id = i.repo_id AND i.specifier = 'git.example/m' || i.repo_id || CASE WHEN f.folder = '' THEN '' ELSE '/' || f.folder END
        WHERE i.kind = 'go' AND ends_with(f.path, '.go') AND NOT ends_with(f.path, '_test.go')),
res0 AS (SELECT *, 0 AS target_ord FROM one UNION ALL SELECT *, row_number() OVER (PARTITION BY file_id, imp_ord ORDER BY target) - 1 FROM many),
res AS (SELECT * FROM res0 WHERE target <> from_path)
"""
)

SQL_NARROWED = (
    SQL_RESOLVED
    + r""",
nm AS (SELECT DISTINCT repo_id, path, unnest([fn_name, qualified_name]) AS name FROM fn),
ri AS (SELECT r.*, i.kind, i.uses, i.implicit FROM res r JOIN imp i USING (file_id, imp_ord)),
rn AS (SELECT repo_id, file_id, imp_ord, target, unnest(uses) AS name FROM ri WHERE uses IS NOT NULL),
hit AS (SELECT rn.file_id, rn.imp_ord, rn.target, list_sort(list(DISTINCT rn.name)) AS used FROM rn JOIN nm ON nm.repo_id = rn.repo_id AND nm.path = rn.target AND nm.name = rn.name GROUP BY ALL),
ah AS (SELECT DISTINCT file_id, imp_ord, true AS any_hit FROM hit),
nar AS (SELECT ri.repo_id, ri.file_id, ri.imp_ord, ri.from_path, ri.target_ord, ri.target, ri.kind, hit.used FROM ri LEFT JOIN hit USING (file_id, imp_ord, target) LEFT JOIN ah USING (file_id, imp_ord)
        WHERE ri.uses IS NULL OR hit.used IS NOT NULL OR (ah.any_hit IS NULL AND ri.kind = 'go' AND NOT ri.implicit)),
edge AS (SELECT repo_id, from_path AS src, target AS dst, count(*) AS weight FROM nar GROUP BY ALL)
"""
)

SQL_CALLS = (
    SQL_NARROWED
    + r""",
q AS (SELECT repo_id, path, qualified_name AS name, arg_max(id, (start_line, end_line, id)) AS id, 0 AS rank FROM fn GROUP BY ALL),
s AS (SELECT repo_id, path, fn_name AS name, arg_min(id, (start_line, end_line, id)) AS id, 1 AS rank FROM fn GROUP BY ALL),
ix AS (SELECT repo_id, path, name, arg_min(id, rank) AS id FROM (SELECT * FROM q UNION ALL SELECT * FROM s) GROUP BY ALL),
b0 AS (SELECT repo_id, from_path AS path, unnest(used) AS name, target AS origin, imp_ord, 0 AS step, target_ord FROM nar WHERE used IS NOT NULL),
b1 AS (SELECT repo_id, file_id, imp_ord, from_path AS path, arg_min(target, target_ord) AS origin FROM nar GROUP BY ALL),
b2 AS (SELECT b1.repo_id, b1.path, unnest(list_transform(i.names, lambda x: x.local_name)) AS name, b1.origin, b1.imp_ord, 1 AS step, 0 AS target_ord FROM b1 JOIN imp i USING (file_id, imp_ord)),
org AS (SELECT repo_id, path, name, arg_max(origin, (imp_ord, step, target_ord)) AS origin FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b2) GROUP BY ALL),
cl AS (SELECT DISTINCT ON (c.file_id, c.call_ord) c.repo_id, c.callee, c.enclosing, f.path
       FROM (SELECT repo_id, file_id, call_ord, callee, enclosing FROM call_refs UNION ALL SELECT repo_id, file_id, 1000000 + k, fn, fn_id FROM lk) c JOIN f USING (file_id)),
cr AS (SELECT cl.repo_id, cl.enclosing AS src, coalesce(o.id, t.id) AS dst FROM cl LEFT JOIN ix o ON o.repo_id = cl.repo_id AND o.path = cl.path AND o.name = cl.callee
        LEFT JOIN org g ON g.repo_id = cl.repo_id AND g.path = cl.path AND g.name = cl.callee LEFT JOIN ix t ON t.repo_id = g.repo_id AND t.path = g.origin AND t.name = g.name
        WHERE cl.enclosing IS NOT NULL AND cl.callee IS NOT NULL),
cedge AS (SELECT repo_id, src, dst, count(*) AS weight FROM cr WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)
"""
)


def unrolled(k: int, vertices: str, edge: str, stop: bool = False) -> str:
    """PageRank of every repository in SQL, ``k`` steps written out; with ``stop`` a repository keeps its ranks once
    they change by less than a millionth for each of its vertices."""
    sql = f"""
pv AS MATERIALIZED (SELECT DISTINCT repo_id, v FROM {vertices}), pn AS MATERIALIZED (SELECT repo_id, count(*) AS n FROM pv GROUP BY 1),
pe AS MATERIALIZED (SELECT e.repo_id, e.src, e.dst, min(e.weight)::DOUBLE AS w FROM {edge} e JOIN pv a ON a.repo_id = e.repo_id AND a.v = e.src JOIN pv b ON b.repo_id = e.repo_id AND b.v = e.dst WHERE e.src <> e.dst GROUP BY ALL),
po AS MATERIALIZED (SELECT repo_id, src, sum(w) AS o FROM pe GROUP BY ALL), ps AS MATERIALIZED (SELECT pe.repo_id, pe.src, pe.dst, w / o AS s FROM pe JOIN po USING (repo_id, src)),
r0 AS MATERIALIZED (SELECT pv.repo_id, pv.v, pn.n, po.o IS NOT NULL AS sends, 1 / pn.n AS r, false AS done FROM pv JOIN pn USING (repo_id) LEFT JOIN po ON po.repo_id = pv.repo_id AND po.src = pv.v)"""
    kept = "CASE WHEN done THEN r ELSE x END AS r, done OR sum(abs(x - r)) OVER (PARTITION BY repo_id) < n * 1e-6 AS done" if stop else "x AS r, false AS done"
    for i in range(k):
        sql += f""",
r{i + 1} AS MATERIALIZED (SELECT repo_id, v, n, sends, {kept} FROM (SELECT p.repo_id, p.v, p.n, p.sends, p.r, p.done, 0.15 / p.n + 0.85 * (coalesce(g.x, 0) + l.x / p.n) AS x FROM r{i} p
  LEFT JOIN (SELECT ps.repo_id, ps.dst, sum(ps.s * q.r) AS x FROM ps JOIN r{i} q ON q.repo_id = ps.repo_id AND q.v = ps.src GROUP BY ALL) g ON g.repo_id = p.repo_id AND g.dst = p.v
  JOIN (SELECT repo_id, sum(CASE WHEN sends THEN 0 ELSE r END) AS x FROM r{i} GROUP BY ALL) l ON l.repo_id = p.repo_id))"""
    return sql


STEPS = 60  # more than any graph of the tables takes


def _scores(ranks: str, last: str) -> str:
    return (
        SQL_NARROWED
        + ", fv AS (SELECT repo_id, path AS v FROM f),"
        + ranks
        + rf""",
ch AS (SELECT repo_id, regexp_replace(path, '^(\./)+', '') AS path, count(*) AS churn FROM parsed_files GROUP BY ALL),
sc0 AS (SELECT {last}.repo_id, {last}.v AS path, {last}.r, coalesce(ch.churn, 0) AS churn, ln(1 + coalesce(ch.churn, 0)) AS lc FROM {last} LEFT JOIN ch ON ch.repo_id = {last}.repo_id AND ch.path = {last}.v),
bd AS (SELECT repo_id, min(r) AS r0_, max(r) AS r1_, min(lc) AS l0, max(lc) AS l1 FROM sc0 GROUP BY 1),
sc AS (SELECT repo_id, path, churn, CASE WHEN r1_ = r0_ THEN 0.5 ELSE (r - r0_) / (r1_ - r0_) END AS centrality, CASE WHEN l1 = l0 THEN 0.5 ELSE (lc - l0) / (l1 - l0) END AS churn_score FROM sc0 JOIN bd USING (repo_id)),
score AS (SELECT *, floor((0.7 * centrality + 0.3 * churn_score) * 10000 + 0.5) / 10000 AS importance FROM sc)
"""
    )


SQL_SCORES = _scores(unrolled(4, "fv", "edge"), "r4")
SQL_CONVERGED = _scores(unrolled(STEPS, "fv", "edge", stop=True), f"r{STEPS}")

# -- queries


@query("WITH " + SQL_RESOLVED + "SELECT repo_id, file_id, imp_ord, target_ord, target FROM res")
def import_targets(spark, d):
    return resolved(spark, d).select("repo_id", "file_id", "imp_ord", F.col("target_ord").cast("long").alias("target_ord"), "target")


@query("WITH " + SQL_RESOLVED + "SELECT i.repo_id, i.kind, count(*) AS n FROM imp i ANTI JOIN res USING (file_id, imp_ord) WHERE NOT i.implicit GROUP BY ALL")
def external_imports(spark, d):
    return R.external_imports(imports(spark, d), resolved(spark, d)).groupBy("repo_id", "kind").agg(F.count("*").alias("n"))


@query("WITH " + SQL_NARROWED + "SELECT file_id, imp_ord, target, array_to_string(used, ',') AS used FROM nar")
def package_narrowing(spark, d):
    return narrowed(spark, d).select("file_id", "imp_ord", "target", F.array_join("used", ",").alias("used"))


@query("WITH " + SQL_NARROWED + "SELECT * FROM edge")
def import_edges(spark, d):
    return file_edges(spark, d)


@query("WITH " + SQL_NARROWED + """, dg AS (SELECT repo_id, v, sum(o) AS od, sum(i) AS id_ FROM (SELECT repo_id, src AS v, 1 AS o, 0 AS i FROM edge UNION ALL SELECT repo_id, dst, 0, 1 FROM edge) GROUP BY ALL)
SELECT f.repo_id, f.path, coalesce(od, 0)::BIGINT AS out_degree, coalesce(id_, 0)::BIGINT AS in_degree FROM f LEFT JOIN dg ON dg.repo_id = f.repo_id AND dg.v = f.path""")
def file_degrees(spark, d):
    return E.degrees(files(spark, d).select("repo_id", "path"), file_edges(spark, d), ["repo_id"], "path", "src", "dst")


@query("WITH " + SQL_CALLS + "SELECT repo_id, path, name, id FROM ix")
def symbol_lookup(spark, d):
    return R.symbol_index(functions(spark, d))


@query("WITH " + SQL_CALLS + "SELECT repo_id, path, name, origin FROM org")
def binding_origins(spark, d):
    return R.binding_origins(narrowed(spark, d), imports(spark, d))


@query("WITH " + SQL_CALLS + "SELECT * FROM cedge")
def call_graph(spark, d):
    return call_edges(spark, d)


@query("WITH " + SQL_CALLS + "SELECT repo_id, dst AS id, sum(weight)::BIGINT AS calls FROM cedge GROUP BY ALL")
def call_counts(spark, d):
    return E.incoming_weight(call_edges(spark, d), ["repo_id"], "dst", "weight", "calls").withColumnRenamed("dst", "id")


@query("WITH " + SQL_NARROWED + ", fv AS (SELECT repo_id, path AS v FROM f)," + unrolled(4, "fv", "edge") + " SELECT repo_id, v AS path, round(r, 7) AS rank FROM r4")
def pagerank_files_four_steps(spark, d):
    return file_ranks(spark, d, iterations=4)


@query("WITH " + SQL_NARROWED + ", fv AS (SELECT repo_id, path AS v FROM f)," + unrolled(STEPS, "fv", "edge", stop=True) + f" SELECT repo_id, v AS path, round(r, 7) AS rank FROM r{STEPS}")
def pagerank_files(spark, d):
    """Ranks of files in their repository's import graph, until each has converged."""
    return file_ranks(spark, d)


@query("WITH " + SQL_CALLS + ", fv AS (SELECT repo_id, id AS v FROM fn)," + unrolled(3, "fv", "cedge") + " SELECT repo_id, v AS id, round(r, 7) AS rank FROM r3")
def pagerank_functions_three_steps(spark, d):
    return function_ranks(spark, d, iterations=3)


@query("WITH " + SQL_CALLS + ", fv AS (SELECT repo_id, id AS v FROM fn)," + unrolled(STEPS, "fv", "cedge", stop=True) + f" SELECT repo_id, v AS id, round(r, 7) AS rank FROM r{STEPS}")
def pagerank_functions(spark, d):
    """Ranks of declarations in their repository's call graph, until each has converged."""
    return function_ranks(spark, d)


@query("WITH " + SQL_CALLS + ", fv AS (SELECT repo_id, id AS v FROM fn)," + unrolled(STEPS, "fv", "cedge", stop=True) + f""", fb AS (SELECT repo_id, min(r) AS lo, max(r) AS hi FROM r{STEPS} GROUP BY 1), fs AS (SELECT r.repo_id, r.v AS id, round(CASE WHEN hi = lo THEN 0.5 ELSE (r.r - lo) / (hi - lo) END, 6) AS importance FROM r{STEPS} r JOIN fb USING (repo_id))
SELECT repo_id, id, importance, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY importance DESC, id) AS place FROM fs) WHERE place <= 20""")
def ranked_functions(spark, d):
    """The twenty most important declarations of each repository: scaled ranks in the call graph."""
    v, e = functions(spark, d).select("repo_id", "id"), written(call_edges(spark, d), "call-edges")
    ranks = written(pagerank(v, e, "repo_id", "id", "src", "dst", "weight"), "function-ranks")
    scaled = E.min_max(ranks, ["repo_id"], "rank", "importance").select("repo_id", "id", F.round("importance", 6).alias("importance"))
    return top_rows(scaled, ["repo_id"], [F.desc("importance"), F.asc("id")], 20).select("repo_id", "id", "importance", "place")


@query("WITH " + SQL_SCORES + "SELECT repo_id, path, churn, round(churn_score, 6) AS churn_score FROM score")
def churn_scores(spark, d):
    rows = files(spark, d).select("repo_id", "path").join(churn(spark, d), ["repo_id", "path"], "left").fillna(0, ["churn"])
    return E.log_scores(rows, ["repo_id"], "churn", "churn_score").withColumn("churn_score", F.round("churn_score", 6))


@query("WITH " + SQL_SCORES + "SELECT repo_id, path, importance FROM score")
def file_importance_four_steps(spark, d):
    return importance(spark, d, iterations=4)


@query("WITH " + SQL_CONVERGED + "SELECT repo_id, path, importance FROM score")
def file_importance(spark, d):
    """Importance of each file, from ranks that have converged."""
    return importance(spark, d)


@query("WITH " + SQL_SCORES + """SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY importance DESC, path) AS place, importance
FROM score QUALIFY place <= 10""")
def analyze_rank_files_four_steps(spark, d):
    """The flagship's list from four steps of PageRank, which SQL can check."""
    return places(importance(spark, d, iterations=4))


@query("WITH " + SQL_CONVERGED + """SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY importance DESC, path) AS place, importance
FROM score QUALIFY place <= 10""")
def analyze_rank_files(spark, d):
    """The flagship: resolve, collapse, rank until every repository has converged, blend and list each
    repository's ten most important files."""
    return places(importance(spark, d))


@query("WITH " + SQL_CONVERGED + "SELECT repo_id, path, round(centrality, 6) AS centrality, churn, round(churn_score, 6) AS churn_score, importance FROM score")
def analyze_converged(spark, d):
    """The parts of every file's importance."""
    return file_scores(spark, d).select("repo_id", "path", F.round("centrality", 6).alias("centrality"), "churn", F.round("churn_score", 6).alias("churn_score"), "importance")


@query("WITH " + SQL_NARROWED + """, e AS (SELECT repo_id, count(*) AS n FROM edge GROUP BY 1), ff AS (SELECT repo_id, count(*) AS n FROM fn GROUP BY 1), x AS (SELECT i.repo_id, count(*) AS n FROM imp i ANTI JOIN res USING (file_id, imp_ord) WHERE NOT i.implicit GROUP BY 1)
SELECT f.repo_id, count(*) AS files, coalesce(any_value(e.n), 0) AS edges, coalesce(any_value(ff.n), 0) AS functions, coalesce(any_value(x.n), 0) AS external_imports
FROM f LEFT JOIN e USING (repo_id) LEFT JOIN ff USING (repo_id) LEFT JOIN x USING (repo_id) GROUP BY 1""")
def repo_stats(spark, d):
    n = lambda df, name: df.groupBy("repo_id").agg(F.count("*").alias(name))
    r, i, f = written(resolved(spark, d), "targets"), imports(spark, d), functions(spark, d)
    out = n(files(spark, d), "files")
    for df, name in ((E.collapse(R.narrow(r, i, f).select("repo_id", F.col("from_path").alias("src"), F.col("target").alias("dst")), ["repo_id", "src", "dst"]), "edges"), (f, "functions"), (R.external_imports(i, r), "external_imports")):
        out = out.join(n(df, name), "repo_id", "left")
    return out.fillna(0)


@query("SELECT repo_id, coalesce(lower(language), 'none') AS language, count(*) AS n FROM source_files GROUP BY ALL")
def language_histogram(spark, d):
    return files(spark, d).groupBy("repo_id", F.coalesce(F.lower("language"), F.lit("none")).alias("language")).agg(F.count("*").alias("n"))


@query("WITH " + SQL_CALLS + """, cc AS (SELECT repo_id, dst AS id, sum(weight)::BIGINT AS calls FROM cedge GROUP BY ALL)
SELECT repo_id, path, id, qualified_name, calls, place FROM (SELECT fn.repo_id, fn.path, fn.id, fn.qualified_name, coalesce(cc.calls, 0)::BIGINT AS calls,
  row_number() OVER (PARTITION BY fn.repo_id, fn.path ORDER BY coalesce(cc.calls, 0) DESC, coalesce(fi.importance, -1) DESC, fn.qualified_name, fn.start_line, fn.end_line, fn.kind, fn.exported) AS place
  FROM fn LEFT JOIN cc ON cc.repo_id = fn.repo_id AND cc.id = fn.id LEFT JOIN (SELECT repo_id, id, max(importance) AS importance FROM function_nodes GROUP BY ALL) fi ON fi.repo_id = fn.repo_id AND fi.id = fn.id) WHERE place <= 3""")
def top_functions(spark, d):
    """The three most called declarations of each file; of equal ones the more important."""
    counts = E.incoming_weight(call_edges(spark, d), ["repo_id"], "dst", "weight", "calls").withColumnRenamed("dst", "id")
    weights = table(spark, d, "function_nodes").groupBy("repo_id", "id").agg(F.coalesce(F.max("importance"), F.lit(-1.0)).alias("importance"))
    both = functions(spark, d).join(counts, ["repo_id", "id"], "left").fillna(0, ["calls"]).join(weights, ["repo_id", "id"])
    w = Window.partitionBy("repo_id", "path").orderBy(F.desc("calls"), F.desc("importance"), "qualified_name", "start_line", "end_line", "kind", "exported")
    return both.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("repo_id", "path", "id", "qualified_name", "calls", "place")


@query("WITH " + SQL_CALLS + """, nq AS (SELECT repo_id, id, min(qualified_name) AS qn FROM fn GROUP BY ALL)
SELECT e.repo_id, e.src AS id, string_agg(nq.qn, ', ' ORDER BY nq.qn, e.dst) AS calls FROM cedge e JOIN nq ON nq.repo_id = e.repo_id AND nq.id = e.dst GROUP BY ALL""")
def outgoing_calls(spark, d):
    """The names that each declaration calls, in order."""
    names = functions(spark, d).groupBy("repo_id", F.col("id").alias("dst")).agg(F.min("qualified_name").alias("qn"))
    both = call_edges(spark, d).join(names, ["repo_id", "dst"])
    return both.groupBy("repo_id", F.col("src").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("qn", "dst"))), lambda x: x.qn), ", ").alias("calls"))
