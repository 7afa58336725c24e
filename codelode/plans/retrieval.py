"""Queries over chunks, vectors, hits and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import exprs as X
from codelode.operators import answers as A
from codelode.operators import chunks as C
from codelode.operators import edges as E
from codelode.operators import vectors as V
from codelode.plans.catalogue import query
from codelode.plans.graph import SQL_CALLS, SQL_CONVERGED, files, functions, narrowed, scores_of
from codelode.session import table, written

DIM, K = 96, 8


def chunks(spark, d, *columns: str) -> DataFrame:
    """Chunks once each (the latest row), with the kind that their id tells. Only the named columns are
    read and shuffled."""
    c = table(spark, d, "chunks")
    kind = F.when(F.col("id").startswith("file:"), "file").when(F.col("id").startswith("fn:"), "function").otherwise(F.lower(F.trim("kind")))
    picked = c.groupBy("chunk_no").agg(F.max_by(F.struct(*[kind.alias("kind") if x == "kind" else F.col(x) for x in columns]), F.coalesce("indexed_at", F.timestamp_seconds(F.lit(0)))).alias("c"))
    return picked.select("chunk_no", "c.*")


SQL_CHUNKS = """
ch AS (SELECT * REPLACE (CASE WHEN id LIKE 'file:%' THEN 'file' WHEN id LIKE 'fn:%' THEN 'function' ELSE lower(trim(kind)) END AS kind)
       FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_no ORDER BY indexed_at DESC NULLS LAST) = 1),
us AS (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM ch
       WHERE embedding IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
sc AS (SELECT q.chunk_no AS query, u.chunk_no, u.kind, u.model, coalesce(u.importance, 0) AS importance, list_dot_product(q.embedding::DOUBLE[], u.embedding::DOUBLE[]) / (q.nrm * u.nrm) AS score
       FROM us q JOIN us u ON q.model = u.model AND q.chunk_no <> u.chunk_no WHERE q.chunk_no % 100 = 0)
"""


def _scored(spark, d) -> DataFrame:
    c = written(chunks(spark, d, "model", "kind", "importance", "embedding"), "search-chunks")  # read several times
    hits = V.search(c, c.where("chunk_no % 100 = 0"), "chunk_no", "embedding", ["model"], "kind", K, DIM)
    weight = c.select("chunk_no", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return hits.join(weight, "chunk_no")


def _best() -> list:
    return [F.desc(F.round("score", 9)), F.desc("importance"), F.asc("chunk_no")]


@query("WITH " + SQL_CHUNKS + """SELECT query, chunk_no, kind, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, importance DESC, chunk_no) AS place FROM sc) WHERE place <= 8""")
def vector_topk(spark, d):
    """The 8 best chunks for every hundredth chunk as a question, ties by importance."""
    return V.rank(_scored(spark, d), _best(), K).select("query", "chunk_no", "kind", F.round("score", 5).alias("score"), "place")


@query("WITH " + SQL_CHUNKS + """, a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query, kind ORDER BY round(score, 9) DESC, importance DESC, chunk_no) <= 4 THEN 1 ELSE 0 END AS quota FROM sc),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query ORDER BY quota DESC, round(score, 9) DESC, importance DESC, chunk_no) <= 8)
SELECT query, chunk_no, kind, round(score, 5) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, importance DESC, chunk_no) AS place FROM b""")
def vector_topk_balanced(spark, d):
    """The same with half of the places for each kind."""
    return V.balance(_scored(spark, d), "kind", _best(), K).select("query", "chunk_no", "kind", F.round("score", 5).alias("score"), "place")


@query("WITH " + SQL_CHUNKS + "SELECT chunk_no, round(nrm, 4) AS length, round(embedding[1]::DOUBLE / nrm, 5) AS first FROM us")
def vector_normalize(spark, d):
    c = chunks(spark, d, "embedding").where(V.usable("embedding", DIM))
    return c.select("chunk_no", F.round(V.norm("embedding"), 4).alias("length"), F.round(F.get(V.unit("embedding"), F.lit(0)).cast("double"), 5).alias("first"))


@query("WITH " + SQL_CHUNKS + "SELECT ch.model, count(*) AS chunks, count(ch.embedding) AS with_vector, (SELECT count(*) FROM us WHERE us.model = ch.model) AS usable, min(len(ch.embedding)) AS least_dim, max(len(ch.embedding)) AS most_dim FROM ch GROUP BY ch.model")
def index_report(spark, d):
    """What a model's index holds, and whether its vectors have one length."""
    c = chunks(spark, d, "model", "embedding")
    n = F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long")
    return c.groupBy("model").agg(F.count("*").alias("chunks"), F.count("embedding").alias("with_vector"), F.count_if(V.usable("embedding", DIM)).alias("usable"), F.min(n).alias("least_dim"), F.max(n).alias("most_dim"))


@query("WITH " + SQL_CHUNKS + "SELECT chunk_no, sha256(text) AS text_hash, sha256(text) = hash AS same FROM ch")
def chunk_hash(spark, d):
    h = C.text_hash("text")
    return chunks(spark, d, "text", "hash").select("chunk_no", h.alias("text_hash"), (h == F.col("hash")).alias("same"))


@query("WITH " + SQL_CHUNKS + """, new AS (SELECT repo_id, id, model, CASE WHEN chunk_no % 7 = 0 THEN text || ' (edited)' ELSE text END AS text FROM ch),
old AS (SELECT DISTINCT repo_id, id, model, sha256(text) AS hash FROM ch WHERE embedding IS NOT NULL)
SELECT new.model, count(*) AS total, count(old.hash) AS reused, count(*) - count(old.hash) AS embedded FROM new LEFT JOIN old ON old.repo_id = new.repo_id AND old.id = new.id AND old.model = new.model AND old.hash = sha256(new.text) GROUP BY 1""")
def incremental_reuse(spark, d):
    """Every seventh chunk edited: which vectors of the stored index still hold?"""
    c = chunks(spark, d, "repo_id", "id", "model", "text", "embedding")
    text = F.when(F.col("chunk_no") % 7 == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))
    new = c.select("repo_id", "id", "model", C.text_hash(text).alias("hash"))
    stored = c.where("embedding IS NOT NULL").select("repo_id", "id", "model", C.text_hash("text").alias("hash"), "embedding")
    return C.reuse(new, stored, ["repo_id", "id", "model"]).groupBy("model").agg(F.count("*").alias("total"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("embedded"))


@query(r"""WITH n AS (SELECT DISTINCT id, file_id, fn_name, kind, start_line, end_line, exported, greatest(start_line, 1) AS s FROM function_nodes),
l AS (SELECT n.*, string_split(f.content, chr(10)) AS ls FROM n JOIN source_files f USING (file_id)),
o AS (SELECT *, ls[s] AS own, ls[s:greatest(end_line, s)] AS span FROM l),
t AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN regexp_matches(own, '^\s*(@[\w.]+(\([^)]*\))?\s*)+$') THEN coalesce(list_filter(span, lambda x: NOT regexp_matches(x, '^\s*(@[\w.]+(\([^)]*\))?\s*)+$'))[1], span[-1]) ELSE own END, '^\s+', ''), '\s+$', '') AS line FROM o),
u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\s*\{\s*$', ''), '\s*:\s*$', ''), '^\s+', ''), '\s+$', '') AS sig FROM t)
SELECT file_id, id, start_line, end_line, kind, exported, CASE WHEN start_line >= 1 AND sig IS NOT NULL THEN CASE WHEN length(sig) > 120 THEN sig[1:117] || '...' ELSE sig END ELSE fn_name END AS signature FROM u""")
def signatures(spark, d):
    f = table(spark, d, "function_nodes").select("id", "file_id", "fn_name", "kind", "start_line", "end_line", "exported").distinct()
    both = f.join(table(spark, d, "source_files").select("file_id", "content"), "file_id")
    return both.select("file_id", "id", "start_line", "end_line", "kind", "exported", C.signature("content", "start_line", "fn_name", "end_line").alias("signature"))


@query(r"""WITH p AS (SELECT * FROM parsed_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST) = 1),
fn AS (SELECT DISTINCT id, repo_id, file_id, fn_name, qualified_name, kind, start_line, end_line, exported FROM function_nodes),
dc AS (SELECT file_id, string_agg('- ' || kind || ' ' || qualified_name || CASE WHEN exported THEN ' (exported)' ELSE '' END, chr(10) ORDER BY start_line, end_line, id, kind, exported) AS declares FROM fn GROUP BY 1)
SELECT s.file_id, sha256('File: ' || s.path || chr(10) || 'Language: ' || coalesce(lower(s.language), 'none') || chr(10) || chr(10) || 'Lines: ' || coalesce(p.loc, 0) || chr(10) || chr(10) || coalesce('Declares:' || chr(10) || dc.declares, 'This file declares nothing at its top level.')) AS hash
FROM source_files s LEFT JOIN p USING (file_id) LEFT JOIN dc USING (file_id)""")
def chunk_texts(spark, d):
    """Hashes of the files' chunk texts, built from the parsed tables."""
    p = table(spark, d, "parsed_files").groupBy("file_id").agg(F.max_by("loc", F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)))).alias("loc"))
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.col("qualified_name"), F.when(F.col("exported"), " (exported)").otherwise(""))
    fn = table(spark, d, "function_nodes").select("id", "file_id", "qualified_name", "kind", "start_line", "end_line", "exported").distinct()
    dc = fn.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "id", "kind", "exported", line.alias("line")))), lambda x: x.line).alias("declares"))
    both = table(spark, d, "source_files").select("file_id", "path", "language").join(p, "file_id", "left").join(dc, "file_id", "left")
    listed = F.coalesce(F.concat(F.lit("Declares:\n"), F.array_join("declares", "\n")), F.lit("This file declares nothing at its top level."))
    text = F.concat_ws("\n", F.concat(F.lit("File: "), "path"), F.concat(F.lit("Language: "), F.coalesce(F.lower("language"), F.lit("none"))), F.lit(""), F.concat(F.lit("Lines: "), F.coalesce("loc", F.lit(0))), F.lit(""), listed)
    return both.select("file_id", C.text_hash(text).alias("hash"))


SQL_FILE_TEXT = ", dg AS (SELECT repo_id, v AS path, sum(o) AS od, sum(i) AS id_ FROM (SELECT repo_id, src AS v, 1 AS o, 0 AS i FROM edge UNION ALL SELECT repo_id, dst, 0, 1 FROM edge) GROUP BY ALL)," + r"""
pl AS (SELECT file_id, max(loc) AS loc FROM parsed_files GROUP BY 1), dcl AS (SELECT file_id, string_agg('- ' || kind || ' ' || qualified_name, chr(10) ORDER BY start_line, end_line, id, kind) AS declares FROM fn GROUP BY 1),
x AS (SELECT s.file_id, f.path, f.language, s.repo_id, score.importance, coalesce(dg.id_, 0) AS ind, coalesce(dg.od, 0) AS outd, score.churn, coalesce(pl.loc, 0) AS loc, dcl.declares
  FROM source_files s JOIN f USING (file_id) JOIN score ON score.repo_id = s.repo_id AND score.path = s.path LEFT JOIN dg ON dg.repo_id = s.repo_id AND dg.path = s.path LEFT JOIN pl USING (file_id) LEFT JOIN dcl USING (file_id))"""
EXACT3 = "CASE WHEN importance IN (0.0625, 0.3125, 0.5625, 0.8125) THEN printf('%.3f', importance + 0.0004) ELSE printf('%.3f', importance) END"  # halves that are exact in binary go up


def _file_facts(spark, d) -> DataFrame:
    """Each file with its metrics and a line for each declaration."""
    n = narrowed(spark, d).select("repo_id", F.col("from_path").alias("src"), F.col("target").alias("dst"))
    edges = written(E.collapse(n, ["repo_id", "src", "dst"]), "file-edges")
    scores = scores_of(spark, d, edges).select("repo_id", "path", "importance", "churn")
    deg = E.degrees(files(spark, d).select("repo_id", "path"), edges, ["repo_id"], "path", "src", "dst")
    loc = table(spark, d, "parsed_files").groupBy("file_id").agg(F.max("loc").alias("loc"))
    fn = table(spark, d, "function_nodes").select("id", "file_id", "qualified_name", "kind", "start_line", "end_line", "exported").distinct()
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.col("qualified_name"))
    dc = fn.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "id", "kind", line.alias("line")))), lambda x: x.line).alias("declares"))
    both = files(spark, d).withColumn("language", F.lower("language")).join(scores, ["repo_id", "path"]).join(deg, ["repo_id", "path"]).join(loc, "file_id", "left").join(dc, "file_id", "left")
    return both.fillna(0, ["loc"])


@query("WITH " + SQL_CONVERGED + SQL_FILE_TEXT + " SELECT file_id, sha256(path || ' (' || coalesce(language, 'unknown') || ')' || chr(10) || 'importance ' || " + EXACT3 + """ || '; importers ' || ind || '; imports ' || outd || '; commits ' || churn || '; lines ' || loc || chr(10) ||
 coalesce('Declares:' || chr(10) || declares, 'No declarations.')) AS hash FROM x""")
def file_chunk_texts(spark, d):
    """Hashes of the files' chunk texts with their place in the graph."""
    rows = _file_facts(spark, d)
    text = C.file_text("path", "language", "importance", "in_degree", "out_degree", "churn", "loc", "declares")
    return rows.select("file_id", C.text_hash(text).alias("hash"))


@query("WITH " + SQL_CONVERGED + SQL_FILE_TEXT + """, c AS (SELECT repo_id, id, any_value(model) AS m FROM chunks GROUP BY ALL) SELECT x.repo_id, count(*) AS files, count(*) FILTER (c.id IS NOT NULL) AS known, count(*) FILTER (c.id IS NULL) AS added FROM x LEFT JOIN c ON c.repo_id = x.repo_id AND c.id = 'file:' || x.path GROUP BY 1""")
def index_plan(spark, d):
    """Of each repository's file chunks, how many an index holds by id, and how many a build would add."""
    have = table(spark, d, "chunks").where("id IS NOT NULL").select("repo_id", "id").distinct().withColumn("known", F.lit(1))
    mine = _file_facts(spark, d).select("repo_id", F.concat(F.lit("file:"), "path").alias("id"))
    both = mine.join(have, ["repo_id", "id"], "left")
    return both.groupBy("repo_id").agg(F.count("*").alias("files"), F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("added"))


def hits(spark, d) -> DataFrame:
    h = table(spark, d, "search_hits").where("score IS NOT NULL")
    return h.groupBy("question_id", "hit_rank").agg(F.max_by(F.struct("question", "chunk_no", "path", "ref", "start_line", "score"), F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))), F.col("chunk_no"))).alias("h")).select("question_id", "hit_rank", "h.*")


SQL_HITS = "h AS (SELECT * FROM search_hits WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id, hit_rank ORDER BY coalesce(loaded_at, to_timestamp(0)) DESC, chunk_no DESC) = 1)"


@query("WITH " + SQL_HITS + "SELECT question_id, hit_rank, chunk_no, path, floor(score * 10000 + 0.5) / 10000 AS score FROM h")
def hit_sources(spark, d):
    return hits(spark, d).select("question_id", "hit_rank", "chunk_no", "path", X.round4("score").alias("score"))


@query("WITH " + SQL_HITS + """SELECT question_id, sha256('Answer from the numbered excerpts below and cite them as [n]. Say so if they don''t hold the answer.' || chr(10) || chr(10)
 || string_agg('[' || hit_rank || '] ' || path || coalesce('#' || ref, '') || ' (relevance ' || printf('%.3f', score) || ')', chr(10) ORDER BY hit_rank) || chr(10) || chr(10) || 'Question: ' || any_value(question)) AS prompt_hash, count(*) AS sources FROM h GROUP BY 1""")
def answer_prompts(spark, d):
    """The prompt for each question with its numbered sources (hashed)."""
    h = hits(spark, d)
    block = F.concat(F.lit("["), F.col("hit_rank"), F.lit("] "), F.col("path"), F.coalesce(F.concat(F.lit("#"), F.col("ref")), F.lit("")), F.lit(" (relevance "), X.fixed3(F.col("score")), F.lit(")"))
    by = h.withColumn("block", block).groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hit_rank", "block"))), lambda x: x.block), "\n").alias("blocks"), F.any_value("question").alias("question"), F.count("*").alias("sources"))
    return by.select("question_id", F.sha2(C.answer_prompt("blocks", "question"), 256).alias("prompt_hash"), "sources")


@query("""WITH w AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' ELSE 'Sure. ' || props || ' Done.' END AS reply, props FROM events)
SELECT event_id, props AS json FROM w WHERE props IS NOT NULL""")
def parse_json_loose(spark, d):
    """Objects recovered from replies that wrap them in prose or fences."""
    e = table(spark, d, "events").where("props IS NOT NULL")
    reply = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Sure. "), "props", F.lit(" Done.")))
    return e.withColumn("reply", reply).select("event_id", C.loose_json("reply").alias("json"))


@query("""WITH n AS (SELECT DISTINCT repo_id, file_id, lower(fn_name) AS simple, lower(qualified_name) AS qualified FROM function_nodes),
c AS (SELECT DISTINCT chunk_no, repo_id, file_id, trim(ref) AS name FROM chunks WHERE ref IS NOT NULL)
SELECT chunk_no, name FROM c SEMI JOIN n ON n.repo_id = c.repo_id AND n.file_id = c.file_id AND (n.simple = lower(c.name) OR n.qualified = lower(c.name))""")
def summary_name_filter(spark, d):
    """Names given for a file's declarations that the file does declare, in any letter case."""
    n = table(spark, d, "function_nodes").select("repo_id", "file_id", F.explode(F.array(F.lower("fn_name"), F.lower("qualified_name"))).alias("key")).distinct()
    c = table(spark, d, "chunks").where("ref IS NOT NULL").select("chunk_no", "repo_id", "file_id", F.trim("ref").alias("name")).distinct()
    return c.withColumn("key", F.lower("name")).join(n, ["repo_id", "file_id", "key"], "left_semi").select("chunk_no", "name")


@query("SELECT doc_id, " + ", ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)})::BIGINT AS n_{w}" for w in ("registry", "helper", "python", "import", "boot")) + " FROM documents WHERE text IS NOT NULL")
def bag_of_words(spark, d):
    """The offline embedder of the tests: occurrences of a few words."""
    t = F.lower("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *[F.floor((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("long").alias(f"n_{w}") for w in ("registry", "helper", "python", "import", "boot")])


@query("WITH " + SQL_CALLS + """, oc AS (SELECT e.repo_id, e.src AS id, string_agg(nq.qn, ', ' ORDER BY nq.qn, e.dst) AS calls FROM cedge e JOIN (SELECT repo_id, id, min(qualified_name) AS qn FROM fn GROUP BY ALL) nq ON nq.repo_id = e.repo_id AND nq.id = e.dst GROUP BY ALL)
SELECT fn.repo_id, fn.file_id, fn.id, fn.start_line, fn.end_line, fn.kind, fn.exported, sha256('Function: ' || fn.qualified_name || chr(10) || 'In file: ' || fn.path || ' (line ' || fn.start_line || ')' || chr(10) || 'Kind: ' || fn.kind || CASE WHEN fn.exported THEN ', exported' ELSE '' END
  || chr(10) || 'Signature: ' || fn.kind || ' ' || fn.qualified_name || chr(10) || chr(10) || coalesce('Calls: ' || oc.calls, 'It calls nothing in this repository.')) AS hash
FROM fn LEFT JOIN oc ON oc.repo_id = fn.repo_id AND oc.id = fn.id""")
def function_chunk_texts(spark, d):
    from codelode.plans.graph import outgoing_calls

    f = functions(spark, d).join(outgoing_calls(spark, d), ["repo_id", "id"], "left").withColumn("signature", F.concat_ws(" ", "kind", "qualified_name"))
    return f.select("repo_id", "file_id", "id", "start_line", "end_line", "kind", "exported", C.text_hash(C.function_text("qualified_name", "path", "start_line", "kind", "exported", "signature", "calls")).alias("hash"))


@query(r"""WITH p AS (SELECT * FROM parsed_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST) = 1),
fn AS (SELECT DISTINCT id, file_id, qualified_name, kind, start_line, end_line, exported FROM function_nodes),
dc AS (SELECT file_id, string_agg('- ' || kind || ' ' || qualified_name, chr(10) ORDER BY start_line, end_line, id, kind, exported) AS declares FROM fn GROUP BY 1)
SELECT s.file_id, sha256('Summarise the file ' || s.path || ' (' || coalesce(s.language, 'unknown') || ', ' || coalesce(p.loc, 0) || ' lines).' || chr(10) || 'Declarations:' || chr(10) || coalesce(dc.declares, '(no declarations)') || chr(10)
 || CASE WHEN length(s.content) > 6000 THEN 'Source (first 6000 of ' || length(s.content) || ' characters):' ELSE 'Source:' END || chr(10) || s.content[1:6000] || chr(10)
 || 'Reply with JSON: {"summary": "...", "functions": [{"name": "...", "summary": "..."}]}') AS prompt_hash FROM source_files s LEFT JOIN p USING (file_id) LEFT JOIN dc USING (file_id) WHERE s.content IS NOT NULL""")
def file_prompts(spark, d):
    """The prompt for each file's summary (hashed)."""
    p = table(spark, d, "parsed_files").groupBy("file_id").agg(F.max_by("loc", F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)))).alias("loc"))
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.col("qualified_name"))
    fn = table(spark, d, "function_nodes").select("id", "file_id", "qualified_name", "kind", "start_line", "end_line", "exported").distinct()
    dc = fn.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "id", "kind", "exported", line.alias("line")))), lambda x: x.line).alias("declares"))
    both = table(spark, d, "source_files").where("content IS NOT NULL").select("file_id", "path", "language", "content").join(p, "file_id", "left").join(dc, "file_id", "left")
    return both.select("file_id", F.sha2(A.file_prompt("path", "language", "loc", "declares", "content"), 256).alias("prompt_hash"))


@query("""WITH h AS (SELECT file_id, path, sha256(path || chr(0) || content) AS hash FROM source_files WHERE content IS NOT NULL), c AS (SELECT DISTINCT hash FROM h WHERE file_id % 3 = 0)
SELECT h.file_id, CASE WHEN c.hash IS NOT NULL THEN 'cache' ELSE 'model' END AS source FROM h LEFT JOIN c USING (hash)""")
def summary_cache_lookup(spark, d):
    """Which files a cache that holds every third one's summary would spare the model."""
    h = table(spark, d, "source_files").where("content IS NOT NULL").select("file_id", A.content_hash("path", "content").alias("hash"))
    cached = h.where("file_id % 3 = 0").select("hash").distinct().withColumn("held", F.lit(True))
    return h.join(cached, "hash", "left").select("file_id", F.when(F.col("held"), "cache").otherwise("model").alias("source"))
