"""Queries of the explorer: folders, clusters, frames, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import exprs as X
from codelode.operators import edges as E
from codelode.operators import explore as O
from codelode.operators import vectors as V
from codelode.plans.catalogue import query
from codelode.plans.graph import SQL_CALLS, call_edges, files, functions
from codelode.session import table

SQL_ONE = """c0 AS (SELECT repo_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder FROM source_files), clu AS (SELECT repo_id, path, split_part(folder, '/', 1) AS cluster FROM c0)"""


def one_level(spark, d) -> DataFrame:
    """Clusters by the first path segment: the plan where no group needs a second split."""
    return files(spark, d).select("repo_id", "path", F.substring_index(X.dirname("path"), "/", 1).alias("cluster"))


@query()
def folder_clusters(spark, d):
    return O.folder_clusters(files(spark, d))


@query("SELECT DISTINCT repo_id, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder FROM source_files")
def directory_distinct(spark, d):
    f = X.dirname("path")
    return files(spark, d).select("repo_id", F.when(f == "", ".").otherwise(f).alias("folder")).distinct()


@query("WITH " + SQL_CALLS + "," + SQL_ONE + """, pe AS (SELECT DISTINCT e.repo_id, split_part(e.src, '#', 1) AS src, split_part(e.dst, '#', 1) AS dst FROM cedge e)
SELECT pe.repo_id, a.cluster AS src_cluster, b.cluster AS dst_cluster, count(*) AS weight FROM pe JOIN clu a ON a.repo_id = pe.repo_id AND a.path = pe.src JOIN clu b ON b.repo_id = pe.repo_id AND b.path = pe.dst WHERE a.cluster <> b.cluster GROUP BY ALL""")
def cluster_edges(spark, d):
    """Calls between files, counted between top folders."""
    e = call_edges(spark, d).select("repo_id", F.substring_index("src", "#", 1).alias("src"), F.substring_index("dst", "#", 1).alias("dst")).distinct()
    return O.cluster_edges(e, one_level(spark, d))


@query("WITH " + SQL_ONE.replace("split_part(folder, '/', 1)", "folder") + """, o AS (SELECT DISTINCT repo_id, cluster, string_split(cluster, '/')[-1] AS l1, array_to_string(string_split(cluster, '/')[-2:], '/') AS l2 FROM clu)
SELECT repo_id, cluster, CASE WHEN cluster = '' THEN '/' WHEN count(*) OVER (PARTITION BY repo_id, l1) = 1 THEN l1 WHEN count(*) OVER (PARTITION BY repo_id, l2) = 1 THEN l2 ELSE cluster END AS label FROM o""")
def cluster_labels(spark, d):
    return O.cluster_labels(files(spark, d).select("repo_id", X.dirname("path").alias("cluster")))


def _three(c: str):
    """Three decimals."""
    return (F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c)


def _points(spark, d) -> DataFrame:
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    c = table(spark, d, "chunks").where(V.usable("embedding", 96)).groupBy("chunk_no").agg(F.max(F.struct("repo_id", F.coalesce("importance", F.lit(0.0)).alias("importance"), (v(0) * 100).alias("x"), (v(1) * 100).alias("y"), (v(2) * 100).alias("z"))).alias("p"))
    return c.select("chunk_no", "p.*")


SQL_POINTS = """pt AS (SELECT chunk_no, max((repo_id, coalesce(importance, 0), embedding[1]::DOUBLE * 100, embedding[2]::DOUBLE * 100, embedding[3]::DOUBLE * 100)) AS p FROM chunks
 WHERE embedding IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 GROUP BY 1),
po AS (SELECT chunk_no, p[1] AS repo_id, p[2] AS importance, p[3] AS x, p[4] AS y, p[5] AS z FROM pt)"""


@query("WITH " + SQL_POINTS + """, c AS (SELECT repo_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, max(importance) AS importance, count(*) AS members FROM po GROUP BY 1),
dd AS (SELECT repo_id, c.members, sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2)) AS d FROM po JOIN c USING (repo_id)), r AS (SELECT repo_id, d, members, row_number() OVER (PARTITION BY repo_id ORDER BY d) - 1 AS i FROM dd)
SELECT c.repo_id, floor(cx * 1000 + 0.5) / 1000 AS cx, floor(cy * 1000 + 0.5) / 1000 AS cy, floor(cz * 1000 + 0.5) / 1000 AS cz, c.importance, c.members, floor(r.d * 1000 + 0.5) / 1000 AS spread FROM c JOIN r USING (repo_id) WHERE r.i = least(c.members - 1, floor(c.members * 0.9))""")
def cluster_stats(spark, d):
    s = O.cluster_stats(_points(spark, d), ["repo_id"], "x", "y", "z", "importance")
    return s.select("repo_id", *[_three(c) for c in ("cx", "cy", "cz")], "importance", "members", _three("spread"))


@query("WITH " + SQL_POINTS + """SELECT repo_id, floor(CASE WHEN sum(importance * importance) > 0 THEN sum(importance * importance * x) / sum(importance * importance) ELSE avg(x) END * 1000 + 0.5) / 1000 AS cx, floor((min(x) + max(x)) / 2 * 1000 + 0.5) / 1000 AS mx,
 floor(greatest(1.4 * greatest((max(x) - min(x)) / 2, (max(y) - min(y)) / 2, (max(z) - min(z)) / 2), 100.0) * 1000 + 0.5) / 1000 AS radius FROM po GROUP BY 1""")
def layout_frame(spark, d):
    return O.frame(_points(spark, d), ["repo_id"], "x", "y", "z", "importance").select("repo_id", _three("cx"), _three("mx"), _three("radius"))


SQL_LABELS = r"""g AS (SELECT repo_id, file_id, path, string_split(path, '/') AS s FROM source_files),
lb AS (SELECT repo_id, file_id, path, CASE WHEN regexp_full_match(s[-1], 'index\.[cm]?[jt]sx?|__init__\.py|mod\.rs|main\.(py|go)') AND len(s) > 1 THEN s[-2] || '/' || s[-1] ELSE s[-1] END AS label FROM g)"""


@query("WITH " + SQL_LABELS + " SELECT repo_id, path, label FROM lb")
def file_labels(spark, d):
    return O.file_labels(files(spark, d))


@query("""WITH fn AS (SELECT DISTINCT repo_id, id, max(importance) AS importance FROM function_nodes GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(importance, -1) DESC, id) AS place, count(*) OVER (PARTITION BY repo_id) AS n FROM fn)
SELECT repo_id, id, place FROM r WHERE place <= least(n, 300, greatest(10, floor(n * 0.2 + 0.5)))""")
def focus_set(spark, d):
    fn = table(spark, d, "function_nodes").groupBy("repo_id", "id").agg(F.coalesce(F.max("importance"), F.lit(-1.0)).alias("importance"))
    return O.focus_set(fn, ["repo_id"], "importance", "id").select("repo_id", "id", "place")


@query("""WITH fn AS (SELECT repo_id, file_id, id, max(coalesce(importance, -1)) AS importance FROM function_nodes GROUP BY ALL), f AS (SELECT fn.*, regexp_replace(s.path, '/?[^/]*$', '') AS folder FROM fn JOIN source_files s USING (file_id))
SELECT repo_id, folder, id, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, folder ORDER BY importance DESC, id, file_id) AS place FROM f) WHERE place <= 8""")
def folder_panel(spark, d):
    """The eight most important declarations of each folder."""
    fn = table(spark, d, "function_nodes").groupBy("repo_id", "file_id", "id").agg(F.max(F.coalesce("importance", F.lit(-1.0))).alias("importance"))
    f = fn.join(files(spark, d).select("file_id", X.dirname("path").alias("folder")), "file_id")
    w = Window.partitionBy("repo_id", "folder").orderBy(F.desc("importance"), "id", "file_id")
    return f.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 8").select("repo_id", "folder", "id", "place")


def _file_weights(spark, d) -> DataFrame:
    """Files with the importance of their most important declaration (0 without any)."""
    fn = table(spark, d, "function_nodes").groupBy("file_id").agg(F.max(F.coalesce("importance", F.lit(0.0))).alias("importance"))
    return files(spark, d).join(fn, "file_id", "left").select("repo_id", "file_id", "path", F.coalesce("importance", F.lit(0.0)).alias("importance"))


SQL_WEIGHTS = "im AS (SELECT file_id, max(coalesce(importance, 0)) AS importance FROM function_nodes GROUP BY 1), fw AS (SELECT f.repo_id, f.file_id, f.path, coalesce(im.importance, 0) AS importance FROM source_files f LEFT JOIN im USING (file_id))"


@query("WITH " + SQL_LABELS + "," + SQL_WEIGHTS + " SELECT repo_id, path, label, place FROM (SELECT fw.*, lb.label, row_number() OVER (PARTITION BY fw.repo_id ORDER BY importance DESC, fw.path) AS place FROM fw JOIN lb USING (file_id)) WHERE place <= 12")
def map_labels(spark, d):
    """The twelve files of each repository whose names are on the map."""
    top = O.top_rows(_file_weights(spark, d), ["repo_id"], [F.desc("importance"), F.asc("path")], 12)
    return top.join(O.file_labels(files(spark, d)), ["repo_id", "path"]).select("repo_id", "path", "label", "place")


@query("WITH " + SQL_WEIGHTS + ", x AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder FROM fw) SELECT repo_id, folder, path, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, folder ORDER BY importance DESC, path) AS place FROM x) WHERE place <= 8")
def folder_files(spark, d):
    """The eight most important files of each folder."""
    rows = _file_weights(spark, d).withColumn("folder", X.dirname("path"))
    return O.top_rows(rows, ["repo_id", "folder"], [F.desc("importance"), F.asc("path")], 8).select("repo_id", "folder", "path", "place")


@query("WITH " + SQL_ONE + ", n AS (SELECT repo_id, cluster, count(*) AS files FROM clu GROUP BY ALL) SELECT repo_id, cluster, files, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, cluster) AS place FROM n) WHERE place <= 15")
def bubble_labels(spark, d):
    """The fifteen largest folders of each repository, which are named in the folders view."""
    n = one_level(spark, d).groupBy("repo_id", "cluster").agg(F.count("*").alias("files"))
    return O.top_rows(n, ["repo_id"], [F.desc("files"), F.asc("cluster")], 15).select("repo_id", "cluster", "files", "place")


@query("""WITH fn AS (SELECT file_id, id, any_value(qualified_name) AS q, max(coalesce(importance, 0)) AS importance, min((start_line, id)) AS o, bool_or(exported) AS e FROM function_nodes GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY importance DESC, id) AS i, row_number() OVER (PARTITION BY file_id ORDER BY o) AS j, count(*) FILTER (e) OVER (PARTITION BY file_id) AS exported FROM fn)
SELECT file_id, id, CASE WHEN exported > 0 THEN i ELSE j END AS place FROM r WHERE (exported > 0 AND i <= 5) OR (exported = 0 AND j <= 12)""")
def node_panel(spark, d):
    """A file's five most important declarations where any is exported (as a stand-in for summarised ones), else
    the first twelve in the file."""
    fn = table(spark, d, "function_nodes").groupBy("file_id", "id").agg(F.max(F.coalesce("importance", F.lit(0.0))).alias("importance"), F.min(F.struct("start_line", "id")).alias("o"), F.bool_or("exported").alias("e"))
    some = fn.groupBy("file_id").agg(F.coalesce(F.bool_or("e"), F.lit(False)).alias("any"))
    rows = fn.join(some, "file_id")
    best = O.top_rows(rows.where("any"), ["file_id"], [F.desc("importance"), F.asc("id")], 5)
    return best.unionByName(O.top_rows(rows.where("NOT any"), ["file_id"], [F.asc("o")], 12)).select("file_id", "id", "place")


@query("WITH " + SQL_CALLS + "," + SQL_WEIGHTS + """, ew AS (SELECT repo_id, max(weight) AS top FROM cedge GROUP BY 1)
SELECT e.repo_id, e.src, e.dst, round(ln(1 + weight) / ln(1 + top), 6) AS tint FROM cedge e JOIN ew USING (repo_id)""")
def call_tints(spark, d):
    """How strongly each call is drawn."""
    e = call_edges(spark, d)
    both = e.join(e.groupBy("repo_id").agg(F.max("weight").alias("top")), "repo_id")
    return both.select("repo_id", "src", "dst", F.round(O.scales("weight", "weight", "top", "weight", "top")["tint"], 6).alias("tint"))


@query("WITH " + SQL_WEIGHTS + """, n AS (SELECT repo_id, count(*) AS n FROM fw GROUP BY 1), m AS (SELECT max(n) AS most FROM n)
SELECT fw.repo_id, fw.path, round(sqrt(importance), 6) AS ramp, round(0.006 + 0.018 * sqrt(importance), 6) AS radius_share, round(0.025 + 0.075 * sqrt(n.n / m.most), 6) AS bubble_share FROM fw JOIN n USING (repo_id), m""")
def node_scales(spark, d):
    """Place on the colour ramp and radius of each file, and its repository's share as a bubble."""
    w = _file_weights(spark, d)
    n = w.groupBy("repo_id").agg(F.count("*").alias("n"))
    both = w.join(n, "repo_id").crossJoin(F.broadcast(n.agg(F.max("n").alias("most"))))  # one row
    s = O.scales("importance", "n", "most", "importance", "importance")
    return both.select("repo_id", "path", *[F.round(s[c], 6).alias(c) for c in ("ramp", "radius_share", "bubble_share")])


@query("WITH " + SQL_POINTS + """, n AS (SELECT repo_id, count(*) AS n FROM po GROUP BY 1), r AS (SELECT po.*, n.n, row_number() OVER (PARTITION BY po.repo_id ORDER BY po.importance DESC, chunk_no) AS place FROM po JOIN n USING (repo_id)),
fo AS (SELECT * FROM r WHERE place <= least(n, 300, greatest(10, floor(n * 0.2 + 0.5)))),
c AS (SELECT repo_id, CASE WHEN sum(importance * importance) > 0 THEN sum(importance * importance * x) / sum(importance * importance) ELSE avg(x) END AS cx, CASE WHEN sum(importance * importance) > 0 THEN sum(importance * importance * y) / sum(importance * importance) ELSE avg(y) END AS cy,
  CASE WHEN sum(importance * importance) > 0 THEN sum(importance * importance * z) / sum(importance * importance) ELSE avg(z) END AS cz FROM fo GROUP BY 1),
m AS (SELECT repo_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM po GROUP BY 1),
fd AS (SELECT fo.repo_id, sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2)) AS d FROM fo JOIN c USING (repo_id)), od AS (SELECT po.repo_id, sqrt(power(x - mx, 2) + power(y - my, 2) + power(z - mz, 2)) AS d FROM po JOIN m USING (repo_id)),
ed AS (SELECT po.repo_id, max(sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2))) AS d FROM po JOIN c USING (repo_id) GROUP BY 1),
pf AS (SELECT repo_id, list_sort(list(d))[1 + least(count(*) - 1, floor(count(*) * 0.9))::BIGINT] AS d FROM fd GROUP BY 1), pp AS (SELECT repo_id, list_sort(list(d))[1 + least(count(*) - 1, floor(count(*) * 0.9))::BIGINT] AS d FROM od GROUP BY 1)
SELECT c.repo_id, floor(cx * 1000 + 0.5) / 1000 AS cx, floor(my * 1000 + 0.5) / 1000 AS my, floor(CASE WHEN pf.d > 0 THEN pf.d ELSE 100 END * 1000 + 0.5) / 1000 AS radius, floor(CASE WHEN pp.d > 0 THEN pp.d ELSE 100 END * 1000 + 0.5) / 1000 AS overview,
 floor(greatest(ed.d, CASE WHEN pf.d > 0 THEN pf.d ELSE 100 END) * 1000 + 0.5) / 1000 AS extent FROM c JOIN m USING (repo_id) JOIN pf USING (repo_id) JOIN pp USING (repo_id) JOIN ed USING (repo_id)""")
def layout_view(spark, d):
    """What the camera frames of each repository's points, with the overview and the furthest point."""
    return O.layout(_points(spark, d), ["repo_id"], "chunk_no", "x", "y", "z", "importance").select("repo_id", *[_three(c) for c in ("cx", "my", "radius", "overview", "extent")])


@query("WITH " + SQL_POINTS + """, m AS (SELECT repo_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM po GROUP BY 1)
SELECT repo_id, floor(any_value(mx) * 1000 + 0.5) / 1000 AS mx, floor(greatest(1.4 * max(sqrt(power(x - mx, 2) + power(y - my, 2) + power(z - mz, 2))), 100) * 1000 + 0.5) / 1000 AS radius FROM po JOIN m USING (repo_id) GROUP BY 1""")
def cluster_frame(spark, d):
    """What the folders view frames: every bubble."""
    return O.cluster_frame(_points(spark, d), ["repo_id"], "x", "y", "z").select("repo_id", _three("mx"), _three("radius"))


@query("""WITH n AS (SELECT repo_id, count(*) AS n FROM source_files GROUP BY 1) SELECT repo_id, n AS files, CASE WHEN n <= 300 THEN 100.0 ELSE greatest(0.1, 300 / n * 100) END AS prominent_percent, n > 400 AS folders_view FROM n""")
def view_defaults(spark, d):
    n = files(spark, d).groupBy("repo_id").agg(F.count("*").alias("files"))
    return n.select("repo_id", "files", F.when(F.col("files") <= 300, 100.0).otherwise(F.greatest(F.lit(0.1), 300 / F.col("files") * 100)).alias("prominent_percent"), (F.col("files") > 400).alias("folders_view"))


@query("WITH " + SQL_ONE + ", h AS (SELECT repo_id, cluster FROM clu GROUP BY ALL HAVING count(*) > 20) SELECT clu.repo_id, clu.path FROM clu ANTI JOIN h USING (repo_id, cluster)")
def hidden_mask(spark, d):
    """Files that stay in sight when folders of more than twenty files are collapsed."""
    c = one_level(spark, d)
    folded = c.groupBy("repo_id", "cluster").agg(F.count("*").alias("n")).where("n > 20").select("repo_id", "cluster")
    return c.join(folded, ["repo_id", "cluster"], "left_anti").select("repo_id", "path")


@query("WITH " + SQL_CALLS + """, im AS (SELECT repo_id, id, max(coalesce(importance, 0)) AS importance FROM function_nodes GROUP BY ALL)
SELECT e.repo_id, e.src, e.dst, round(40 + (1 - im.importance) * 60, 4) AS distance FROM cedge e JOIN im ON im.repo_id = e.repo_id AND im.id = e.dst""")
def link_distances(spark, d):
    """How long the layout draws each call: shorter towards what is important."""
    im = table(spark, d, "function_nodes").groupBy("repo_id", F.col("id").alias("dst")).agg(F.max(F.coalesce("importance", F.lit(0.0))).alias("importance"))
    return call_edges(spark, d).join(im, ["repo_id", "dst"]).select("repo_id", "src", "dst", F.round(40 + (1 - F.col("importance")) * 60, 4).alias("distance"))


@query("WITH " + SQL_CALLS + """, im AS (SELECT repo_id, id, max(coalesce(importance, 0)) AS importance FROM function_nodes GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY importance DESC, id) AS i, count(*) OVER (PARTITION BY repo_id) AS n FROM im),
cut AS (SELECT repo_id, importance AS cut FROM r WHERE i = greatest(1, floor(n * 0.5 + 0.5))), keep AS (SELECT im.repo_id, im.id FROM im JOIN cut USING (repo_id) WHERE im.importance >= cut.cut)
SELECT e.repo_id, e.src, e.dst FROM cedge e SEMI JOIN keep a ON a.repo_id = e.repo_id AND a.id = e.src SEMI JOIN keep b ON b.repo_id = e.repo_id AND b.id = e.dst""")
def visible_edges(spark, d):
    """Calls of which both ends are among the more important half of their repository."""
    im = table(spark, d, "function_nodes").groupBy("repo_id", "id").agg(F.max(F.coalesce("importance", F.lit(0.0))).alias("importance"))
    n = im.groupBy("repo_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.5 + 0.5)).alias("k"))
    keep = im.join(E.value_at_rank(im, ["repo_id"], "importance", n, "k").withColumnRenamed("importance", "cut"), "repo_id").where("importance >= cut").select("repo_id", "id")
    e = call_edges(spark, d).select("repo_id", "src", "dst")
    return e.join(keep.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(keep.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")
