"""The generic operators on ordinary tables: transitions of users, nations, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import exprs as X
from codelode.operators import edges as E
from codelode.operators.pagerank import pagerank
from codelode.plans.catalogue import query
from codelode.plans.graph import STEPS, unrolled
from codelode.session import table, written

SQL_E = """t AS (SELECT strftime(ts, '%Y-%m') AS repo_id, user_id AS src, lead(user_id) OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS dst FROM events),
edge AS (SELECT repo_id, src, dst, count(*) AS weight FROM t WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), ev AS (SELECT DISTINCT strftime(ts, '%Y-%m') AS repo_id, user_id AS v FROM events)"""


def transitions(spark, d) -> DataFrame:
    """From each event's user to the next one's, month by month. Events are ordered within quarters of an hour,
    so a busy month is no task of its own; its slices are at most 2,976 rows."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "user_id").withColumn("slice", F.floor(F.col("t") / (900 * 1_000_000)))
    inside = e.withColumn("dst", F.lead("user_id").over(Window.partitionBy("month", "slice").orderBy("t", "event_id")))
    # a slice's last event is followed by the first of the next slice that has any
    at = F.struct("t", "event_id")
    ends = e.groupBy("month", "slice").agg(F.max_by("user_id", at).alias("src"), F.min_by("user_id", at).alias("first"))
    across = ends.withColumn("dst", F.lead("first").over(Window.partitionBy("month").orderBy("slice")))
    nxt = inside.select("month", F.col("user_id").alias("src"), "dst").unionByName(across.select("month", "src", "dst"))
    return E.collapse(nxt, ["month", "src", "dst"], drop_loops=("src", "dst"))


def user_ranks(spark, d, iterations: int | None = None) -> DataFrame:
    v = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").distinct()
    return pagerank(v, transitions(spark, d), "month", "user_id", "src", "dst", "weight", iterations=iterations).withColumn("rank", F.round("rank", 8))


def part_ranks(spark, d, iterations: int | None = None) -> DataFrame:
    """Parts to suppliers: every supplier passes its rank on to all."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    e = written(E.collapse(li, ["flag", "src", "dst"]), "part-edges")
    v = e.select("flag", F.col("src").alias("vertex")).union(e.select("flag", "dst")).distinct()
    return pagerank(v, e, "flag", "vertex", "src", "dst", "weight", iterations=iterations).withColumn("rank", F.round("rank", 9))


@query("WITH " + SQL_E + " SELECT repo_id AS month, src, dst, weight FROM edge")
def edge_collapse(spark, d):
    return transitions(spark, d)


@query("WITH " + SQL_E + ", dg AS (SELECT repo_id, v, sum(o) AS o, sum(i) AS i FROM (SELECT repo_id, src AS v, 1 AS o, 0 AS i FROM edge UNION ALL SELECT repo_id, dst, 0, 1 FROM edge) GROUP BY ALL) SELECT ev.repo_id AS month, ev.v AS user_id, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i, 0)::BIGINT AS in_degree FROM ev LEFT JOIN dg USING (repo_id, v)")
def degree_distinct(spark, d):
    v = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").distinct()
    return E.degrees(v, transitions(spark, d), ["month"], "user_id", "src", "dst")


@query("WITH " + SQL_E + " SELECT repo_id AS month, dst, sum(weight)::BIGINT AS arrivals FROM edge GROUP BY ALL")
def incoming_weight(spark, d):
    return E.incoming_weight(transitions(spark, d), ["month"], "dst", "weight", "arrivals")


@query("WITH " + SQL_E + "," + unrolled(4, "ev", "edge") + " SELECT repo_id AS month, v AS user_id, round(r, 8) AS rank FROM r4")
def pagerank_weighted_four_steps(spark, d):
    return user_ranks(spark, d, iterations=4)


@query("WITH " + SQL_E + "," + unrolled(STEPS, "ev", "edge", stop=True) + f" SELECT repo_id AS month, v AS user_id, round(r, 8) AS rank FROM r{STEPS}")
def pagerank_weighted(spark, d):
    """Ranks of users by transitions, until each month has converged."""
    return user_ranks(spark, d)


SQL_P = "edge AS (SELECT l_returnflag AS repo_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL), pvx AS (SELECT repo_id, src AS v FROM edge UNION SELECT repo_id, dst FROM edge)"


@query("WITH " + SQL_P + "," + unrolled(3, "pvx", "edge") + " SELECT repo_id AS flag, v AS vertex, round(r, 9) AS rank FROM r3")
def pagerank_dangling_three_steps(spark, d):
    return part_ranks(spark, d, iterations=3)


@query("WITH " + SQL_P + "," + unrolled(STEPS, "pvx", "edge", stop=True) + f" SELECT repo_id AS flag, v AS vertex, round(r, 9) AS rank FROM r{STEPS}")
def pagerank_dangling(spark, d):
    """Parts to suppliers, until each flag has converged."""
    return part_ranks(spark, d)


@query("WITH b AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1) SELECT c_custkey, round(CASE WHEN hi = lo THEN 0.5 ELSE (c_acctbal - lo) / (hi - lo) END, 6) AS score FROM customer JOIN b USING (c_mktsegment)")
def minmax_normalize(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return E.min_max(c, ["c_mktsegment"], "c_acctbal", "score").select("c_custkey", F.round("score", 6).alias("score"))


@query("SELECT c_custkey, 0.5 AS score FROM customer")
def minmax_flat(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit(3.0).alias("v"))
    return E.min_max(c, [], "v", "score").select("c_custkey", "score")


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT min(ln(1 + n)) AS lo, max(ln(1 + n)) AS hi FROM n) SELECT user_id, n AS events, round(CASE WHEN hi = lo THEN 0.5 ELSE (ln(1 + n) - lo) / (hi - lo) END, 6) AS score FROM n, b")
def log_churn_score(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    return E.log_scores(n, [], "events", "score").select("user_id", "events", F.round("score", 6).alias("score"))


@query("SELECT p_brand, p_partkey, p_retailprice, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS place FROM part) WHERE place <= 3")
def topk_per_group(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), F.desc("p_size"), "p_partkey")
    return table(spark, d, "part").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("p_brand", "p_partkey", "p_retailprice", "place")


@query("""WITH n AS (SELECT p_brand, greatest(1, floor(count(*) * 0.1 + 0.5)) AS k FROM part GROUP BY 1), r AS (SELECT p.*, n.k, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i FROM part p JOIN n USING (p_brand)),
c AS (SELECT p_brand, p_retailprice AS cut FROM r WHERE i = k) SELECT p.p_partkey, p.p_brand FROM part p JOIN c USING (p_brand) WHERE p.p_retailprice >= c.cut""")
def threshold_by_rank(spark, d):
    """The dearest tenth of each brand, with all parts that tie with the last of it."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    n = p.groupBy("p_brand").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.1 + 0.5)).alias("k"))
    cut = E.value_at_rank(p, ["p_brand"], "p_retailprice", n, "k").withColumnRenamed("p_retailprice", "cut")
    return p.join(cut, "p_brand").where("p_retailprice >= cut").select("p_partkey", "p_brand")


@query("WITH " + SQL_E + ", b AS (SELECT repo_id, max(weight) AS top FROM edge GROUP BY 1) SELECT repo_id AS month, src, dst, round(ln(1 + weight) / ln(1 + top), 6) AS tint FROM edge JOIN b USING (repo_id)")
def edge_tint(spark, d):
    e = transitions(spark, d)
    return e.join(e.groupBy("month").agg(F.max("weight").alias("top")), "month").select("month", "src", "dst", F.round(F.log1p("weight") / F.log1p("top"), 6).alias("tint"))


@query("SELECT o_orderkey, unnest(ids) AS l_partkey, generate_subscripts(ids, 1) - 1 AS pos FROM (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS ids FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1)")
def dangling_skip_lookup(spark, d):
    """Ids kept in order in a list, looked up again; those without a record are skipped."""
    li = table(spark, d, "lineitem")
    lists = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    known = li.select("l_partkey").where("l_partkey % 3 > 0").distinct()
    hits = lists.select("o_orderkey", F.posexplode("ids").alias("pos", "l_partkey")).join(known, "l_partkey")
    w = Window.partitionBy("o_orderkey").orderBy("pos")
    return hits.select("o_orderkey", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query("""WITH c AS (SELECT s_nationkey AS sn, c_nationkey AS cn, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, weight FROM c JOIN nation a ON a.n_nationkey = cn JOIN nation b ON b.n_nationkey = sn WHERE cn <> sn""")
def nation_flows(spark, d):
    """Edges from customers' nations to suppliers' nations."""
    t = lambda n: table(spark, d, n)
    pairs = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = pairs.join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    e = E.collapse(pairs, ["c_nationkey", "s_nationkey"], drop_loops=("c_nationkey", "s_nationkey"))
    n = t("nation").select("n_nationkey", "n_name")
    return e.join(n.withColumnsRenamed({"n_nationkey": "c_nationkey", "n_name": "customer_nation"}), "c_nationkey").join(n.withColumnsRenamed({"n_nationkey": "s_nationkey", "n_name": "supplier_nation"}), "s_nationkey").select("customer_nation", "supplier_nation", "weight")
