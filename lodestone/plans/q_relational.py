"""Joins, set operations, rollups of scores (2.7, 2.8, 2.10), on the tables that stand for sources, chunks and pairs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import scoring
from lodestone.plans.queryset import QuerySet

query = QuerySet()
QUERIES, ORACLE = query.queries, query.oracle

R6 = "round({}, 6)"


@query(
    "join_with_ledger",
    """SELECT (SELECT count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) AS joined,
    (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unknown_keys, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing""",
)
def join_with_ledger(t):
    """Inner join, with the rows that found no partner counted on both sides in the same pass."""
    o, c = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), t("customer").select("c_custkey")
    both = o.join(c, o.o_custkey == c.c_custkey, "full_outer")
    count = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return both.agg(count(F.when(F.col("c_custkey").isNotNull(), F.col("n"))).alias("joined"), count(F.when(F.col("c_custkey").isNull(), F.col("n"))).alias("unknown_keys"), F.count_if(F.col("o_custkey").isNull()).alias("missing"))


@query("left_join_defaults", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, b.n_sources AS peers FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, count(*) AS n_sources FROM documents GROUP BY source) b USING (source)")
def left_join_defaults(t):
    d, l = t("documents").select("doc_id", "source"), t("labels")
    return d.join(l, "doc_id", "left").join(d.groupBy("source").agg(F.count("*").alias("peers")), "source", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "peers")


@query(
    "two_key_join_weights",
    "SELECT p.l_orderkey, p.l_linenumber, coalesce(w.weight, 1.0) AS weight FROM lineitem p LEFT JOIN (SELECT l_orderkey, l_linenumber, round(l_discount * 10, 6) AS weight FROM lineitem WHERE l_returnflag = 'R') w USING (l_orderkey, l_linenumber)",
)
def two_key_join_weights(t):
    p = t("lineitem")
    w = p.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 10, 6).alias("weight"))
    return p.select("l_orderkey", "l_linenumber").join(w, ["l_orderkey", "l_linenumber"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


@query(
    "plan_against_observed",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'unplanned' WHEN b.k IS NULL THEN 'absent' ELSE 'observed' END AS status
    FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O') a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F') b ON a.k = b.k) GROUP BY status""",
)
def plan_against_observed(t):
    a = t("lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("planned", F.lit(True))
    b = t("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k")).withColumn("seen", F.lit(True))
    status = F.when(F.col("planned").isNull(), "unplanned").when(F.col("seen").isNull(), "absent").otherwise("observed")
    return a.join(b, "k", "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "strict_one_to_one",
    """WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id)
    SELECT count(*) FILTER (WHERE a.doc_id IS NULL) AS right_only, count(*) FILTER (WHERE b.doc_id IS NULL) AS left_only, count(*) FILTER (WHERE a.n > 1 OR b.n > 1) AS repeated FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
)
def strict_one_to_one(t):
    return scoring.one_to_one(t("documents"), t("labels"), "doc_id")


@query("common_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def common_keys(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id")).intersect(t("embeddings").select(F.col("vec_id").alias("doc_id")))


@query("same_label_join", "SELECT a.doc_id, a.quality FROM labels a JOIN labels b ON a.doc_id + 1 = b.doc_id AND a.quality = b.quality")
def same_label_join(t):
    a, b = t("labels").alias("a"), t("labels").alias("b")
    return a.join(b, (F.col("a.doc_id") + 1 == F.col("b.doc_id")) & (F.col("a.quality") == F.col("b.quality"))).select("a.doc_id", "a.quality")


@query("whitelist_semi", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def whitelist_semi(t):
    ok = t("documents").join(t("labels").where("toxic = 1"), "doc_id").select("source").distinct()
    return t("documents").select("doc_id", "source").join(ok, "source", "left_semi").select("doc_id")


@query("exclusion_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN ('src0', 'src1') AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)")
def exclusion_anti(t):
    """A row goes if any of three key sets holds it: one anti join each, for an OR of equalities can't be hashed."""
    d = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    sources = d.where(F.col("source").isin("src0", "src1")).select("source").distinct()
    return d.join(t("labels").select("doc_id"), "doc_id", "left_anti").join(sources, "source", "left_anti").join(t("benchmark").select(F.sha2("text", 256).alias("h")), "h", "left_anti").select("doc_id")


@query("pending_work", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pending_work(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("dangling_references", "SELECT count(*) AS dangling FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) OR l_partkey NOT IN (SELECT p_partkey FROM part)")
def dangling_references(t):
    l = t("lineitem").select("l_orderkey", "l_partkey", F.monotonically_increasing_id().alias("row"))
    o, p = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("o")), t("part").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("p"))
    return l.join(o, "l_orderkey", "left").join(p, "l_partkey", "left").agg(F.count_if(F.col("o").isNull() | F.col("p").isNull()).alias("dangling"))


@query(
    "interval_overlap",
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 20 DAY AS b FROM orders)
    SELECT x.o_orderkey AS left_key, y.o_orderkey AS right_key FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a < y.b AND y.a < x.b""",
)
def interval_overlap(t):
    s = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS")).alias("b"))
    return scoring.overlapping(s, "o_custkey", "o_orderkey", "a", "b")


@query("best_covering_interval", "SELECT e.event_id, max(o.k) AS covering FROM (SELECT event_id, user_id, value FROM events) e JOIN (SELECT o_custkey, o_orderkey AS k, o_totalprice FROM orders) o ON e.user_id = o.o_custkey AND e.value <= o.o_totalprice GROUP BY e.event_id")
def best_covering_interval(t):
    """The best of all intervals that reach a value is a running maximum from the highest end down: rows of a user, not pairs."""
    ends = t("orders").select(F.col("o_custkey").alias("user"), F.col("o_totalprice").alias("at"), F.col("o_orderkey").alias("k"), F.lit(None).cast("long").alias("event_id"))
    both = ends.unionByName(t("events").select(F.col("user_id").alias("user"), F.col("value").alias("at"), F.lit(None).cast("long").alias("k"), "event_id"))
    above = Window.partitionBy("user").orderBy(F.desc("at"), F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("covering", F.max("k").over(above)).where("event_id IS NOT NULL AND covering IS NOT NULL AND user IS NOT NULL AND at IS NOT NULL").select("event_id", "covering")


@query("parameter_grid", "SELECT a / 10.0 AS threshold, b AS least_votes FROM range(1, 10) x(a), range(1, 4) y(b)")
def parameter_grid(t):
    """Both sides are small value tables."""
    spark = t("region").sparkSession
    a = spark.range(1, 10).select((F.col("id").cast("double") / 10).alias("threshold"))
    return a.crossJoin(spark.range(1, 4).select(F.col("id").alias("least_votes")))


@query(
    "same_type_other_source",
    """SELECT s_suppkey, other FROM (SELECT s.s_suppkey, o.s_suppkey AS other, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY sha256('7' || chr(0) || s.s_suppkey || chr(0) || o.s_suppkey)) AS k
    FROM supplier s JOIN supplier o ON s.s_nationkey = o.s_nationkey AND s.s_suppkey <> o.s_suppkey) WHERE k = 1""",
)
def same_type_other_source(t):
    s = t("supplier").select("s_suppkey", "s_nationkey")
    o = s.select(F.col("s_suppkey").alias("other"), "s_nationkey")
    pairs = s.join(o, "s_nationkey").where("s_suppkey <> other").withColumn("h", X.hash_rank("7", F.col("s_suppkey"), F.col("other")))
    return pairs.groupBy("s_suppkey").agg(F.min_by("other", "h").alias("other"))


@query("cross_group_overlap", "SELECT sha256(text) AS h, count(DISTINCT lang) AS n_groups, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(DISTINCT source) > 1")
def cross_group_overlap(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count_distinct("lang").alias("n_groups"), F.count("*").alias("n"), F.count_distinct("source").alias("s")).where("s > 1").drop("s")


@query("forbidden_overlap", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE toxic = 1) AS forbidden, count(*) FILTER (WHERE toxic = 1) = 0 AS passed FROM documents JOIN labels USING (doc_id)")
def forbidden_overlap(t):
    bad = F.count_if(F.col("toxic") == 1)
    return t("documents").join(t("labels"), "doc_id").agg(F.count("*").alias("n_rows"), bad.alias("forbidden"), (bad == 0).alias("passed"))


@query("tagged_union", "SELECT grp, count(*) AS n, count(DISTINCT text_id) AS ids FROM (SELECT 'benchmark' AS grp, item_id AS text_id FROM benchmark UNION ALL SELECT 'document', doc_id FROM documents UNION ALL SELECT 'page', page_id FROM pages) GROUP BY grp")
def tagged_union(t):
    rows = [t(n).select(F.lit(g).alias("grp"), F.col(k).alias("text_id")) for g, n, k in (("benchmark", "benchmark", "item_id"), ("document", "documents", "doc_id"), ("page", "pages", "page_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("text_id").alias("ids"))


@query("set_difference", "SELECT 'missing' AS side, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'unexpected', k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set_difference(t):
    c, o = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    return c.exceptAll(o.distinct()).distinct().select(F.lit("missing").alias("side"), "k").unionByName(o.distinct().join(c, "k", "left_anti").select(F.lit("unexpected").alias("side"), "k"))


@query("exclusion_union", "SELECT source FROM documents WHERE doc_id < 50 UNION SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def exclusion_union(t):
    d = t("documents")
    return d.where("doc_id < 50").select("source").union(d.join(t("labels").where("toxic = 1"), "doc_id").select("source")).distinct()


# ---- pair -> chunk -> source: line items are pairs, orders chunks, customers sources

PAIRS = """SELECT l_orderkey, o_custkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN -1.0 ELSE 0.0 END AS support,
CASE WHEN l_linestatus = 'F' THEN 1.0 WHEN l_discount >= 0.05 THEN 0.5 ELSE -1.0 END AS correction, CASE WHEN l_linestatus = 'O' AND l_discount < 0.05 THEN 0.5 ELSE 0.0 END AS penalty, l_tax, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
SCORED = f"SELECT *, support + correction - penalty AS cvg FROM ({PAIRS})"


def pairs(t):
    l, o = t("lineitem"), t("orders").select("o_orderkey", "o_custkey")
    support = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", -1.0).otherwise(0.0)
    correction = F.when(F.col("l_linestatus") == "F", 1.0).when(F.col("l_discount") >= 0.05, 0.5).otherwise(-1.0)
    penalty = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") < 0.05), 0.5).otherwise(0.0)
    rows = l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "o_custkey", "l_linenumber", support.alias("support"), correction.alias("correction"), penalty.alias("penalty"), "l_tax", "l_discount")
    return rows.withColumn("cvg", F.col("support") + F.col("correction") - F.col("penalty"))


@query("pair_chunk_source_rollup", f"SELECT o_custkey, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_pairs, round(avg(c) + 1e-9, 6) AS score FROM (SELECT o_custkey, l_orderkey, count(*) AS n, avg(cvg) AS c FROM ({SCORED}) GROUP BY o_custkey, l_orderkey) GROUP BY o_custkey")
def pair_chunk_source_rollup(t):
    return scoring.rollup(pairs(t), "l_orderkey", "o_custkey", "cvg").withColumnRenamed("source", "o_custkey")


@query("weighted_vs_mean", f"SELECT l_orderkey, round(CASE WHEN sum(greatest(l_tax - 0.02, 0)) = 0 THEN NULL ELSE sum(greatest(l_tax - 0.02, 0) * cvg) / sum(greatest(l_tax - 0.02, 0)) END, 6) AS weighted, round(avg(cvg), 6) AS plain FROM ({SCORED}) GROUP BY l_orderkey")
def weighted_vs_mean(t):
    """Weights below zero count as zero; without weight there is no weighted mean."""
    return pairs(t).groupBy("l_orderkey").agg(F.round(scoring.weighted_mean(F.col("l_tax") - 0.02, F.col("cvg")), 6).alias("weighted"), F.round(F.avg("cvg"), 6).alias("plain"))


@query("primary_else_all", f"SELECT l_orderkey, round(coalesce(avg(cvg) FILTER (WHERE l_discount >= 0.08), avg(cvg)), 6) AS score FROM ({SCORED}) GROUP BY l_orderkey")
def primary_else_all(t):
    return pairs(t).groupBy("l_orderkey").agg(F.round(F.coalesce(F.avg(F.when(F.col("l_discount") >= 0.08, F.col("cvg"))), F.avg("cvg")), 6).alias("score"))


@query("exactly_three_scored", f"SELECT l_orderkey, CASE WHEN count(*) = 3 THEN round(avg(cvg), 6) END AS mean_score, CASE WHEN count(*) = 3 THEN round(median(cvg), 6) END AS median_score FROM ({SCORED}) GROUP BY l_orderkey")
def exactly_three_scored(t):
    three = F.count("*") == 3
    return pairs(t).groupBy("l_orderkey").agg(F.when(three, F.round(F.avg("cvg"), 6)).alias("mean_score"), F.when(three, F.round(F.median("cvg"), 6)).alias("median_score"))


VARIANTS = {"full": "support + correction - penalty", "no_penalty": "support + correction", "plus_only": "support", "minus_only": "correction - penalty", "correction_only": "correction", "penalty_only": "-penalty"}


@query("ablation_variants", " UNION ALL ".join(f"SELECT '{n}' AS variant, o_custkey, round(avg(c) + 1e-9, 6) AS score FROM (SELECT o_custkey, l_orderkey, avg({e}) AS c FROM ({PAIRS}) GROUP BY 1, 2) GROUP BY o_custkey" for n, e in VARIANTS.items()))
def ablation_variants(t):
    """All variants in one pass: a struct of scores is exploded, not a scan for each."""
    rows = pairs(t).withColumn("v", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.expr(e).alias("x")) for n, e in VARIANTS.items()))))
    chunks = rows.groupBy("v.variant", "o_custkey", "l_orderkey").agg(F.avg("v.x").alias("c"))
    return chunks.groupBy("variant", "o_custkey").agg(F.round(F.avg("c") + 1e-9, 6).alias("score"))


@query("budget_prefix", f"SELECT o_custkey, budget, round(avg(cvg) + 1e-9, 6) AS score, count(*) AS used FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, cvg, l_tax, l_discount) AS k FROM ({SCORED})), (SELECT unnest([2, 4, 8]) AS budget) WHERE k <= budget // 2 GROUP BY 1, 2")
def budget_prefix(t):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "cvg", "l_tax", "l_discount"))
    rows = pairs(t).withColumn("k", k).where("k <= 4").withColumn("budget", F.explode(F.array(*map(F.lit, (2, 4, 8))))).where("k <= budget div 2")
    return rows.groupBy("o_custkey", "budget").agg(F.round(F.avg("cvg") + 1e-9, 6).alias("score"), F.count("*").alias("used"))


@query("budget_knapsack")
def budget_knapsack(t):
    """Greedy with skips: an order that would exceed the budget is passed over and later ones are tried."""
    orders = t("orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("item"), F.floor("o_totalprice").cast("long").alias("cost"))
    return scoring.knapsack(orders, 200_000)


@query("null_if_any_missing", "SELECT lang, CASE WHEN count(*) FILTER (WHERE quality IS NULL) > 0 THEN NULL ELSE avg(quality) END AS score, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def null_if_any_missing(t):
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("lang").agg(F.when(F.count_if(F.col("quality").isNull()) == 0, F.avg("quality")).alias("score"), F.count("*").alias("n"))


@query("hit_rate_by_key", "SELECT source, count(*) AS n, round(avg(CAST(toxic = 1 AS INT)), 6) AS rate, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY source")
def hit_rate_by_key(t):
    return t("documents").join(t("labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("toxic") == 1).cast("int")), 6).alias("rate"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("source_texts", "SELECT source, count(*) AS n_texts, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS joined_sha256 FROM (SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY source, text) GROUP BY source")
def source_texts(t):
    """The distinct texts of a source in order of first appearance. A source's text is the result, hence one row a source."""
    first = t("documents").groupBy("source", "text").agg(F.min("doc_id").alias("doc_id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n\n")
    return first.groupBy("source").agg(F.count("*").alias("n_texts"), F.sha2(joined, 256).alias("joined_sha256"))


@query("coverage_by_group", "SELECT lang, count(*) AS planned, count(quality) AS eligible, count(*) FILTER (WHERE quality = 1) AS scored, count(DISTINCT source) AS sources FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage_by_group(t):
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("planned"), F.count("quality").alias("eligible"), F.count_if(F.col("quality") == 1).alias("scored"), F.count_distinct("source").alias("sources"))


@query("text_distribution", "SELECT source, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS least, max(n_chars) AS greatest, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source")
def text_distribution(t):
    return t("documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("greatest"), F.sum("n_chars").alias("total"))


@query("run_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def run_totals(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_distinct("user_id").alias("users"))


@query("audit_grouping_sets", "SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS precision_, count(*) FILTER (WHERE toxic = 1) AS rejected FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, source), (lang))")
def audit_grouping_sets(t):
    rows = t("documents").join(t("labels"), "doc_id")
    return rows.groupingSets([["lang", "source"], ["lang"]], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("precision_"), F.count_if(F.col("toxic") == 1).alias("rejected"))


@query(
    "threshold_grid",
    """SELECT th AS threshold, kept, round(good / kept, 6) AS precision_ FROM (SELECT th, count(*) AS kept, count(*) FILTER (WHERE quality = 1) AS good FROM labels JOIN documents USING (doc_id), (SELECT unnest([200, 500, 1000, 2000, 4000]) AS th) WHERE n_chars >= th GROUP BY th)
    WHERE good / kept >= 0.5 ORDER BY kept DESC, th LIMIT 1""",
)
def threshold_grid(t):
    """Of the thresholds whose precision passes the one that keeps most, the lowest of equals."""
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").withColumn("threshold", F.explode(F.array(*map(F.lit, (200, 500, 1000, 2000, 4000))))).where("n_chars >= threshold")
    each = rows.groupBy("threshold").agg(F.count("*").alias("kept"), F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("precision_")).where("precision_ >= 0.5")
    return each.orderBy(F.desc("kept"), "threshold").limit(1)


@query(
    "type_coverage_gate",
    """WITH o AS (SELECT p_brand AS k, count(*) AS n FROM part GROUP BY 1), v AS (SELECT p_brand AS k, count(*) AS m FROM part WHERE p_size > 45 GROUP BY 1)
    SELECT coalesce(o.k, v.k) AS type, coalesce(n, 0) AS opportunities, coalesce(m, 0) AS valid, CASE WHEN coalesce(n, 0) >= 20 THEN CAST(least(20, greatest(3, ceil(0.02 * n))) AS BIGINT) ELSE 0 END AS required,
    coalesce(m, 0) >= CASE WHEN coalesce(n, 0) >= 20 THEN least(20, greatest(3, ceil(0.02 * n))) ELSE 0 END AS passed FROM o FULL JOIN v ON o.k = v.k""",
)
def type_coverage_gate(t):
    o = t("part").groupBy(F.col("p_brand").alias("type")).agg(F.count("*").alias("opportunities"))
    v = t("part").where("p_size > 45").groupBy(F.col("p_brand").alias("type")).agg(F.count("*").alias("valid"))
    return scoring.coverage_gate(o, v)


@query("fallback_rate_gate", "SELECT count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1998-01-01') AS fallbacks, round(count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1998-01-01') / 100000.0, 6) AS rate, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1998-01-01') / 100000.0 <= 0.05 AS passed FROM lineitem")
def fallback_rate_gate(t):
    n = F.count_if(F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp"))
    return t("lineitem").agg(n.alias("fallbacks"), F.round(n / 100000.0, 6).alias("rate"), (n / 100000.0 <= 0.05).alias("passed"))
