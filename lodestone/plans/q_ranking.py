"""Ranking, sampling, splitting, duplicates and retrieval (2.9, 2.11, 2.12, 2.14)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import dedup, retrieval, selection
from lodestone.plans.q_text import SHINGLES, TERMS
from lodestone.plans.queryset import QuerySet

query = QuerySet()
QUERIES, ORACLE = query.queries, query.oracle

RANK = "sha256('42' || chr(0) || doc_id)"


def rank_of(key="doc_id", salt="42"):
    return X.hash_rank(salt, F.col(key))


# ---- retrieval

ASKED = "SELECT item_id AS query, text FROM benchmark"
BM25 = f"""WITH d AS (SELECT doc_id AS doc, {TERMS.format(t="text")} AS k FROM documents), c AS (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM d),
p AS (SELECT term, doc, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(k) AS dl, unnest(k) AS term FROM d) GROUP BY term, doc), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query, unnest(list_distinct({TERMS.format(t="text")})) AS term FROM ({ASKED})),
s AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY query, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)"""


def asked(t):
    return t("benchmark").select(F.col("item_id").alias("query"), "text")


@query("bm25_topk", f"{BM25} SELECT query, doc, score, rank FROM r WHERE rank <= 5")
def bm25_topk(t):
    return retrieval.top(retrieval.bm25(t("documents"), asked(t)), 5)


@query(
    "bm25_recall_mrr",
    f"""{BM25}, rel AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)), h AS (SELECT query, min(rank) AS rank FROM r JOIN rel USING (query, doc) WHERE rank <= 10 GROUP BY query)
    SELECT count(*) AS n_queries, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, count(*) FILTER (WHERE rank IS NULL) AS without_hit
    FROM (SELECT DISTINCT item_id AS query FROM benchmark) LEFT JOIN h USING (query)""",
)
def bm25_recall_mrr(t):
    hits = retrieval.top(retrieval.bm25(t("documents"), asked(t)), 10)
    texts = hits.select("query", "doc").join(t("documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("d")), "doc").join(t("benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("b")), "query")
    return retrieval.evaluate(hits, texts.where(F.contains("d", "b")).select("query", "doc"), asked(t))


@query("bm25_all_documents", f"{BM25} SELECT d.doc, round(coalesce(max(s.score), 0), 6) AS best, count(s.query) AS n_queries FROM d LEFT JOIN s USING (doc) GROUP BY d.doc")
def bm25_all_documents(t):
    """Documents that hold no term of any query keep a score of 0."""
    s = retrieval.bm25(t("documents"), asked(t))
    best = s.groupBy("doc").agg(F.max("score").alias("best"), F.count("*").alias("n_queries"))
    return t("documents").select(F.col("doc_id").alias("doc")).join(best, "doc", "left").na.fill(0, ["best", "n_queries"])


DENSE = """WITH s AS (SELECT q.vec_id AS query, d.vec_id AS doc, d.label = q.label AS same, round(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)"""


def dense_hits(t, k):
    v = t("embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    q = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return retrieval.top(retrieval.dense(v, q).where("query <> doc"), k)


@query("dense_topk", f"{DENSE} SELECT query, doc, score, rank FROM r WHERE rank <= 10")
def dense_topk(t):
    return dense_hits(t, 10)


@query("dense_label_recall", f"{DENSE} SELECT count(*) AS n, round(avg(CAST(same AS INT)), 6) AS precision_10 FROM r WHERE rank <= 10")
def dense_label_recall(t):
    e = t("embeddings").select("vec_id", "label")
    hits = dense_hits(t, 10).join(e.toDF("doc", "a"), "doc").join(e.toDF("query", "b"), "query")
    return hits.agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("precision_10"))


_JAC = f"SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT query, d.doc, round(len(list_intersect(list_distinct(d.k), q.k)) / len(q.k), 6) AS score FROM d JOIN (SELECT query, list(term) AS k FROM q GROUP BY query) q ON len(list_intersect(d.k, q.k)) > 0)"


@query("hybrid_rrf", f"{BM25}, o AS ({_JAC}), u AS (SELECT query, doc, rank FROM r WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM o WHERE rank <= 20), f2 AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY query, doc) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f2) WHERE rank <= 5")
def hybrid_rrf(t):
    """BM25 fused with term coverage, each to its 20 best."""
    scored = retrieval.bm25(t("documents"), asked(t))
    terms = asked(t).select("query", F.array_distinct(X.index_terms(F.col("text"))).alias("q"))
    own = t("documents").select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(X.index_terms(F.col("text")))).alias("term"))
    cover = own.join(terms.select("query", F.size("q").alias("n"), F.explode("q").alias("term")), "term").groupBy("query", "doc").agg(F.round(F.count("*") / F.first("n"), 6).alias("score"))
    return retrieval.top(retrieval.fuse([retrieval.top(scored, 20), retrieval.top(cover, 20)]), 5)


# ---- ranking

@query("lowest_hash_sample", f"SELECT doc_id FROM documents ORDER BY {RANK} LIMIT 100")
def lowest_hash_sample(t):
    return t("documents").orderBy(rank_of()).limit(100).select("doc_id")


@query("topk_per_family", "SELECT p_brand, p_partkey, k FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS d FROM part) WHERE d = 1)) WHERE k <= 3")
def topk_per_family(t):
    """One of each type, then three of each family."""
    best = [F.desc("p_retailprice"), "p_partkey"]
    one = t("part").withColumn("d", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(*best))).where("d = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(*best))).where("k <= 3").select("p_brand", "p_partkey", "k")


@query("topk_excluding", "SELECT c_nationkey, c_custkey, k FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) WHERE k <= 5")
def topk_excluding(t):
    out = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t("customer").join(out, "c_custkey", "left_anti").withColumn("k", k).where("k <= 5").select("c_nationkey", "c_custkey", "k")


@query(
    "fact_topk_nested",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS f FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS e FROM a WHERE f = 1)
    SELECT l_linenumber AS source, l_partkey, k FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS k FROM b WHERE e <= 2) WHERE k <= 3""",
)
def fact_topk_nested(t):
    """One row a fact, at most two an entity, three a source: windows are exact where the fact implies the entity."""
    by = lambda *keys: Window.partitionBy(keys[0]).orderBy(F.desc("l_extendedprice"), *keys[1:])
    a = t("lineitem").withColumn("f", F.row_number().over(by("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"))).where("f = 1")
    b = a.withColumn("e", F.row_number().over(by("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"))).where("e <= 2")
    return b.withColumn("k", F.row_number().over(by("l_linenumber", "l_orderkey", "l_partkey"))).where("k <= 3").select(F.col("l_linenumber").alias("source"), "l_partkey", "k")


@query("fact_topk_sequential")
def fact_topk_sequential(t):
    """In order of score: one a fact, two an entity, exactly three or none a source. A fact may hold several entities, so that
    what was taken before decides, source by source."""

    ranked = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_partkey", "l_linenumber", "l_suppkey")))
    start = F.array().cast("array<struct<p:double,l_partkey:bigint,l_linenumber:int,l_suppkey:bigint>>")
    new = lambda acc, x: (F.size(acc) < 3) & ~F.exists(acc, lambda y: y["l_partkey"] == x["l_partkey"]) & (F.size(F.filter(acc, lambda y: y["l_suppkey"] == x["l_suppkey"])) < 2)
    taken = t("lineitem").groupBy("l_orderkey").agg(ranked.alias("own")).select("l_orderkey", F.aggregate("own", start, lambda acc, x: F.when(new(acc, x), F.array_append(acc, x)).otherwise(acc)).alias("taken"))
    return taken.where("size(taken) = 3").select("l_orderkey", F.explode("taken").alias("x")).select("l_orderkey", "x.l_partkey", "x.l_suppkey")


@query("tie_tolerant_rank", "SELECT p_type, p_partkey, k FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS k FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_type) AS best FROM part) WHERE p_retailprice >= best - 50) WHERE k <= 2")
def tie_tolerant_rank(t):
    """Those within a tolerance of the best count as ties and are ranked by the next key."""
    near = t("part").withColumn("best", F.max("p_retailprice").over(Window.partitionBy("p_type"))).where("p_retailprice >= best - 50")
    return near.withColumn("k", F.row_number().over(Window.partitionBy("p_type").orderBy("p_size", "p_partkey"))).where("k <= 2").select("p_type", "p_partkey", "k")


@query("distinct_first_then_fallback", "SELECT o_custkey, o_orderkey, p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r > 1, o_totalprice DESC, o_orderkey) AS p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)) WHERE p <= 3")
def distinct_first_then_fallback(t):
    best = [F.desc("o_totalprice"), "o_orderkey"]
    r = t("orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(*best)))
    return r.withColumn("p", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("r") > 1, *best))).where("p <= 3").select("o_custkey", "o_orderkey", "p")


@query("round_robin_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY r, o_orderpriority) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders)")
def round_robin_order(t):
    r = t("orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")))
    return r.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("r", "o_orderpriority")).alias("place"))


@query("source_plan", "SELECT source, doc_id, k FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('11' || chr(0) || source || chr(0) || doc_id), doc_id) AS k FROM documents) WHERE k <= 4")
def source_plan(t):
    h = X.hash_rank("11", F.col("source"), F.col("doc_id"))
    return t("documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(h, "doc_id")).alias("k")).where("k <= 4")


@query("representative_chunk", "SELECT source, doc_id AS representative, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def representative_chunk(t):
    best = t("documents").groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d"))).alias("x"))
    return best.select("source", (-F.col("x.d")).alias("representative"), "x.n_chars")


@query("score_strata", "SELECT doc_id, CAST((p - 1) * 4 // n AS INT) AS stratum FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def score_strata(t):
    """Integer bounds: ntile would place remainders otherwise. No task sorts a language."""
    rows = t("documents").select("doc_id", "lang", "n_chars", F.expr("doc_id div 1000000").alias("million"))
    placed = selection.places(rows, "lang", ["n_chars", "million"], ["doc_id"])
    n = rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    return placed.join(n, F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", F.expr("CAST((place - 1) * 4 div n AS INT)").alias("stratum"))


@query(
    "latin_schedule",
    f"SELECT source, doc_id, block, rnd, (block + rnd) % 4 AS cell, row_number() OVER (PARTITION BY source ORDER BY block, rnd) AS ordinal FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {RANK}) - 1 AS block FROM documents), (SELECT unnest([0, 1, 2, 3]) AS rnd)",
)
def latin_schedule(t):
    """Blocks in hash order; the cells of a block are rotated by its number. No task sorts a source."""
    rows = t("documents").select("source", "doc_id", rank_of().alias("h")).withColumn("head", F.substring("h", 1, 3))
    rows = selection.places(rows, "source", ["head"], ["h"]).withColumn("block", F.col("place") - 1).withColumn("rnd", F.explode(F.array(*map(F.lit, range(4)))))
    return rows.select("source", "doc_id", "block", "rnd", F.pmod(F.col("block") + F.col("rnd"), F.lit(4)).alias("cell"), (F.col("block") * 4 + F.col("rnd") + 1).alias("ordinal"))


# ---- sampling and splits

SPLIT = "CASE WHEN substr(sha256('42' || chr(0) || source), 1, 1) < '6' THEN 'member' WHEN substr(sha256('42' || chr(0) || source), 1, 1) < 'c' THEN 'non_member' ELSE 'reserve' END"


@query("hash_split", f"SELECT doc_id, {SPLIT} AS grp FROM documents")
def hash_split(t):
    """Whole sources, by the first digit of their hash: no source is in two groups, and no count is needed."""
    d = F.substring(rank_of("source"), 1, 1)
    return t("documents").select("doc_id", F.when(d < "6", "member").when(d < "c", "non_member").otherwise("reserve").alias("grp"))


@query("exact_count_split", "SELECT source, CASE WHEN k <= 8 THEN 'member' WHEN k <= 16 THEN 'non_member' ELSE 'reserve' END AS grp FROM (SELECT source, row_number() OVER (ORDER BY sha256('42' || chr(0) || source), source) AS k FROM (SELECT DISTINCT source FROM documents))")
def exact_count_split(t):
    k = F.row_number().over(Window.orderBy(rank_of("source"), "source"))  # over sources, which a split names one by one
    return t("documents").select("source").distinct().withColumn("k", k).select("source", F.when(F.col("k") <= 8, "member").when(F.col("k") <= 16, "non_member").otherwise("reserve").alias("grp"))


@query("group_balanced_sample", "SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) WHERE k <= 25")
def group_balanced_sample(t):
    return t("labels").withColumn("k", F.row_number().over(Window.partitionBy("quality").orderBy("doc_id"))).where("k <= 25").select("doc_id", "quality")


@query("stratified_roundrobin", f"SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {RANK}) AS k FROM documents) ORDER BY k, lang LIMIT 60")
def stratified_roundrobin(t):
    return t("documents").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(rank_of()))).orderBy("k", "lang").limit(60).select("doc_id")


@query("distinct_source_sample")
def distinct_source_sample(t):
    """Stratified, preferring sources not yet drawn: a greedy walk. Of a stratum it can only reach the first rows of its 40 first
    sources, and its 40 first rows for the fill."""
    rows = t("documents").select("doc_id", "lang", "source", rank_of().alias("h"))
    k = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = rows.withColumn("k", k.cast("long")).where("k <= 40").select("doc_id", "lang", "source", "k")
    first = rows.groupBy("lang", "source").agg(F.min(F.struct("h", "doc_id")).alias("x")).select("lang", "source", "x.h", "x.doc_id").withColumn("j", k - 1).where("j < 40")
    # the rank of such a row in its stratum, from counts of the rows between them
    ends = first.groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("ends")).withColumnRenamed("lang", "of")
    below = rows.join(F.broadcast(ends), F.col("lang").eqNullSafe(F.col("of"))).groupBy("of", F.size(F.filter("ends", lambda e: e < F.col("h"))).alias("at")).agg(F.count("*").alias("c"))
    ranked = below.select("of", "at", F.sum("c").over(Window.partitionBy("of").orderBy("at")).alias("k"))
    far = first.join(ranked, F.col("lang").eqNullSafe(F.col("of")) & (F.col("at") == F.col("j"))).where("k > 40").select("doc_id", "lang", "source", "k")
    few = few.unionByName(far).withColumn("all", F.lit(0))

    def walk(rows):
        seen, taken = set(), []
        for again in (False, True):
            for x in rows.sort_values(["k", "lang"]).itertuples():
                if len(taken) < 40 and x.Index not in taken and (again or x.source not in seen):
                    seen.add(x.source)
                    taken.append(x.Index)
        return rows.loc[taken, ["doc_id", "lang", "source"]]

    return few.groupBy("all").applyInPandas(walk, "doc_id long, lang string, source string")


@query("pilot_cohorts", f"SELECT doc_id, CAST((k - 1) // 20 AS INT) AS cohort FROM (SELECT doc_id, row_number() OVER (ORDER BY {RANK}, doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE k <= 100")
def pilot_cohorts(t):
    few = t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti").withColumn("h", rank_of()).orderBy("h", "doc_id").limit(100)
    return few.withColumn("k", F.row_number().over(Window.orderBy("h", "doc_id"))).select("doc_id", F.expr("CAST((k - 1) div 20 AS INT)").alias("cohort"))


@query("shadow_subsets", "SELECT shadow, vec_id FROM (SELECT s AS shadow, vec_id, row_number() OVER (PARTITION BY s ORDER BY sha256(s || chr(0) || vec_id), vec_id) AS k FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS s)) WHERE k <= 50")
def shadow_subsets(t):
    rows = t("embeddings").select("vec_id", F.explode(F.array(*map(F.lit, range(4)))).alias("shadow"))
    k = F.row_number().over(Window.partitionBy("shadow").orderBy(X.hash_rank(F.col("shadow"), F.col("vec_id")), "vec_id"))
    return rows.withColumn("k", k).where("k <= 50").select("shadow", "vec_id")


# ---- duplicates

@query("exact_dedup_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_dedup_first(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("first_wins_rows", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_wins_rows(t):
    return dedup.first_wins(t("documents").select("doc_id", "source", F.sha2("text", 256).alias("h")), F.col("h"), "doc_id").select("doc_id", "source")


_SET = f"SELECT doc_id, {SHINGLES} AS s FROM (SELECT doc_id, {TERMS.format(t='text')} AS k FROM documents)"
_SKETCH = "list_sort(list_transform(s, lambda x: substr(sha256(x), 1, 16)))"


@query("bottomk_sketch", f"SELECT doc_id, CASE WHEN len(s) = 0 THEN repeat('0', 16) ELSE v[1] END AS least, CASE WHEN len(s) = 0 THEN repeat('0', 16) ELSE v[least(len(v), 64)] END AS last FROM (SELECT doc_id, s, {_SKETCH} AS v FROM ({_SET}))")
def bottomk_sketch(t):
    s = t("documents").select("doc_id", X.index_terms(F.col("text")).alias("k")).select("doc_id", X.shingles(F.col("k")).alias("s"))
    return dedup.bottom_sketch(s, "s", "v").select("doc_id", F.get("v", F.lit(0)).alias("least"), F.get("v", F.lit(63)).alias("last"))


@query("near_dup_pairs")
def near_dup_pairs(t):
    return dedup.near_duplicates(t("documents"), "doc_id", "text")


@query("near_dup_components")
def near_dup_components(t):
    return dedup.components(dedup.near_duplicates(t("documents"), "doc_id", "text").select("left", "right"))


@query("copy_components", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY sha256(text)) AS component FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1")
def copy_components(t):
    """Components of the links from each copy to the next one, which are the classes of equal texts."""
    h = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    chain = h.withColumn("right", F.lead("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))).where("right IS NOT NULL").select(F.col("doc_id").alias("left"), "right")
    return dedup.components(chain)


@query("source_dedup_complete")
def source_dedup_complete(t):
    small = t("documents").withColumn("source", F.concat_ws("/", "source", (F.col("doc_id") % 40).cast("string")))
    return dedup.complete_sources(small, "source", F.sha2("text", 256))


@query("benchmark_containment", f"""WITH g AS (SELECT item_id, unnest(s) AS g FROM (SELECT item_id, {SHINGLES} AS s FROM (SELECT item_id, {TERMS.format(t="text")} AS k FROM benchmark))), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1), d AS (SELECT doc_id, unnest(s) AS g FROM ({_SET}))
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n), 6) AS containment FROM d JOIN g USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.5""")
def benchmark_containment(t):
    grams = t("benchmark").select("item_id", X.index_terms(F.col("text")).alias("k")).select("item_id", X.shingles(F.col("k")).alias("s")).select("item_id", F.size("s").alias("n"), F.explode("s").alias("g"))
    own = t("documents").select("doc_id", X.index_terms(F.col("text")).alias("k")).select("doc_id", F.explode(X.shingles(F.col("k"))).alias("g"))
    found = own.join(grams, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), (F.count("*") / F.first("n")).alias("c"))
    return found.where("c >= 0.5").select("doc_id", "item_id", "shared", F.round("c", 6).alias("containment"))


@query("document_frequency", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TERMS.format(t='text')})) AS term FROM documents) GROUP BY term HAVING count(*) >= 5")
def document_frequency(t):
    return t("documents").select(F.explode(F.array_distinct(X.index_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df >= 5")
