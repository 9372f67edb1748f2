"""Selection under constraints, recorded predictions, gates over variants, and fused dense retrieval (2.9, 2.11, 2.13, 2.14)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import retrieval, selection
from lodestone.plans import q_evaluation
from lodestone.plans.q_ranking import BM25, asked
from lodestone.plans.q_text import TERMS
from lodestone.plans.queryset import QuerySet

query = QuerySet()
QUERIES, ORACLE = query.queries, query.oracle


_FILL = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('42' || chr(0) || o_orderkey), o_orderkey) AS k, o_orderkey FROM orders"


@query(
    "exclusive_fill",
    f"""WITH s AS (SELECT o_custkey, sha256('42' || chr(0) || o_custkey) AS h, least(count(*), 4) AS n FROM orders GROUP BY o_custkey), a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s),
    c AS (SELECT * EXCLUDE (b), coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM a WHERE b >= 61),
    g AS (SELECT o_custkey, 'member' AS grp, least(n, 61 - b) AS take FROM a WHERE b < 61 UNION ALL SELECT o_custkey, 'non_member', least(n, 42 - b) FROM c WHERE b < 42)
    SELECT o_custkey, o_orderkey, grp FROM ({_FILL}) JOIN g USING (o_custkey) WHERE k <= take""",
)
def exclusive_fill(t):
    return selection.exclusive_fill(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", {"member": 61, "non_member": 42}, 4)


_TEXTS = "SELECT o_custkey AS source, o_orderkey AS pair, 'q' || (o_orderkey % 7) AS a, 'q' || ((o_orderkey * 3 + o_custkey) % 7) AS b, o_totalprice AS price FROM orders"


@query(
    "distinct_text_pairs",
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY price DESC, pair) AS p FROM ({_TEXTS}) WHERE a <> b), two AS (SELECT x.source, x.p AS i, y.p AS j, [x.a, x.b, y.a, y.b] AS used FROM v x JOIN v y ON x.source = y.source AND x.p < y.p AND NOT list_has_any([x.a, x.b], [y.a, y.b])),
    best AS (SELECT source, min([i, j, p]) AS c FROM two JOIN v USING (source) WHERE j < p AND NOT list_has_any(used, [a, b]) GROUP BY source)
    SELECT source, pair, CAST(list_position(c, p) AS INT) AS place FROM best JOIN v USING (source) WHERE list_contains(c, p)""",
)
def distinct_text_pairs(t):
    """Three pairs a source, no text twice: the first such choice, also where taking the best pair first would leave too few."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t("orders").select(c.alias("source"), o.alias("pair"), F.concat(F.lit("q"), o % 7).alias("a"), F.concat(F.lit("q"), (o * 3 + c) % 7).alias("b"), "o_totalprice")
    return selection.distinct_text_pairs(rows, [-F.col("o_totalprice"), F.col("pair")], 3)


_CANDIDATES = """SELECT source, pair, 't' || ((pair + t * 3) % 5) AS template, 'o' || ((pair // 4 + t) % 5) AS opening, 'a' || ((pair + t) % 2) AS auxiliary, (pair * 7 + t * 13) % 10 AS entailment, (pair * 3 + t * 5) % 10 AS similarity, (pair + t) % 6 AS containment, (pair * 5 + t) % 8 AS run, (pair * 11 + t) % 10 AS fidelity, 8 + (pair + t * t) % 7 AS words
FROM (SELECT o_custkey AS source, o_orderkey AS pair, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), (SELECT unnest([0, 1, 2]) AS t) WHERE k <= 3"""


@query(
    "diverse_choice",
    f"""WITH c AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY pair) AS slot FROM ({_CANDIDATES})),
    j AS (SELECT x.source, x.pair AS p1, y.pair AS p2, z.pair AS p3, x.template AS t1, y.template AS t2, z.template AS t3, row_number() OVER (PARTITION BY x.source ORDER BY least(x.entailment, y.entailment, z.entailment) DESC, least(x.similarity, y.similarity, z.similarity) DESC, greatest(x.containment, y.containment, z.containment), greatest(x.run, y.run, z.run), least(x.fidelity, y.fidelity, z.fidelity) DESC, x.words + y.words + z.words, x.template DESC, y.template DESC, z.template DESC) AS k
    FROM c x JOIN c y ON x.source = y.source JOIN c z ON x.source = z.source WHERE x.slot = 1 AND y.slot = 2 AND z.slot = 3 AND x.template <> y.template AND x.template <> z.template AND y.template <> z.template AND x.opening <> y.opening AND x.opening <> z.opening AND y.opening <> z.opening AND NOT (x.auxiliary = y.auxiliary AND y.auxiliary = z.auxiliary))
    SELECT source, unnest([p1, p2, p3]) AS pair, unnest([t1, t2, t3]) AS template FROM j WHERE k = 1""",
)
def diverse_choice(t):
    first = t("orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("k <= 3")
    rows = first.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("pair"), F.explode(F.array(*map(F.lit, range(3)))).alias("t"))
    made = {"template": "concat('t', (pair + t * 3) % 5)", "opening": "concat('o', (pair div 4 + t) % 5)", "auxiliary": "concat('a', (pair + t) % 2)", "entailment": "(pair * 7 + t * 13) % 10", "similarity": "(pair * 3 + t * 5) % 10", "containment": "(pair + t) % 6", "run": "(pair * 5 + t) % 8", "fidelity": "(pair * 11 + t) % 10", "words": "8 + (pair + t * t) % 7"}
    return selection.diverse_choice(rows.select("source", "pair", *(F.expr(e).alias(n) for n, e in made.items())))


# ---- recorded predictions: line items are predictions on orders, the return flag is the model

_LABELS = ["ORG", "PERSON", "PRODUCT", "LOCATION", "CONTRACT_TERM", "DATE"]
_DECLARED = {"1-URGENT": "DATE", "2-HIGH": "ORG", "3-MEDIUM": "PRODUCT", "4-NOT SPECIFIED": "PROJECT_NAME"}
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_SEEN = f"SELECT l_orderkey AS cand, l_returnflag AS role, {_LABELS}[l_suppkey % 6 + 1] AS label, l_partkey % 20 AS s, l_partkey % 20 + 10 AS e, round(l_discount * 10, 1) AS score FROM lineitem"
_ASKED = "SELECT o_orderkey AS cand, o_custkey % 20 AS s, o_custkey % 20 + 10 AS e, CASE " + " ".join(f"WHEN o_orderpriority = '{k}' THEN '{v}'" for k, v in _DECLARED.items()) + " ELSE 'OTHER' END AS declared, CASE WHEN o_totalprice > 450000 THEN 'ORG' END AS rule FROM orders"


def _predictions(t):
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return t("lineitem").select(F.col("l_orderkey").alias("cand"), F.col("l_returnflag").alias("role"), label.alias("label"), (F.col("l_partkey") % 20).alias("start"), (F.col("l_partkey") % 20 + 10).alias("end"), F.round(F.col("l_discount") * 10, 1).alias("score"))


@query(
    "type_routing",
    f"""WITH c AS ({_ASKED}), v AS (SELECT cand, role, label FROM (SELECT p.*, row_number() OVER (PARTITION BY p.cand, p.role ORDER BY p.score DESC, p.label, p.s) AS k FROM ({_SEEN}) p JOIN c USING (cand) WHERE p.label IN {_IN(selection.MAIN_TYPES)} AND p.score >= 0.5 AND greatest(0, least(p.e, c.e) - greatest(p.s, c.s)) / 10.0 >= 0.8) WHERE k = 1),
    w AS (SELECT cand, label FROM (SELECT cand, label, row_number() OVER (PARTITION BY cand ORDER BY count(*) DESC, label) AS k FROM v GROUP BY cand, label) WHERE k = 1),
    r AS (SELECT cand, declared, rule, CASE WHEN declared IN {_IN(selection.STRUCTURED_TYPES + selection.DIAGNOSTIC_TYPES)} THEN declared ELSE coalesce(rule, label, CASE WHEN declared IN {_IN(selection.MAIN_TYPES)} THEN declared END) END AS effective FROM c LEFT JOIN w USING (cand))
    SELECT cand, declared, effective, CASE WHEN effective IS NULL THEN 'route_ambiguous' WHEN rule IS NOT NULL OR declared = effective THEN 'accepted' ELSE 'rerouted' END AS status FROM r""",
)
def type_routing(t):
    o = t("orders")
    declared = F.lit("OTHER")
    for priority, kind in _DECLARED.items():
        declared = F.when(F.col("o_orderpriority") == priority, kind).otherwise(declared)
    rows = o.select(F.col("o_orderkey").alias("cand"), (F.col("o_custkey") % 20).alias("start"), (F.col("o_custkey") % 20 + 10).alias("end"), declared.alias("declared"), F.when(F.col("o_totalprice") > 450000, "ORG").alias("rule"))
    return selection.routed(rows, _predictions(t))


@query(
    "consensus_proposals",
    f"""SELECT cand // 50 AS doc, label, s AS start, count(DISTINCT role) AS models, round(avg(score), 6) AS confidence FROM ({_SEEN}) WHERE label IN {_IN(selection.MAIN_TYPES)} AND score >= CASE WHEN label = 'ORG' THEN 0.4 ELSE 0.2 END
    AND (cand // 50, label, s) NOT IN (SELECT (cand // 50, label, s) FROM ({_SEEN}) WHERE score >= 1) GROUP BY 1, 2, 3 HAVING count(DISTINCT role) >= 2""",
)
def consensus_proposals(t):
    """Predictions of the highest score stand for the candidates that are there already."""
    rows = _predictions(t).select(F.expr("cand div 50").alias("doc"), F.col("role").alias("model"), "label", "start", "end", "score")
    found = selection.proposals(rows, rows.where("score >= 1").distinct(), F.when(F.col("label") == "ORG", 0.4).otherwise(0.2))
    return found.drop("end")


# ---- gates over variants

@query(
    "chunk_config_ranking",
    """WITH m AS (SELECT l_returnflag || l_linestatus AS config, l_linenumber AS dataset, avg(l_discount) AS recall, avg(l_tax) AS mrr, max(l_quantity) AS p95 FROM lineitem GROUP BY 1, 2)
    SELECT config, round(avg(recall), 6) AS macro_recall, round(avg(mrr), 6) AS macro_mrr, avg(p95) AS macro_p95, row_number() OVER (ORDER BY round(avg(recall), 6) DESC, round(avg(mrr), 6) DESC, avg(p95), config) AS place FROM m GROUP BY config HAVING bool_and(recall >= 0.045)""",
)
def chunk_config_ranking(t):
    """Configurations that pass on every dataset, by macro recall, reciprocal rank, then latency."""
    m = t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("config"), "l_linenumber").agg(F.avg("l_discount").alias("recall"), F.avg("l_tax").alias("mrr"), F.max("l_quantity").alias("p95"))
    each = m.groupBy("config").agg(F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("mrr"), 6).alias("macro_mrr"), F.avg("p95").alias("macro_p95"), F.bool_and(F.col("recall") >= 0.045).alias("passed"))
    place = F.row_number().over(Window.orderBy(F.desc("macro_recall"), F.desc("macro_mrr"), "macro_p95", "config"))  # over configurations
    return each.where("passed").drop("passed").withColumn("place", place)


@query(
    "direction_verdict",
    f"""WITH a AS ({q_evaluation.ORACLE["auc_by_feature"]}), v AS (SELECT max(auc) FILTER (WHERE feature = 'n_chars') AS auc, max(auc) FILTER (WHERE feature = 'digits') AS base, max(separability) FILTER (WHERE feature = 'upper') AS best FROM a),
    o AS (SELECT count(*) AS shared FROM (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 INTERSECT SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0))
    SELECT auc > 0.6 AS separates, base <= 0.6 AS baseline_flat, auc - base > 0.05 AS gains, best < auc - 0.02 AS no_shortcut, shared = 0 AS no_leak, CASE WHEN auc IS NULL OR base IS NULL THEN 'unknown' WHEN auc > 0.6 AND base <= 0.6 AND auc - base > 0.05 AND coalesce(best < auc - 0.02, true) AND shared = 0 THEN 'go' ELSE 'no_go' END AS direction FROM v, o""",
)
def direction_verdict(t):
    of = lambda n, c: F.max(F.when(F.col("feature") == n, F.col(c)))
    v = q_evaluation.auc_by_feature(t).agg(of("n_chars", "auc").alias("auc"), of("digits", "auc").alias("base"), of("upper", "separability").alias("best"))
    both = t("documents").join(t("labels"), "doc_id").groupBy("source").agg(F.count_distinct("quality").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared"))
    rules = selection.verdict(F.col("auc"), F.col("base"), F.col("best"), F.col("shared"))
    return v.crossJoin(F.broadcast(both)).select(*(c.alias(n) for n, c in rules.items()))  # one row each


_DEFENDED = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS stance, value > 60 AS corrects, value < 20 AS refuses, event_id % 11 <> 0 AS parsed FROM events WHERE event_id % 10 <> 0"


@query(
    "defense_utility",
    f"""SELECT round(avg(CAST(o.event_type = d.stance AS INT)), 6) AS stance_kept, round(avg(CAST(parsed AS INT)), 6) AS available, round(avg(CAST(corrects AS INT)), 6) AS corrected, round(avg(CAST(corrects AS INT) - CAST(o.value > 50 AS INT)), 6) AS correction_change, round(avg(CAST(refuses AS INT) - CAST(o.value < 10 AS INT)), 6) AS refusal_change, count(*) AS matched
    FROM events o JOIN ({_DEFENDED}) d USING (event_id)""",
)
def defense_utility(t):
    """Rates over the answers that are there with and without the defence."""
    e = t("events")
    d = e.where("event_id % 10 <> 0").select("event_id", F.expr("CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END").alias("stance"), (F.col("value") > 60).alias("corrects"), (F.col("value") < 20).alias("refuses"), (F.col("event_id") % 11 != 0).alias("parsed"))
    share = lambda c: F.round(F.avg(c), 6)
    i = lambda c: c.cast("int")
    return e.join(d, "event_id").agg(
        share(i(F.col("event_type").eqNullSafe(F.col("stance")))).alias("stance_kept"), share(i(F.col("parsed"))).alias("available"), share(i(F.col("corrects"))).alias("corrected"),
        share(i(F.col("corrects")) - i(F.col("value") > 50)).alias("correction_change"), share(i(F.col("refuses")) - i(F.col("value") < 10)).alias("refusal_change"), F.count("*").alias("matched"),
    )


@query(
    "rewrite_recall",
    """SELECT user_id % 3 AS dataset, event_type AS retriever, round(avg(CAST(value > 50 AS INT)) FILTER (WHERE event_id % 2 = 0), 6) AS old, round(avg(CAST(value > 50 AS INT)) FILTER (WHERE event_id % 2 = 1), 6) AS new, avg(CAST(value > 50 AS INT)) FILTER (WHERE event_id % 2 = 1) - avg(CAST(value > 50 AS INT)) FILTER (WHERE event_id % 2 = 0) < -0.02 AS dropped FROM events GROUP BY 1, 2""",
)
def rewrite_recall(t):
    """Recall of old and new questions by dataset and retriever; a drop beyond a tolerance fails."""
    rows = t("events").select((F.col("user_id") % 3).alias("dataset"), F.col("event_type").alias("retriever"), F.when(F.col("event_id") % 2 == 0, "old").otherwise("new").alias("variant"), (F.col("value") > 50).cast("int").alias("hit"))
    wide = rows.groupBy("dataset", "retriever").pivot("variant", ["old", "new"]).agg(F.avg("hit"))
    return wide.select("dataset", "retriever", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), (F.col("new") - F.col("old") < -0.02).alias("dropped"))


@query(
    "population_projection",
    """SELECT status, count(*) AS pilot, count(*) FILTER (WHERE n = 3) AS eligible, round(count(*) FILTER (WHERE n = 3) / count(*), 6) AS rate, round(count(*) FILTER (WHERE n = 3) / count(*) * (SELECT count(*) FROM customer), 4) AS projected
    FROM (SELECT o_orderstatus AS status, o_custkey, least(3, count(*) FILTER (WHERE o_totalprice > 200000)) AS n FROM orders GROUP BY 1, 2) GROUP BY status""",
)
def population_projection(t):
    """Sources with all three places filled, as a rate of those tried, times the pool."""
    each = t("orders").groupBy(F.col("o_orderstatus").alias("status"), "o_custkey").agg(F.least(F.lit(3), F.count_if(F.col("o_totalprice") > 200000)).alias("n"))
    rates = each.groupBy("status").agg(F.count("*").alias("pilot"), F.count_if(F.col("n") == 3).alias("eligible"))
    pool = t("customer").agg(F.count("*").alias("pool"))
    rate = F.col("eligible") / F.col("pilot")
    return rates.crossJoin(F.broadcast(pool)).select("status", "pilot", "eligible", F.round(rate, 6).alias("rate"), F.round(rate * F.col("pool"), 4).alias("projected"))


@query(
    "answered_questions",
    """SELECT conv_id, turn, k FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, sha256(text), turn) AS k FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user' AND answer IS NOT NULL AND NOT regexp_matches(answer, '(?i)i (?:do not|don.t) know|que ')) WHERE k <= 5""",
)
def answered_questions(t):
    """The five questions of most relevance whose recorded answer says something."""
    rows = t("conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    told = rows.where((F.col("role") == "user") & F.col("answer").isNotNull() & ~F.col("answer").rlike("(?i)i (?:do not|don.t) know|que "))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), F.sha2("text", 256), "turn"))
    return told.withColumn("k", k).where("k <= 5").select("conv_id", "turn", "k")


@query(
    "pilot_metrics",
    """WITH q AS (SELECT o_orderkey AS id, o_orderstatus AS grp FROM orders WHERE o_orderkey % 9 <> 0), r AS (SELECT l_orderkey AS id, l_returnflag <> 'R' AS valid, l_linestatus = 'F' AS parseable, l_suppkey % 2 = 0 AS useful, l_partkey % 3 = 0 AS hit FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 8 <> 0)
    SELECT grp, count(DISTINCT q.id) AS expected, count(r.id) AS n_rows, count(r.id) - count(DISTINCT r.id) AS repeated, count(DISTINCT q.id) FILTER (WHERE r.id IS NULL) AS missing, round(count(*) FILTER (WHERE valid) / greatest(1, count(DISTINCT q.id)), 6) AS completeness, round(count(*) FILTER (WHERE valid AND parseable) / greatest(1, count(*) FILTER (WHERE valid)), 6) AS parse_rate,
    round(count(*) FILTER (WHERE valid AND useful) / greatest(1, count(*) FILTER (WHERE valid)), 6) AS useful_rate, round(count(*) FILTER (WHERE valid AND hit) / greatest(1, count(*) FILTER (WHERE valid)), 6) AS recall_5, count(*) FILTER (WHERE valid AND parseable) / greatest(1, count(*) FILTER (WHERE valid)) >= 0.45 AS passed FROM q LEFT JOIN r USING (id) GROUP BY grp""",
)
def pilot_metrics(t):
    """Responses against the questions that were planned, by group; the gate is on the share that can be parsed."""
    q = t("orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("grp"))
    made = {"valid": "l_returnflag <> 'R'", "parseable": "l_linestatus = 'F'", "useful": "l_suppkey % 2 = 0", "hit": "l_partkey % 3 = 0"}
    r = t("lineitem").where("l_linenumber = 1 AND l_orderkey % 8 <> 0").select(F.col("l_orderkey").alias("id"), *(F.expr(e).alias(n) for n, e in made.items()))
    # counts by question first, so that no distinct count is left
    each = r.groupBy("id").agg(F.count("*").alias("rows"), *(F.count_if(F.col("valid") & F.col(n)).alias(n) for n in made))
    by = q.distinct().join(each, "id", "left").groupBy("grp").agg(F.count("*").alias("expected"), F.count_if(F.col("rows").isNull()).alias("missing"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("rows", *made)))
    share = lambda n, of="valid": F.col(n) / F.greatest(F.lit(1), F.col(of))
    return by.select(
        "grp", "expected", F.col("rows").alias("n_rows"), (F.col("rows") - F.col("expected") + F.col("missing")).alias("repeated"), "missing", F.round(share("valid", "expected"), 6).alias("completeness"),
        F.round(share("parseable"), 6).alias("parse_rate"), F.round(share("useful"), 6).alias("useful_rate"), F.round(share("hit"), 6).alias("recall_5"), (share("parseable") >= 0.45).alias("passed"),
    )


# ---- dense retrieval

@query(
    "target_context",
    """SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings d ON d.label = q.label WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)) WHERE rank <= 5""",
)
def target_context(t):
    """The five best rows of the query's own target; a hot target is split by rows, since the queries are broadcast."""
    q = t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("target"))
    own = retrieval.dense(t("embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label"), q, within=F.col("label") == F.col("target"))
    return retrieval.top(own.where("query <> doc"), 5)


_PICK = "SELECT query, excluded, w1, w2, w3, {took}, d.doc_id AS c{i}, d.n_chars AS t{i} FROM ({x}) q JOIN documents d ON d.source <> q.excluded AND d.doc_id NOT IN ({used}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY abs(d.n_chars - q.w{i}), d.doc_id) = 1"
_ONE = _PICK.format(i=1, took="1 AS one", used="-1", x="SELECT doc_id AS query, source AS excluded, n_chars + 90 AS w1, (n_chars + 14) // 2 AS w2, n_chars // 3 AS w3 FROM documents WHERE doc_id % 50 = 0")
_TWO = _PICK.format(i=2, took="c1, t1", used="q.c1", x=_ONE)
_THREE = _PICK.format(i=3, took="c1, t1, c2, t2", used="q.c1, q.c2", x=_TWO)


@query("matched_context", f"SELECT query, unnest([1, 2, 3]) AS slot, unnest([c1, c2, c3]) AS chunk, unnest([t1, t2, t3]) AS tokens, abs(t1 + t2 + t3 - w1 - w2 - w3) / greatest(1, w1 + w2 + w3) <= 0.05 AS within FROM ({_THREE})")
def matched_context(t):
    """Three documents of other sources, as long as three given lengths."""
    d = t("documents")
    sizes = F.posexplode(F.array(F.col("n_chars") + 90, F.expr("(n_chars + 14) div 2"), F.expr("n_chars div 3"))).alias("slot", "wanted")
    targets = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.array("source").alias("excluded"), sizes).withColumn("slot", F.col("slot") + 1)
    return selection.matched(d.select(F.col("doc_id").alias("chunk"), "source", F.col("n_chars").alias("tokens")), targets, 3)


_BINS = "SELECT {k} AS id, ('0x' || substr(sha256(term), 1, 2))::INT % 64 AS b, count(*) AS c FROM (SELECT {k}, unnest({x}) AS term FROM {t}) GROUP BY 1, 2"
_UNIT = "SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM ({x})"


@query(
    "hybrid_dense",
    f"""{BM25}, dv AS ({_UNIT.format(x=_BINS.format(k="doc_id", x=TERMS.format(t="text"), t="documents"))}), qv AS ({_UNIT.format(x=_BINS.format(k="item_id", x=TERMS.format(t="text"), t="benchmark"))}),
    e AS (SELECT qv.id AS query, dv.id AS doc, round(sum(dv.w * qv.w), 6) AS score FROM dv JOIN qv USING (b) GROUP BY 1, 2), n AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM e),
    u AS (SELECT query, doc, rank FROM r WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM n WHERE rank <= 20), f2 AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY query, doc)
    SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f2) WHERE rank <= 5""",
)
def hybrid_dense(t):
    """BM25 and inner products of unit vectors, 20 best each, fused by reciprocal rank; vectors come from a plug-in."""
    vectors = retrieval.embed(t("documents").select(F.col("doc_id").alias("doc"), "text"), "doc", "v")
    asks = retrieval.embed(asked(t), "query", "q")
    dense = retrieval.dense(vectors, asks).where("score > 0")
    return retrieval.top(retrieval.fuse([retrieval.top(retrieval.bm25(t("documents"), asked(t)), 20), retrieval.top(dense, 20)]), 5)
