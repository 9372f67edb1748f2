"""Queries over claims, questions and responses: gates, validators, forms (2.4, 2.6, 2.9, 2.18b)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import claims as C
from lodestone.functions import text as X
from lodestone.operators import retrieval
from lodestone.plans.q_ranking import BM25, asked
from lodestone.plans.q_text import TERMS, WORDS
from lodestone.plans.queryset import QuerySet

query = QuerySet()
QUERIES, ORACLE = query.queries, query.oracle

_q = lambda p: "'" + p.replace("'", "''") + "'"
_N = f"len({WORDS.format(t='text')})"
NATURAL = f"CASE WHEN {_N} = 0 THEN 0.0 ELSE round(least(1.0, CASE WHEN {_N} BETWEEN 10 AND 90 THEN 1.0 ELSE greatest(0.2, 1 - abs({_N} - 45) / 100) END * CASE WHEN regexp_matches(trim(text), '[?.]$') THEN 0.9 ELSE 0.7 END * CASE WHEN contains(text, '{{{{') OR contains(text, '```') THEN 0.6 ELSE 1.0 END), 4) END"
REASON = f"CASE WHEN regexp_matches(text, {_q(C.DANGEROUS)}) THEN 'dangerous' WHEN regexp_matches(text, {_q(C.INJECTION)}) THEN 'injection' WHEN regexp_matches(text, {_q(C.PROBE)}) THEN 'context_probe' WHEN {NATURAL} < 0.5 THEN 'unnatural' END"


@query("naturalness", f"SELECT conv_id, turn, CAST({NATURAL} AS DOUBLE) AS naturalness FROM conversations")
def naturalness(t):
    return t("conversations").select("conv_id", "turn", C.naturalness(F.col("text")).alias("naturalness"))


_GRAM = "list_transform(range(1, len({x}) - 3), lambda i: array_to_string({x}[i:i + 4], ' '))"
_COPIED = f"CASE WHEN p IS NULL OR len(k) < 5 THEN 0.0 ELSE len(list_filter({_GRAM.format(x='k')}, lambda g: list_contains({_GRAM.format(x='p')}, g))) / (len(k) - 4) END"
_RUN = "CASE WHEN p IS NULL THEN 0 ELSE coalesce(list_max(list_transform(string_split(array_to_string(list_transform(k, lambda x: CASE WHEN list_contains(p, x) THEN '1' ELSE '0' END), ''), '0'), lambda x: length(x))), 0) END"
_K = TERMS.format(t="text")
REFUSED = f"SELECT conv_id, turn, CASE WHEN reason IS NOT NULL THEN reason WHEN {_COPIED} > 0.6 THEN 'copied_ngrams' WHEN {_RUN} > 12 THEN 'copied_run' END AS reason FROM (SELECT conv_id, turn, {REASON} AS reason, {_K} AS k, lag({_K}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)"


@query("question_gate", f"SELECT *, bool_or(reason IS NOT NULL) OVER (PARTITION BY conv_id) AS pair_rejected FROM ({REFUSED})")
def question_gate(t):
    """The first reason counts; one refused question refuses its conversation. Copying is judged against the turn before."""
    rows = t("conversations").withColumn("k", X.index_terms(F.col("text"))).withColumn("p", F.lag("k").over(Window.partitionBy("conv_id").orderBy("turn")))
    told = F.col("p").isNotNull()
    copied, run = F.when(told, X.containment(F.col("k"), F.col("p"), 5)).otherwise(0.0), F.when(told, X.copied_run(F.col("p"), F.col("k"))).otherwise(0)
    rows = rows.withColumn("reason", C.gate(F.col("text"), copied, run))
    return rows.select("conv_id", "turn", "reason", F.bool_or(F.col("reason").isNotNull()).over(Window.partitionBy("conv_id")).alias("pair_rejected"))


@query("sentence_faults", """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN len(list_filter(regexp_split_to_array(f, '\\s+'), lambda w: w <> '')) < 4 THEN 'too_short' END, CASE WHEN f <> '' AND NOT regexp_matches(f, '[.!?]["'')\\]]*$') THEN 'incomplete' END, CASE WHEN len(regexp_extract_all(text, '\\n')) >= 12 THEN 'excessive_lines' END,
CASE WHEN len(regexp_extract_all(f, '(?i)https?://')) >= 3 THEN 'repeated_links' END, CASE WHEN regexp_matches(f, '(?i)<[^>]+>|&(?:lt|gt|amp|nbsp);') THEN 'markup' END, CASE WHEN (length(f) - length(replace(f, '"', ''))) % 2 = 1 THEN 'unbalanced_quote' END,
CASE WHEN length(replace(f, '(', '')) <> length(replace(f, ')', '')) OR length(replace(f, '[', '')) <> length(replace(f, ']', '')) OR length(replace(f, '{', '')) <> length(replace(f, '}', '')) THEN 'unbalanced_delimiters' END], lambda x: x IS NOT NULL), ',') AS faults
FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM conversations)""")
def sentence_faults(t):
    return t("conversations").select("conv_id", "turn", F.array_join(C.sentence_faults(F.col("text")), ",").alias("faults"))


@query("format_compatible", """SELECT s_suppkey, p_partkey, regexp_matches(s_name, '[0-9]') = regexp_matches(p_name, '[0-9]') AND regexp_matches(s_name, '(?i)^the\\s+') = regexp_matches(p_name, '(?i)^the\\s+') AND contains(s_name, ',') = contains(p_name, ',') AS compatible
FROM supplier JOIN part ON s_suppkey = p_partkey""")
def format_compatible(t):
    rows = t("supplier").join(t("part"), F.col("s_suppkey") == F.col("p_partkey"))
    return rows.select("s_suppkey", "p_partkey", C.compatible(F.col("s_name"), F.col("p_name"), F.lit("ORG")).alias("compatible"))


@query("subtype_counts", """SELECT subtype, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p_name, '[0-9]') THEN 'versioned_or_numbered_product' WHEN regexp_matches(p_name, '(?i)\\b(?:software|platform|service|suite|system)\\b') THEN 'software_or_service_product' ELSE 'named_product' END AS subtype FROM part) GROUP BY subtype""")
def subtype_counts(t):
    return t("part").groupBy(C.subtype(F.col("p_name"), F.lit("PRODUCT")).alias("subtype")).agg(F.count("*").alias("n"))


_UP = "regexp_matches({v}, '[A-Z]')"
_LOW = "regexp_matches({v}, '[a-z]')"
_STYLE = f"CASE WHEN NOT {_UP} AND NOT {_LOW} THEN 'no_letters' WHEN NOT {_LOW} THEN 'upper' WHEN NOT {_UP} THEN 'lower' WHEN len(list_filter(regexp_extract_all({{v}}, '[A-Za-z]+'), lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 THEN 'title' ELSE 'mixed' END"
_KINDS = "(VALUES ('PERSON'), ('ORG'), ('LOCATION'), ('PRODUCT'), ('PROJECT_NAME'), ('CONTRACT_TERM'), ('MONEY')) k(kind)"
_NAMED = "(SELECT trim(c_name) AS v FROM customer UNION ALL SELECT trim(p_name) FROM part UNION ALL SELECT trim(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN ', Ministry' ELSE ' Inc. plan' END FROM nation UNION ALL SELECT 'the ' || lower(n_name) || ' agreement' FROM nation UNION ALL SELECT n_name FROM nation)"


def _named(t):
    nation = t("nation")
    held = [
        t("customer").select(F.trim("c_name").alias("v")), t("part").select(F.trim("p_name")), nation.select(F.concat(F.trim("n_name"), F.when(F.col("n_nationkey") % 2 == 0, ", Ministry").otherwise(" Inc. plan"))),
        nation.select(F.concat(F.lit("the "), F.lower("n_name"), F.lit(" agreement"))), nation.select("n_name"),
    ]
    rows = held[0]
    for x in held[1:]:
        rows = rows.union(x)
    return rows.withColumn("kind", F.explode(F.array(*(F.lit(k) for k in [*C.SUBTYPES, "MONEY"]))))


@query("subtypes_by_kind", f"""SELECT kind, subtype, count(*) AS n FROM (SELECT kind, CASE kind
WHEN 'PERSON' THEN CASE WHEN regexp_matches(v, '\\b[A-Z]\\.') THEN 'initialed_person_name' WHEN regexp_matches(v, '(?i)^(dr|mr|mrs|ms|prof)\\.?\\s') THEN 'titled_person_name' WHEN len(string_split_regex(v, '\\s+')) = 1 THEN 'single_person_name' ELSE 'multi_token_person_name' END
WHEN 'ORG' THEN CASE WHEN regexp_matches(lower(v), '\\b(inc|corp|corporation|llc|ltd|limited|plc|co)\\b') THEN 'corporate_organization' WHEN regexp_matches(lower(v), '\\b(university|college|institute|laboratory|laboratories|hospital)\\b') THEN 'academic_or_medical_organization'
WHEN regexp_matches(lower(v), '\\b(ministry|department|commission|agency|authority|council)\\b') THEN 'government_organization' ELSE 'named_organization' END
WHEN 'LOCATION' THEN CASE WHEN contains(v, ',') THEN 'compound_geographic_location' WHEN lower(v) LIKE 'the %' THEN 'definite_article_location' ELSE 'named_geographic_location' END
WHEN 'PRODUCT' THEN CASE WHEN regexp_matches(v, '[0-9]') THEN 'versioned_or_numbered_product' WHEN regexp_matches(lower(v), '\\b(software|platform|service|suite|system)\\b') THEN 'software_or_service_product' ELSE 'named_product' END
WHEN 'PROJECT_NAME' THEN CASE WHEN {_STYLE.format(v="v")} = 'upper' AND length(v) <= 16 THEN 'acronym_project_name' ELSE 'titled_project_name' END
WHEN 'CONTRACT_TERM' THEN CASE WHEN regexp_matches(lower(v), '\\b(agreement|contract|lease|license|licence)\\b') THEN 'named_agreement' WHEN regexp_matches(lower(v), '\\b(plan|policy)\\b') THEN 'contractual_plan_or_policy' ELSE 'defined_contract_term' END
ELSE lower(kind) END AS subtype FROM {_NAMED}, {_KINDS}) GROUP BY kind, subtype""")
def subtypes_by_kind(t):
    return _named(t).groupBy("kind", C.subtype(F.col("v"), F.col("kind")).alias("subtype")).agg(F.count("*").alias("n"))


@query("forms_by_kind", f"""SELECT s_suppkey, kind, regexp_matches(a, '[0-9]') = regexp_matches(b, '[0-9]') AND (lower(a) LIKE 'the %') = (lower(b) LIKE 'the %') AND CASE kind WHEN 'PERSON' THEN contains(a, '.') = contains(b, '.') WHEN 'ORG' THEN contains(a, ',') = contains(b, ',') WHEN 'LOCATION' THEN contains(a, ',') = contains(b, ',')
WHEN 'PRODUCT' THEN {_STYLE.format(v="a")} = {_STYLE.format(v="b")} WHEN 'PROJECT_NAME' THEN {_STYLE.format(v="a")} = {_STYLE.format(v="b")} ELSE true END AS compatible
FROM (SELECT s_suppkey, s_name AS a, CASE s_suppkey % 5 WHEN 0 THEN upper(s_name) WHEN 1 THEN lower(s_name) || '.' WHEN 2 THEN 'the ' || s_name WHEN 3 THEN 'Some, other' ELSE 'Some Name 7' END AS b FROM supplier), {_KINDS}""")
def forms_by_kind(t):
    k = F.col("s_suppkey") % 5
    b = F.when(k == 0, F.upper("s_name")).when(k == 1, F.concat(F.lower("s_name"), F.lit("."))).when(k == 2, F.concat(F.lit("the "), F.col("s_name"))).when(k == 3, "Some, other").otherwise("Some Name 7")
    rows = t("supplier").select("s_suppkey", F.col("s_name").alias("a"), b.alias("b"), F.explode(F.array(*(F.lit(x) for x in [*C.SUBTYPES, "MONEY"]))).alias("kind"))
    return rows.select("s_suppkey", "kind", C.compatible(F.col("a"), F.col("b"), F.col("kind")).alias("compatible"))


@query("claim_pair_faults", """WITH c AS (SELECT item_id, text AS a, regexp_extract(text, '[A-Za-z]{4,}') AS o, CASE WHEN item_id % 3 = 0 THEN regexp_extract(text, '[A-Za-z]{4,}') ELSE 'Replacement' END AS r FROM benchmark), p AS (SELECT *, replace(a, o, r) || CASE WHEN item_id % 5 = 0 THEN ' More.' ELSE '' END AS b FROM c WHERE o <> '')
SELECT item_id, array_to_string(list_filter([CASE WHEN lower(o) = lower(r) THEN 'same_value' END, CASE WHEN (length(a) - length(replace(a, o, ''))) / length(o) <> 1 THEN 'original_not_once' END, CASE WHEN (length(b) - length(replace(b, r, ''))) / length(r) <> 1 THEN 'other_not_once' END,
CASE WHEN replace(a, o, '{ENTITY}') <> replace(b, r, '{ENTITY}') THEN 'differs_elsewhere' END, CASE WHEN greatest(length(a), length(b)) > 400 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS faults FROM p""")
def claim_pair_faults(t):
    rows = t("benchmark").withColumn("o", F.regexp_extract("text", "[A-Za-z]{4,}", 0)).where("o <> ''").withColumn("r", F.when(F.col("item_id") % 3 == 0, F.col("o")).otherwise("Replacement"))
    rows = rows.withColumn("b", F.concat(F.replace("text", "o", "r"), F.when(F.col("item_id") % 5 == 0, " More.").otherwise("")))
    return rows.select("item_id", F.array_join(C.pair_faults(F.col("text"), F.col("b"), F.col("o"), F.col("r")), ",").alias("faults"))


@query("response_success", f"SELECT conv_id, turn, length(trim(text)) > 0 AND NOT regexp_matches(trim(text), {_q(C.ERROR_START)}) AND turn % 7 <> 3 AS success FROM conversations")
def response_success(t):
    model = F.when(F.col("turn") % 7 == 3, "other").otherwise("expected")
    return t("conversations").select("conv_id", "turn", C.is_success(F.col("conv_id"), F.col("text"), F.lit(None).cast("string"), model, F.lit("expected")).alias("success"))


@query("entailment_rate", "SELECT lang, round(avg(CAST(a > greatest(b, c) AS INT)), 6) AS rate FROM (SELECT lang, doc_id % 7 / 7.0 AS a, doc_id % 5 / 5.0 AS b, doc_id % 3 / 3.0 AS c FROM documents) GROUP BY lang")
def entailment_rate(t):
    p = lambda k: F.col("doc_id") % k / float(k)
    return t("documents").groupBy("lang").agg(F.round(F.avg(C.entails(p(7), p(5), p(3)).cast("int")), 6).alias("rate"))


@query("retrieval_gate", f"""{BM25}, rel AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)), h AS (SELECT query, min(rank) AS rank FROM r JOIN rel USING (query, doc) WHERE rank <= 10 GROUP BY query),
m AS (SELECT avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS r5, avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS r10, count(*) FILTER (WHERE rank IS NULL) / count(*) AS z FROM (SELECT DISTINCT item_id AS query FROM benchmark) LEFT JOIN h USING (query)) SELECT r5 >= 0.7 AS recall_5_ok, r10 >= 0.8 AS recall_10_ok, z <= 0.05 AS zero_hit_ok, r5 >= 0.7 AND r10 >= 0.8 AND z <= 0.05 AS passed FROM m""")
def retrieval_gate(t):
    hits = retrieval.top(retrieval.bm25(t("documents"), asked(t)), 10)
    texts = hits.select("query", "doc").join(t("documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("d")), "doc").join(t("benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("b")), "query")
    m = retrieval.evaluate(hits, texts.where(F.contains("d", "b")).select("query", "doc"), asked(t))
    a, b, c = F.col("recall_5") >= 0.7, F.col("recall_10") >= 0.8, F.col("without_hit") / F.col("n_queries") <= 0.05
    return m.select(a.alias("recall_5_ok"), b.alias("recall_10_ok"), c.alias("zero_hit_ok"), (a & b & c).alias("passed"))


@query("source_specific_terms", """WITH k AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM k GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, count(*) FILTER (WHERE df * 100 <= n) AS anchors FROM k JOIN f USING (term), n GROUP BY doc_id""")
def source_specific_terms(t):
    """Terms of a document that at most one in a hundred documents holds."""
    k = t("documents").select("doc_id", F.explode(F.array_distinct(X.index_terms(F.col("text")))).alias("term"))
    f = k.groupBy("term").agg(F.count("*").alias("df"))
    n = t("documents").agg(F.count("*").alias("n"))
    return k.join(f, "term").crossJoin(F.broadcast(n)).groupBy("doc_id").agg(F.count_if(F.col("df") * 100 <= F.col("n")).alias("anchors"))


@query("recoverable_facts", "SELECT l_suppkey, l_linenumber, count(DISTINCT l_partkey) = 1 AS recoverable, count(DISTINCT l_partkey) AS fillers FROM lineitem GROUP BY l_suppkey, l_linenumber")
def recoverable_facts(t):
    """A fact is recoverable if its relation has one filler only."""
    n = F.count_distinct("l_partkey")
    return t("lineitem").groupBy("l_suppkey", "l_linenumber").agg((n == 1).alias("recoverable"), n.alias("fillers"))


@query("packet_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) <> 3 THEN 'fail' WHEN l_quantity > 45 THEN 'fail' WHEN l_discount > 0.08 THEN 'uncertain' ELSE 'pass' END AS label, l_extendedprice FROM lineitem")
def packet_labels(t):
    """A source without exactly three rows fails whole."""
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    label = F.when((n != 3) | (F.col("l_quantity") > 45), "fail").when(F.col("l_discount") > 0.08, "uncertain").otherwise("pass")
    return t("lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), "l_extendedprice")
