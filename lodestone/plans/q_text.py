"""Queries over texts: cleaning, tokens, entity signals, filters, chunks (2.3 to 2.6)."""

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.plans.queryset import QuerySet

query = QuerySet()
QUERIES, ORACLE = query.queries, query.oracle


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _replace_all(expr: str, steps) -> str:
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, {_quoted(pattern)}, {by}, 'g')"
    return expr


_TIDY = [(X.TAG, "' '"), (X.CONTROL, "' '"), ("[\\x{00a0}\\x{feff}]", "' '"), ("[ \\t\\r\\f\\x0b]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\s+|\\s+$", "''")]
WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '\\s+'), lambda w: w <> '')"
TERMS = "regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+')"
# a word's edge is one of letters of any script; RE2 knows ASCII letters only, so that others are put as underscores
ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"
COUNTS = {n: f"len(regexp_extract_all({ASCII}, {_quoted(p)}))" for n, p in X.ENTITIES.items()}
_DEFINITE = " + ".join(c for n, c in COUNTS.items() if n != "numeric")
COUNT = f"CASE WHEN {_DEFINITE} > 0 THEN {_DEFINITE} ELSE {COUNTS['numeric']} END"
DENSITY = f"round(({COUNT}) / greatest(1, len({WORDS.format(t='text')})), 6)"
LINES = "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: lower(trim(x))), lambda x: x <> '')"
TEMPLATE = f"(len({WORDS.format(t='text')}) = 0 OR (regexp_matches(text, {_quoted(X.TEMPLATE)}) AND ({COUNT}) < 2) OR (len({LINES}) >= 6 AND (len({LINES}) - len(list_distinct({LINES}))) / greatest(len({LINES}), 1) > 0.4))"


@query("doc_clean_stats", f"SELECT doc_id, length(c) AS clean_chars, sha256(c) AS clean_sha256 FROM (SELECT doc_id, {_replace_all('text', _TIDY)} AS c FROM documents)")
def doc_clean_stats(t):
    return t("documents").select("doc_id", X.tidy(F.col("text")).alias("c")).select("doc_id", F.length("c").cast("long").alias("clean_chars"), F.sha2("c", 256).alias("clean_sha256"))


@query("page_html_clean", f"SELECT page_id, length(c) AS clean_chars, sha256(c) AS clean_sha256 FROM (SELECT page_id, {_replace_all('html', _TIDY)} AS c FROM pages)")
def page_html_clean(t):
    return t("pages").select("page_id", X.tidy(F.col("html")).alias("c")).select("page_id", F.length("c").cast("long").alias("clean_chars"), F.sha2("c", 256).alias("clean_sha256"))


@query(
    "mail_clean",
    f"SELECT conv_id, turn, sha256({_replace_all('m', [(X.FORWARDED, chr(39) + ' ' + chr(39)), (X.MAIL_HEADER, chr(39) + ' ' + chr(39)), (X.SIGNATURE, chr(39) + ' ' + chr(39)), *_TIDY])}) AS body_sha256 "
    "FROM (SELECT conv_id, turn, 'From: ' || role || chr(10) || 'X-Id: ' || conv_id || chr(10) || text || chr(10) || '-- ' || chr(10) || role AS m FROM conversations)",
)
def mail_clean(t):
    nl = F.lit("\n")
    mail = F.concat(F.lit("From: "), "role", nl, F.lit("X-Id: "), F.col("conv_id").cast("string"), nl, "text", nl, F.lit("-- "), nl, "role")
    return t("conversations").select("conv_id", "turn", F.sha2(X.clean_mail(mail), 256).alias("body_sha256"))


@query(
    "article_clean",
    f"SELECT doc_id, sha256({_replace_all('a', [(X.REFERENCES, chr(39) + ' ' + chr(39)), (X.STOCK_PHRASES, chr(39) + ' ' + chr(39)), *_TIDY])}) AS body_sha256 "
    "FROM (SELECT doc_id, text || ' More research is needed.' || chr(10) || 'References' || chr(10) || source AS a FROM documents)",
)
def article_clean(t):
    article = F.concat("text", F.lit(" More research is needed.\nReferences\n"), "source")
    return t("documents").select("doc_id", F.sha2(X.clean_article(article), 256).alias("body_sha256"))


@query(
    "text_keys",
    f"SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'))) AS key_sha256, substr(sha256(text), 1, 12) AS short_hash, len({TERMS.format(t='text')}) AS n_terms, "
    f"len(list_filter({TERMS.format(t='text')}, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains({X.STOPWORDS}, x))) AS n_content_terms FROM documents",
)
def text_keys(t):
    c = F.col("text")
    return t("documents").select(
        "doc_id", F.sha2(X.flat(c), 256).alias("key_sha256"), F.substring(F.sha2(c, 256), 1, 12).alias("short_hash"),
        F.size(X.index_terms(c)).cast("long").alias("n_terms"), F.size(X.content_terms(c)).cast("long").alias("n_content_terms"),
    )


@query("entity_signal_counts", "SELECT doc_id, " + ", ".join(f"{c} AS n_{n}" for n, c in COUNTS.items()) + " FROM documents")
def entity_signal_counts(t):
    return t("documents").select("doc_id", *(c.cast("long").alias(f"n_{n}") for n, c in X.entity_counts(F.col("text")).items()))


@query("entity_signals", "SELECT doc_id, " + ", ".join(f"{c} > 0 AS has_{n}" for n, c in COUNTS.items()) + " FROM documents")
def entity_signals(t):
    return t("documents").select("doc_id", *(F.col("text").rlike(p).alias(f"has_{n}") for n, p in X.ENTITIES.items()))


@query("entity_density", f"SELECT doc_id, ({COUNT}) AS entity_count, {DENSITY} AS entity_density FROM documents")
def entity_density(t):
    n = X.perturbable(X.entity_counts(F.col("text")))
    return t("documents").select("doc_id", n.cast("long").alias("entity_count"), X.density(n, F.col("text")).alias("entity_density"))


@query("template_like", f"SELECT doc_id, {TEMPLATE} AS template_like FROM documents")
def template_like(t):
    return t("documents").select("doc_id", X.is_template(F.col("text"), X.perturbable(X.entity_counts(F.col("text")))).alias("template_like"))


_REASON = f"CASE WHEN length(trim(text)) < 200 THEN 'too_short' WHEN length(trim(text)) > 3000 THEN 'too_long' WHEN dup > 1 THEN 'duplicate' WHEN {TEMPLATE} THEN 'template' WHEN ({COUNT}) = 0 THEN 'no_entity' ELSE 'kept' END"


def funnel(docs):
    """doc_id, reason: the first reason to drop a document, or kept. Of equal texts the first by doc_id stays."""
    from pyspark.sql import Window

    c = F.col("text")
    n = X.perturbable(X.entity_counts(c))
    size = F.length(F.trim(c))
    again = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))
    reason = F.when(size < 200, "too_short").when(size > 3000, "too_long").when(F.col("dup") > 1, "duplicate").when(X.is_template(c, n), "template").when(n == 0, "no_entity").otherwise("kept")
    return docs.withColumn("dup", again).select("doc_id", reason.alias("reason"), n.alias("entity_count"), size.alias("chars"))


@query("preprocess_cascade", f"SELECT doc_id, {_REASON} AS reason FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS dup FROM documents)")
def preprocess_cascade(t):
    return funnel(t("documents")).select("doc_id", "reason")


@query(
    "preprocess_funnel",
    f"SELECT reason, count(*) AS n, round(avg(length(trim(text))), 6) AS mean_chars, CAST(max(k) AS BIGINT) AS most_entities FROM (SELECT text, {_REASON} AS reason, ({COUNT}) AS k FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS dup FROM documents)) GROUP BY reason",
)
def preprocess_funnel(t):
    return funnel(t("documents")).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.max("entity_count").cast("long").alias("most_entities"))


@query(
    "word_window_chunks",
    f"""WITH w AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, 1 + CAST(greatest(0, ceil((len(w) - 128) / 96.0)) AS BIGINT))) AS i FROM w WHERE len(w) > 0)
    SELECT doc_id || '::chunk_' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, len(w[i * 96 + 1 : i * 96 + 128]) AS n_words, sha256(array_to_string(w[i * 96 + 1 : i * 96 + 128], ' ')) AS text_sha256 FROM s""",
)
def word_window_chunks(t):
    chunks = t("documents").select("doc_id", F.posexplode(X.word_windows(F.col("text"), 128, 32)).alias("i", "chunk"))
    return chunks.select(F.format_string("%d::chunk_%04d", "doc_id", "i").alias("chunk_id"), F.size(F.split("chunk", " ")).cast("long").alias("n_words"), F.sha2("chunk", 256).alias("text_sha256"))


SHINGLES = "CASE WHEN len(k) = 0 THEN [] WHEN len(k) < 5 THEN [array_to_string(k, ' ')] ELSE list_distinct(list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i : i + 4], ' '))) END"


@query("shingles5", f"SELECT doc_id, len(s) AS n_shingles, list_min(s) AS least, list_max(s) AS greatest FROM (SELECT doc_id, {SHINGLES} AS s FROM (SELECT doc_id, {TERMS.format(t='text')} AS k FROM documents))")
def shingles5(t):
    s = t("documents").select("doc_id", X.index_terms(F.col("text")).alias("k")).select("doc_id", X.shingles(F.col("k")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.array_min("s").alias("least"), F.array_max("s").alias("greatest"))


@query("length_range", "SELECT doc_id FROM documents WHERE length(trim(text)) BETWEEN 200 AND 3000")
def length_range(t):
    return t("documents").where(F.length(F.trim("text")).between(200, 3000)).select("doc_id")


@query("minimum_entities", f"SELECT doc_id, ({COUNT}) >= 1 AS has_entity, ({COUNT}) >= 2 AS has_two FROM documents")
def minimum_entities(t):
    n = X.perturbable(X.entity_counts(F.col("text")))
    return t("documents").select("doc_id", (n >= 1).alias("has_entity"), (n >= 2).alias("has_two"))


@query("url_user_and_slug", "SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS host, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def url_user_and_slug(t):
    return t("pages").select("page_id", X.mailbox_user(F.regexp_replace("url", "^[a-z]+://", "")).alias("host"), X.slug(F.col("url")).alias("slug"))


@query("literal_redaction", "SELECT doc_id, length(regexp_replace(text, '(?i)' || w, '[REDACTED]', 'g')) AS chars FROM (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]+') AS w FROM documents) WHERE w <> ''")
def literal_redaction(t):
    rows = t("documents").withColumn("w", F.regexp_extract("text", "[A-Za-z]+", 0)).where("w <> ''")
    return rows.select("doc_id", F.length(X.redact_literal(F.col("text"), F.col("w"))).cast("long").alias("chars"))


@query("atomic_claims")
def atomic_claims(t):
    """Look-behind has no form in the oracle's regular expressions; tests hold the golden cases."""
    return t("conversations").select("conv_id", "turn", F.posexplode(X.atomic_claims(F.col("text"))).alias("claim_no", "claim"))


@query(
    "slot_questions",
    """SELECT item_id, k AS template, CASE k WHEN 0 THEN 'Is it correct that ' || m || '?' WHEN 1 THEN 'Please verify: ' || m WHEN 2 THEN 'Which value fills {ENTITY} in: ' || m || '?' END AS question
    FROM (SELECT item_id, regexp_replace(text, '^\\S+', '{ENTITY}') AS m FROM benchmark), (SELECT unnest([0, 1, 2]) AS k)""",
)
def slot_questions(t):
    rows = t("benchmark").select("item_id", F.regexp_replace("text", "^\\S+", "{ENTITY}").alias("m"), F.explode(F.array(*map(F.lit, range(3)))).alias("template"))
    text = F.when(F.col("template") == 0, F.concat(F.lit("Is it correct that "), "m", F.lit("?"))).when(F.col("template") == 1, F.concat(F.lit("Please verify: "), "m"))
    return rows.select("item_id", "template", text.otherwise(F.concat(F.lit("Which value fills {ENTITY} in: "), "m", F.lit("?"))).alias("question"))


_TURNS = f"SELECT conv_id, turn, {TERMS.format(t='text')} AS k, lag({TERMS.format(t='text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations"


def _turns(t):
    from pyspark.sql import Window

    rows = t("conversations").select("conv_id", "turn", X.index_terms(F.col("text")).alias("k"))
    return rows.withColumn("p", F.lag("k").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p IS NOT NULL")


@query("jaccard_turns", f"SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(k, p))) = 0 THEN NULL ELSE len(list_intersect(list_distinct(k), list_distinct(p))) / len(list_distinct(list_concat(k, p))) END, 6) AS jaccard FROM ({_TURNS}) WHERE p IS NOT NULL")
def jaccard_turns(t):
    return _turns(t).select("conv_id", "turn", F.round(X.jaccard(F.col("k"), F.col("p")), 6).alias("jaccard"))


@query(
    "containment_turns",
    f"SELECT conv_id, turn, round(CASE WHEN len(k) < 2 THEN 0.0 ELSE len(list_filter(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), lambda g: list_contains(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]), g))) / (len(k) - 1) END, 6) AS containment FROM ({_TURNS}) WHERE p IS NOT NULL",
)
def containment_turns(t):
    return _turns(t).select("conv_id", "turn", F.round(X.containment(F.col("k"), F.col("p"), 2), 6).alias("containment"))


@query("copied_run_turns")
def copied_run_turns(t):
    return _turns(t).select("conv_id", "turn", X.copied_run(F.col("p"), F.col("k")).alias("run"))
