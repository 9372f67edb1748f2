"""Queries that need functions on Arrow batches (parts of 2.3 to 2.5, 2.13, 2.16). SQL has no form for them; tests hold goldens."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import entities, textudf
from lodestone.plans.queryset import QuerySet

query = QuerySet()
QUERIES, ORACLE = query.queries, query.oracle


@query("paragraph_chunks")
def paragraph_chunks(t):
    rows = t("documents").select("doc_id", F.posexplode(textudf.chunk_list("text")).alias("i", "chunk"))
    return rows.select(F.format_string("%d::chunk_%04d", "doc_id", "i").alias("chunk_id"), F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("text_sha256"))


@query("html_unescaped_clean")
def html_unescaped_clean(t):
    return t("pages").select("page_id", X.tidy(textudf.unescape("html")).alias("c")).select("page_id", F.length("c").alias("chars"), F.sha2("c", 256).alias("clean_sha256"))


@query("canonical_keys", "SELECT url, lower(trim(url)) AS key, count(*) AS n FROM pages GROUP BY url")
def canonical_keys(t):
    """URLs are ASCII here, for which case folding is lower case; tests hold the Unicode cases."""
    return t("pages").groupBy("url").agg(F.count("*").alias("n")).select("url", textudf.canonical_key("url").alias("key"), "n")


@query("masked_tokens")
def masked_tokens(t):
    return t("benchmark").select("item_id", F.size(textudf.token_list("text")).alias("n_tokens"))


@query("sentence_spans")
def sentence_spans(t):
    return t("documents").select("doc_id", F.explode(textudf.proposition_list("text")).alias("p")).select("doc_id", "p.start", "p.end", F.sha2("p.text", 256).alias("sha256"))


def _turns(t):
    return t("conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev IS NOT NULL")


@query("lexical_copy_turns")
def lexical_copy_turns(t):
    return _turns(t).select("conv_id", "turn", textudf.common_run_of("prev", "text").alias("run"), textudf.bleu_of("prev", "text").alias("bleu"), textudf.sequence_ratio("prev", "text").alias("ratio"))


@query("entity_extract")
def entity_extract(t):
    return entities.extract(t("documents"), "doc_id", "text")


@query("counterfactual_pairs")
def counterfactual_pairs(t):
    """Each entity with a changed value of the same form, where the sentence differs in it alone."""
    rows = t("documents").select("doc_id", "text", F.explode(entities.entity_spans("text")).alias("e")).select("doc_id", "text", "e.type", "e.start", "e.end", F.col("e.text").alias("original"))
    rows = rows.withColumn("counterfactual", entities.changed_value("original", "type")).where("counterfactual <> original")
    claim = lambda value: F.concat(F.substr("text", F.greatest(F.lit(1), F.col("start") - 39), F.least(F.lit(40), F.col("start"))), value, F.substr("text", F.col("end") + 1, F.lit(40)))
    return rows.select("doc_id", "type", "original", "counterfactual", claim(F.col("original")).alias("true_claim"), claim(F.col("counterfactual")).alias("counterfactual_claim"))


@query("strict_event_objects", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def strict_event_objects(t):
    return t("events").select("event_id", F.get_json_object(textudf.strict_json("props"), "$.k").alias("k"))


@query("blind_order")
def blind_order(t):
    ids = t("documents").select("source").distinct().withColumn("blind_id", textudf.blind_id(b"a secret of the audit")("source"))
    return ids.select("blind_id", F.row_number().over(Window.orderBy("blind_id")).alias("place"))
