"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, ngram_join, packing, quality_classifier, quality_rules, secrets, substring, suffix_dedup, token_binary, toxicity


def base_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the patterns alone give in op1."""
    return secrets.op1_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op2, before the model's verdict."""
    return quality_rules.op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# SQL counts code points and has no places of matches: they follow from the lengths of the matches and of what lies between
_ASSIGN = "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]


def _spans(k: int, pattern: str, group: int, least: int) -> str:
    found, between = f"regexp_extract_all(t, '{pattern}')", f"regexp_split_to_array(t, '{pattern}')"
    return f"""
        SELECT rid, {k} AS k, place, place + length(m[i]) AS till FROM (
            SELECT rid, i, m, v, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS place
            FROM (SELECT rid, m, p, v, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT rid, {found} AS m, {between} AS p, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)))
        WHERE length(v[i]) >= {least}"""


BASE_SECRET_SPANS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans(k, *x[1:]) for k, x in enumerate(_KINDS))}),
of_row AS (
    SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
        string_agg(['assign', 'access', 'hex'][k + 1] || ':' || CAST(place AS BIGINT) || ':' || CAST(till AS BIGINT), ',' ORDER BY place, k) AS named
    FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(named, '')) AS base_sha256
FROM d LEFT JOIN of_row USING (rid)"""

BASE_QUALITY_COUNTS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT rid, i, words[i:i + 2] AS three FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
counts AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM w LEFT JOIN covered USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts"""


def queries() -> dict:
    return {
        "base_secret_spans": base_secret_spans,
        "base_quality_counts": base_quality_counts,
        "op1_secret_scans": secrets.op1_secret_scans,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
        "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
        "op9_substring_dedup": substring.op9_substring_dedup,
        "op10_token_binary": token_binary.op10_token_binary,
    }


def oracle_sql() -> dict[str, str]:
    return {"base_secret_spans": BASE_SECRET_SPANS, "base_quality_counts": BASE_QUALITY_COUNTS}
