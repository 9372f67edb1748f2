"""Rules on claims, questions and responses, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X

# fixed values: phrases that a natural question doesn't hold
DANGEROUS = (
    "(?i)repeat context|hidden document|system prompt|knowledge base membership|membership inference|"
    "membership (?:of|in) (?:the |your )?(?:knowledge base|database|index|corpus|vector store)|training data|private context|show me the context"
)
INJECTION = "(?i)\\b(?:ignore previous|developer message|system instruction|jailbreak|do anything now)\\b"
PROBE = "(?i)\\b(?:what documents|which document|retrieved context|source chunk|vector store|index contains)\\b"
ERROR_START = "(?i)^\\s*(?:error\\b|http\\s*[45]\\d\\d|[45]\\d\\d\\s+(?:bad|unauthorized|forbidden|not found|too many|internal|service)|rate limit)"


def naturalness(question: Column) -> Column:
    """0 to 1: of a usual length, closed by ? or ., without template marks."""
    n = F.size(X.words(question))
    length = F.when(n.between(10, 90), 1.0).otherwise(F.greatest(F.lit(0.2), 1 - F.abs(n - 45) / 100))
    closed = F.when(F.trim(question).rlike("[?.]$"), 0.9).otherwise(0.7)
    marks = F.when(F.contains(question, F.lit("{{")) | F.contains(question, F.lit("```")), 0.6).otherwise(1.0)
    return F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), length * closed * marks), 4))


def gate(question: Column, containment: Column, run: Column, least: float = 0.5, most_copied: float = 0.6, longest: int = 12) -> Column:
    """The first reason to refuse a question; null if there is none."""
    rules = [
        ("dangerous", question.rlike(DANGEROUS)), ("injection", question.rlike(INJECTION)), ("context_probe", question.rlike(PROBE)),
        ("unnatural", naturalness(question) < least), ("copied_ngrams", containment > most_copied), ("copied_run", run > longest),
    ]
    return F.coalesce(*(F.when(bad, name) for name, bad in rules))


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())


def sentence_faults(sentence: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(sentence, F.lit("")), "\\s+", " "))
    count = lambda c: F.length(flat) - F.length(F.replace(flat, F.lit(c), F.lit("")))
    uneven = reduce(lambda a, b: a | b, (count(x) != count(y) for x, y in ("()", "[]", "{}")))
    return reasons({
        "too_short": F.size(X.words(flat)) < 4, "incomplete": (flat != "") & ~flat.rlike("[.!?][\"')\\]]*$"), "excessive_lines": F.regexp_count(F.coalesce(sentence, F.lit("")), F.lit("\\n")) >= 12,
        "repeated_links": F.regexp_count(flat, F.lit("(?i)https?://")) >= 3, "markup": flat.rlike("(?i)<[^>]+>|&(?:lt|gt|amp|nbsp);"), "unbalanced_quote": count('"') % 2 == 1, "unbalanced_delimiters": uneven,
    })


# fixed values: of each kind the sub-types by the patterns that name them, the last for all others
SUBTYPES = {
    "PERSON": [(r"\b[A-Z]\.", "initialed_person_name"), (r"(?i)^(?:dr|mr|mrs|ms|prof)\.?\s+", "titled_person_name"), (r"^\S+$", "single_person_name"), ("", "multi_token_person_name")],
    "ORG": [(r"(?i)\b(?:inc|corp|corporation|llc|ltd|limited|plc|co)\.?\b", "corporate_organization"), (r"(?i)\b(?:university|college|institute|laborator(?:y|ies)|hospital)\b", "academic_or_medical_organization"),
            (r"(?i)\b(?:ministry|department|commission|agency|authority|council)\b", "government_organization"), ("", "named_organization")],
    "LOCATION": [(",", "compound_geographic_location"), (r"(?i)^the\s+", "definite_article_location"), ("", "named_geographic_location")],
    "PRODUCT": [(r"\d", "versioned_or_numbered_product"), (r"(?i)\b(?:software|platform|service|suite|system)\b", "software_or_service_product"), ("", "named_product")],
    "PROJECT_NAME": [(r"^(?=.{1,16}$)(?=.*\p{Lu})\P{Ll}*$", "acronym_project_name"), ("", "titled_project_name")],
    "CONTRACT_TERM": [(r"(?i)\b(?:agreement|contract|lease|license|licence)\b", "named_agreement"), (r"(?i)\b(?:plan|policy)\b", "contractual_plan_or_policy"), ("", "defined_contract_term")],
}
# fixed values: features of a value's form, and those that a changed value of a kind must keep
FORM = {"digit": r"\d", "period": r"\.", "comma": ",", "hyphen": "-", "article": r"(?i)^the\s+"}
KEPT = {"PERSON": ["period"], "LOCATION": ["comma"], "ORG": ["comma"], "PRODUCT": ["case_style"], "PROJECT_NAME": ["case_style"]}
KEPT_BY_ALL = ["digit", "article"]


def _flat(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " "))


def case_style(value: Column) -> Column:
    """upper, lower, title (each word of A-Z begins with a capital), mixed, or no_letters."""
    held = lambda p: value.rlike(p)
    styles = [("no_letters", ~held(r"\p{L}")), ("upper", held(r"\p{Lu}") & ~held(r"\p{Ll}")), ("lower", held(r"\p{Ll}") & ~held(r"\p{Lu}")), ("title", held("[A-Z]") & ~held("(?<![A-Za-z])[a-z]"))]
    return F.coalesce(*(F.when(holds, name) for name, holds in styles), F.lit("mixed"))


def signature(value: Column) -> dict[str, Column]:
    v = _flat(value)
    return {name: v.rlike(p) for name, p in FORM.items()} | {"case_style": case_style(v), "token_count": F.size(X.words(v))}


def compatible(original: Column, other: Column, kind: Column) -> Column:
    """Whether a changed value keeps the form that values of its kind must keep."""
    a, b = signature(original), signature(other)
    kept = [F.upper(kind).isin([k for k, names in KEPT.items() if name in names]) for name in a]
    needed = [F.lit(True) if name in KEPT_BY_ALL else of_kind for name, of_kind in zip(a, kept, strict=True)]
    return reduce(lambda x, y: x & y, (~of_kind | (a[name] == b[name]) for name, of_kind in zip(a, needed, strict=True)))


def subtype(value: Column, kind: Column) -> Column:
    """The first sub-type of the value's kind whose pattern it holds; other kinds have one, their name."""
    v, k = _flat(value), F.upper(kind)
    named = [F.when((k == of) & v.rlike(pattern), label) for of, rules in SUBTYPES.items() for pattern, label in rules]
    return F.coalesce(*named, F.when(F.coalesce(kind, F.lit("")) == "", "unknown"), F.lower(kind))


def pair_faults(true_claim: Column, other_claim: Column, original: Column, other: Column, most_chars: int = 400) -> Column:
    """Why two claims don't differ in one value only."""
    slot = lambda claim, value: F.replace(claim, value, F.lit("{ENTITY}"))
    times = lambda claim, value: F.try_divide(F.length(claim) - F.length(F.replace(claim, value, F.lit(""))), F.length(value))
    return reasons({
        "missing_value": (F.coalesce(original, F.lit("")) == "") | (F.coalesce(other, F.lit("")) == ""), "same_value": F.lower(original) == F.lower(other),
        "original_not_once": ~F.coalesce(times(true_claim, original) == 1, F.lit(False)), "other_not_once": ~F.coalesce(times(other_claim, other) == 1, F.lit(False)),
        "differs_elsewhere": slot(true_claim, original) != slot(other_claim, other), "too_long": F.greatest(F.length(true_claim), F.length(other_claim)) > most_chars,
    })


def is_success(query_id: Column, response: Column, error: Column, model: Column, expected: Column) -> Column:
    """A response that may be scored: of a query, not empty, no error in or beside it, of the expected model if one is named."""
    body = F.trim(F.coalesce(response, F.lit("")))
    failed = F.get_json_object(body, "$.error").isNotNull() | (F.get_json_object(body, "$.success") == "false") | body.rlike(ERROR_START)
    return query_id.isNotNull() & (F.coalesce(error, F.lit("")) == "") & (body != "") & ~F.coalesce(failed, F.lit(False)) & (expected.isNull() | F.coalesce(model == expected, F.lit(False)))


def entails(entailment: Column, neutral: Column, contradiction: Column) -> Column:
    return entailment > F.greatest(neutral, contradiction)
