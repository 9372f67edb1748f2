"""Stances of responses, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X

# fixed values: phrases that tell a stance
UNKNOWN = "(?i)\\b(?:i do not know|i don't know|don't know|cannot verify|can't verify|unknown|insufficient information|not enough information)\\b"
REFUSAL = "(?i)\\b(?:cannot disclose|can't disclose|not allowed|unable to provide|privacy|confidential|restricted)\\b"
CONSISTENT = "(?i)\\b(?:consistent|supported|verified|matches|correct|accurate|yes)\\b"
INCONSISTENT = "(?i)\\b(?:inconsistent|unsupported|incorrect|wrong|false|conflict|conflicting|mismatch|does not match|not consistent|corrected|should be|instead)\\b"
STATUS = {
    "unknown": ["unknown", "dont_know", "do_not_know", "cannot_verify"], "refuses": ["refused", "refusal"],
    "inconsistent": ["inconsistent", "unsupported", "incorrect", "false", "conflict"], "consistent": ["consistent", "supported", "verified", "true"],
}


_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: Letters beyond ASCII that are the same as an ASCII letter but for case.
_FOLDED = {"s": "\u017f", "k": "\u212a"}


def as_sql_reads(phrases: str) -> str:
    """A pattern of phrases in the regular expressions of Java as those of DuckDB read it: a word ends where ASCII letters,
    digits and underscores end, whatever letter follows, and each letter stands for all its cases."""
    one = lambda m: _EDGE if m[0] == "\\b" else f"[{m[0].lower()}{m[0].upper()}{_FOLDED.get(m[0].lower(), '')}]"
    return re.sub(r"\\b|[A-Za-z]", one, phrases.removeprefix("(?i)"))


def flags(response: Column, claim_type: Column, original: Column, counterfactual: Column, objects: bool = True) -> dict[str, Column]:
    """The ten flags of a response to a claim, and its stance. A JSON object's status or verdict counts beside the phrases,
    unless objects are read as plain text."""
    response = F.coalesce(response, F.lit(""))
    status = F.nullif(F.lower(F.trim(F.coalesce(F.nullif(F.get_json_object(response, "$.status"), F.lit("")), F.get_json_object(response, "$.verdict")))), F.lit(""))
    named = lambda k: F.coalesce(status.isin(STATUS[k]), F.lit(False)) if objects else F.lit(False)
    says = lambda phrases: response.rlike(as_sql_reads(phrases))
    unknown, refuses = says(UNKNOWN) | named("unknown"), says(REFUSAL) | named("refuses")
    against, for_ = says(INCONSISTENT) | named("inconsistent"), says(CONSISTENT) | named("consistent")
    holds = lambda value: (F.coalesce(value, F.lit("")) != "") & F.contains(X.stance_text(response), X.stance_text(value))
    has_original, has_other = holds(original), holds(counterfactual)
    answers, true = ~unknown & ~refuses, F.coalesce(claim_type == "true", F.lit(False))
    supports = true & answers & (for_ | has_original) & ~against
    rejects = true & answers & against
    corrects = ~true & answers & has_original & against
    denies = ~true & answers & against
    accepts = ~true & answers & ~against & (for_ | has_other)
    stance = (
        F.when(supports, "supports_true_claim").when(rejects, "rejects_true_claim").when(corrects, "corrects_counterfactual").when(denies, "rejects_counterfactual")
        .when(accepts, "accepts_counterfactual").when(unknown, "unknown").when(refuses, "refuses").otherwise("unrelated")
    )
    return {
        "supports_true_claim": supports, "rejects_true_claim": rejects, "accepts_counterfactual": accepts, "rejects_counterfactual": denies, "corrects_to_original": corrects,
        "mentions_original": has_original, "mentions_counterfactual": has_other, "says_unknown": unknown, "refuses": refuses, "stance": stance,
    }
