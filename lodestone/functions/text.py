"""Cleaning, normalising, tokenising, and measures of text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns that decide what is noise and what is an entity
TAG = "<[^>]+>"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
MAIL_HEADER = (
    "(?im)^(?:(?:from|to|cc|bcc|subject|date|sent|received|return-path|reply-to|sender|delivered-to|message-id|mime-version|"
    "content-type|content-transfer-encoding|content-disposition)|x-[a-z0-9-]+):[^\\n]*$"
)
FORWARDED = "(?im)^[ \\t>]*[-_]{2,}[^\\n]*(?:forwarded by|original message|forwarded message)[^\\n]*$"
SIGNATURE = "(?s)\\n--\\s*\\n.*$"
REFERENCES = "(?is)\\n\\s*(?:references|bibliography)\\s*\\n.*$"
STOCK_PHRASES = (
    "(?i)\\b(?:background:?\\s*)?(?:the purpose of this study|further studies are needed|more research is needed|"
    "this article is protected by copyright)\\b"
)
ENTITIES = {
    "money": "(?i)(?:(?:\\b(?:US|C|A|HK|NZ)\\$|[$€£¥])\\s?\\d[\\d,]*(?:\\.\\d+)?|\\b\\d[\\d,]*(?:\\.\\d+)?\\s?(?:USD|dollars|million|billion)\\b)",
    "date": (
        "(?i)\\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|"
        "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\\.?\\s+\\d{1,2},?\\s+\\d{2,4}\\b|\\b\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}\\b|\\b\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}\\b"
    ),
    "percent": "(?i)\\b\\d+(?:\\.\\d+)?\\s?%|\\b\\d+(?:\\.\\d+)?\\s?percent\\b",
    "org": (
        "\\b[A-Z][A-Za-z&.,'-]*(?:\\s+[A-Z][A-Za-z&.,'-]*){0,5}\\s+"
        "(?:Inc|Corp|Corporation|LLC|Ltd|Limited|Company|Co|Bank|Group|University|Hospital|Agency|Department)\\b"
    ),
    "email": "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b",
    "medical_value": "(?i)\\b\\d+(?:\\.\\d+)?\\s?(?:mg|mcg|g|kg|ml|mmHg|bpm|IU|days?|weeks?|months?|years?|patients?|cases?)\\b",
    "contract_term": (
        "(?i)\\b(?:effective date|expiration date|termination|renewal|confidentiality|indemnification|indemnity|governing law|"
        "choice of law|non-disclosure|assignment|delegation|liability|warranty|payment term|license term)\\b"
    ),
    "numeric": "\\b\\d+(?:[,.]\\d+)*(?:\\.\\d+)?\\b",
}
TEMPLATE = (
    "(?i)\\b(?:all rights reserved|forward-looking statements|not intended to provide medical advice|for informational purposes only|"
    "copyright|terms and conditions apply|safe harbor statement|this communication may contain privileged|confidential information)\\b"
)
STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "had", "not", "but", "you", "his", "her", "its", "they", "their"]


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def tidy(text: Column) -> Column:
    """Tags, control characters, odd blanks and runs of white space go; at most one empty line stays between paragraphs.
    Named and numbered HTML references are left to unescape()."""
    steps = [(TAG, " "), (CONTROL, " "), ("[\\u00a0\\ufeff]", " "), ("[ \\t\\r\\f\\x0b]+", " "), (" *\\n *", "\n"), ("\\n{3,}", "\n\n")]
    return F.regexp_replace(_chain(F.coalesce(text, F.lit("")), steps), "^\\s+|\\s+$", "")


def clean_mail(text: Column) -> Column:
    return tidy(_chain(F.coalesce(text, F.lit("")), [(FORWARDED, " "), (MAIL_HEADER, " "), (SIGNATURE, " ")]))


def clean_article(text: Column) -> Column:
    return tidy(_chain(F.coalesce(text, F.lit("")), [(REFERENCES, " "), (STOCK_PHRASES, " ")]))


def clean_for(dataset: Column, text: Column) -> Column:
    kind = F.lower(dataset)
    return F.when(kind == "enron", clean_mail(text)).when(kind.isin("pubmed", "pmc"), clean_article(text)).otherwise(tidy(text))


def flat(text: Column) -> Column:
    """One line, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "), "^ | $", ""))


def stance_text(text: Column) -> Column:
    """One line, lower case letter by letter, without commas. A vertical tab is no white space."""
    line = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t\\n\\f\\r ]+", " "), "^ | $", "")
    return F.replace(F.lower(F.translate(line, "\u0130\u03a3", "i\u03c3")), F.lit(","), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def index_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def content_terms(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(index_terms(text), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~F.array_contains(stop, t))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space; none for fewer tokens."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingles(tokens: Column, n: int = 5) -> Column:
    """Distinct runs of n tokens; fewer tokens are one shingle, none are none."""
    short = F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tokens) < n, short).otherwise(F.array_distinct(ngrams(tokens, n)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(query: Column, source: Column, n: int = 5) -> Column:
    """Share of the query's runs of n tokens, repeats counted, that the source holds; 0 for a shorter query."""
    own, held = ngrams(query, n), ngrams(source, n)
    return F.coalesce(F.try_divide(F.size(F.filter(own, lambda g: F.array_contains(held, g))), F.size(own)), F.lit(0.0))


def copied_run(source: Column, query: Column) -> Column:
    """Most query tokens in a row of which each occurs somewhere in the source."""
    step = lambda acc, t: F.when(F.array_contains(source, t), F.struct((acc["now"] + 1).alias("now"), F.greatest(acc["best"], acc["now"] + 1).alias("best"))).otherwise(F.struct(F.lit(0).alias("now"), acc["best"].alias("best")))
    return F.aggregate(query, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda acc: acc["best"])


def entity_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)) for name, p in ENTITIES.items()}


def perturbable(counts: dict[str, Column]) -> Column:
    """Entities of a definite kind; plain numbers only where there are none."""
    definite = reduce(lambda a, b: a + b, (c for n, c in counts.items() if n != "numeric"))
    return F.when(definite > 0, definite).otherwise(counts["numeric"])


def density(count: Column, text: Column) -> Column:
    return F.round(count / F.greatest(F.lit(1), F.size(words(text))), 6)


def is_template(text: Column, count: Column) -> Column:
    """Empty, a stock phrase with fewer than two entities, or six lines and more of which over two fifths repeat."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\r|\\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    n = F.size(lines)
    return (F.size(words(text)) == 0) | (text.rlike(TEMPLATE) & (count < 2)) | ((n >= 6) & ((n - F.size(F.array_distinct(lines))) / F.greatest(n, F.lit(1)) > 0.4))


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of words; the last is the first one to reach the end."""
    w = words(text)
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
    return F.when(F.size(w) > 0, parts).otherwise(F.array().cast("array<string>"))


def mailbox_user(path: Column) -> Column:
    return F.split_part(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"), F.lit(1))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def redact_literal(text: Column, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?i)\\Q"), value, F.lit("\\E")), F.lit("[REDACTED]")))


def atomic_claims(text: Column) -> Column:
    """Sentences of each line, without bullets."""
    lines = F.split(F.coalesce(text, F.lit("")), "\\n+")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, "^\\s*(?:[-*•]|\\d+[.)])\\s*", ""))
    return F.filter(F.transform(F.flatten(F.transform(bare, lambda x: F.split(x, "(?<=[.!?])\\s+"))), F.trim), lambda x: x != "")


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def span_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common length over the shorter one."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)) / F.greatest(F.lit(1), F.least(e1 - s1, e2 - s2))


def hash_rank(*parts: Column | str) -> Column:
    """A digest that orders rows at random but alike at every run: of the parts, joined by NUL."""
    return F.sha2(F.concat_ws(chr(0), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)
