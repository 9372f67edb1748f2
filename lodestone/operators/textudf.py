"""What column expressions can't say: Unicode forms, folds over paragraphs, alignments. All work on Arrow batches."""

import difflib
import hashlib
import hmac
import html
import json
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, groupby
from xml.etree import ElementTree

import numpy as np
import pandas as pd

from lodestone.functions.udf import on_series, per_value

# fixed value: the id of an article in XML that can't be parsed
PMC_ID = "(?i)<article-id\\b[^>]*\\bpub-id-type=[\"']pmc[\"'][^>]*>\\s*(PMC\\d+)\\s*</article-id>"
SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")
PARAGRAPH_END = re.compile(r"\n\s*\n|\n(?=[A-Z0-9])")
TOKEN = re.compile(r"\{ENTITY\}|\w+(?:[.'_-]\w+)*")


def canonical(value: str | None) -> str:
    """NFKC, one blank between words, case folded."""
    return " ".join(unicodedata.normalize("NFKC", value or "").split()).casefold()


def tokens(text: str | None) -> list[str]:
    return [m.group().casefold() for m in TOKEN.finditer(" ".join(unicodedata.normalize("NFKC", text or "").split()))]


def masked(text: str | None, values: list[str]) -> str:
    """Each value as a whole word, in any case and spacing, becomes {ENTITY}; the longest values first."""
    out = text or ""
    for value in sorted({" ".join(v.split()) for v in values if v and v.strip()}, key=lambda v: (-len(v), v)):
        out = re.sub(r"(?<!\w)" + r"\s+".join(map(re.escape, value.split())) + r"(?!\w)", "{ENTITY}", out, flags=re.IGNORECASE)
    return out


def common_run(a: list[str], b: list[str]) -> int:
    """Longest run of tokens that both hold."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in s], np.int64) for s in (a, b))
    best, last = 0, np.zeros(len(y) + 1, np.int64)
    for v in x:
        now = np.zeros_like(last)
        now[1:] = np.where(y == v, last[:-1] + 1, 0)
        best, last = max(best, int(now.max(initial=0))), now
    return best


def bleu4(reference: list[str], said: list[str]) -> float:
    """Sentence BLEU of up to four-grams; an order without a match counts as if it had 1 / (2^k * 5 / ln length) of one, k being
    the number of such orders so far (smoothing 4)."""
    if not said or not reference:
        return 0.0
    logs, missing = 0.0, 0
    for n in range(1, 5):
        own, held = (Counter(zip(*(s[i:] for i in range(n)), strict=False)) for s in (said, reference))
        total = max(1, sum(own.values()))
        met = sum(min(c, held[g]) for g, c in own.items())
        if n == 1 and not met:
            return 0.0
        if not met:
            if len(said) < 2:
                return 0.0
            missing += 1
            met = 1 / (2**missing * 5 / math.log(len(said)))
        logs += math.log(met / total) / 4
    return min(1.0, math.exp(1 - len(reference) / len(said))) * math.exp(logs)


def filled(sizes: list[int], room: int, between: int, opened: int) -> list[tuple[int, int]]:
    """Ranges of units put together in order, each as far as room allows: a unit costs its size and the separator after it,
    and a range that an overflow opens is spared `opened`. A range has one unit at least."""
    ends, out = [0, *accumulate(n + between for n in sizes)], []
    while not out or out[-1][1] < len(sizes):
        at = out[-1][1] if out else 0
        out.append((at, max(at + 1, bisect_right(ends, ends[at] + room + (opened if out else 0)) - 1)))
    return out if sizes else []


def _within(paragraph: str, most: int) -> list[str]:
    """A paragraph as it is, or cut at sentences; sentences that are too long are cut at their length."""
    if len(paragraph) <= most:
        return [paragraph]
    out = []
    sentences = [s for s in map(str.strip, SENTENCE_END.split(paragraph)) if s]
    for too_long, run in groupby(sentences, lambda s: len(s) > most):
        held = list(run)
        if too_long:
            out += [s[i : i + most] for s in held for i in range(0, len(s), most)]
        else:
            out += [" ".join(held[a:b]) for a, b in filled([len(s) for s in held], most, 1, 1)]
    return out


def paragraph_chunks(text: str | None, least: int = 200, most: int = 3000, target: int = 1000) -> list[str]:
    """Paragraphs are put together up to the target; what is too short goes."""
    parts = [x for p in map(str.strip, PARAGRAPH_END.split(text or "")) if p for x in _within(p, most)]
    chunks = ("\n\n".join(parts[a:b]).strip()[:most] for a, b in filled([len(x) for x in parts], target, 2, 0))
    return [c for c in chunks if len(c) >= least]


def propositions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, text) of sentences."""
    out = []
    for m in re.finditer(r"[^.!?\n]+(?:[.!?]+|$|(?=\n))", text or ""):
        body = m.group().strip()
        if body:
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            out.append((start, start + len(body), body))
    return out


def strict_object(text: str | None) -> str | None:
    """The object as JSON with sorted keys; null for anything else, keys that occur twice, and NaN."""

    def pairs(found):
        if len({k for k, _ in found}) < len(found):
            raise ValueError("a key occurs twice")
        return dict(found)

    def refuse(_):
        raise ValueError("not a JSON number")

    try:
        value = json.loads(text or "", object_pairs_hook=pairs, parse_constant=refuse)
    except ValueError:
        return None
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None


def article(xml: str | None) -> list[str]:
    """[PMC id in upper case, text] of a JATS article: its abstracts, then its bodies. Of XML that can't be parsed the id by
    its pattern, and the XML itself; an empty id for none."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        found = re.search(PMC_ID, xml or "")
        return [found[1].upper() if found else "", xml or ""]
    ids = ("".join(e.itertext()).strip().upper() for e in root.iter("article-id") if e.get("pub-id-type", "").lower() == "pmc")
    flat = [" ".join(filter(None, map(str.strip, e.itertext()))) for tag in ("abstract", "body") for e in root.iter(tag)]
    return [next(ids, ""), "\n\n".join(filter(None, flat)) or xml]


article_parts = per_value(article, "array<string>")
unescape = per_value(lambda x: None if x is None else html.unescape(x), "string")
canonical_key = per_value(canonical, "string")
token_list = per_value(tokens, "array<string>")
chunk_list = per_value(paragraph_chunks, "array<string>")
proposition_list = per_value(lambda x: [{"start": s, "end": e, "text": t} for s, e, t in propositions(x)], "array<struct<start:int,end:int,text:string>>")
strict_json = per_value(strict_object, "string")


@on_series("int")
def common_run_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_run(tokens(x), tokens(y)) for x, y in zip(a, b, strict=True)])


@on_series("double")
def bleu_of(reference: pd.Series, said: pd.Series) -> pd.Series:
    return pd.Series([round(bleu4(tokens(x), tokens(y)), 6) for x, y in zip(reference, said, strict=True)])


@on_series("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio(), 6) for x, y in zip(a, b, strict=True)])


def blind_id(secret: bytes):
    """A keyed digest: without the secret an id can't be told from its source."""
    return per_value(lambda x: hmac.new(secret, (x or "").encode(), hashlib.sha256).hexdigest(), "string")
