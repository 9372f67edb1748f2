"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what has no pattern.

Patterns give the base spans: assignments of a value to a secret's name, access keys, long hexadecimal runs. Novelty adds to
them: a long string with letters and digits whose surroundings name a secret is a candidate; of an unspaced NAME=VALUE the
value is, and the name belongs to its surroundings. Its marginal bytes are the compressed size of its surroundings with it less their size without it, both primed with a dictionary of code identifiers.
Identifiers, words and text that the surroundings repeat cost next to nothing; a string that costs at least `NOVEL` bytes a
character can't be told from chance and is reported.

Cases: null and empty texts hold no secret; a null doc_id is scanned like any other; rows that repeat a doc_id get a row each;
spans are in code points, the end exclusive; an empty table gives no rows; other columns are ignored by the scan and kept by
the redaction.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import batch, table, text_chunks

KINDS = ["assign", "access", "hex", "novel"]
# fixed values: the patterns of the base spans
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_LONG = 6, 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SENSITIVE = re.compile(r"passw|passphrase|secret|token|credential|bearer|authori[sz]ation|(?:api|access|private|signing)[ _-]?key|client[ _-]?id", re.IGNORECASE | re.ASCII)
BEFORE, AFTER, NAMED_WITHIN, NOVEL = 240, 80, 64, 0.8
IDENTIFIERS = (
    "abstract access accessToken account address algorithm allow api_key apiKey application argument array assert async attribute "
    "authenticate authorization await backend base64 basic bearer begin binary boolean bucket buffer cache callback cancel certificate "
    "channel character charset checksum class client_id client_secret close cluster collection column command commit compare config "
    "configuration connect connection console constant constructor container content context control controller convert cookie "
    "count create credential credentials current cursor database dataset datetime debug decode default define delete deploy "
    "description destination development device dictionary directory disable display document domain download element email enable "
    "encode encrypt endpoint engine environment error event exception execute exists expires export expression extends external "
    "factory false field file filename filter final fingerprint float folder format function generate github global group handler "
    "hash header height hidden history hostname https identifier image implements import include index initialize input insert "
    "instance integer interface internal invalid iterator javascript json keyword label language length level library license "
    "listener local location logger login machine manager mapping master maximum memory message metadata method minimum model "
    "module monitor namespace network number object offset operation option output override package parameter parent parser "
    "password path pattern permission pipeline platform plugin pointer policy position prefix previous private private_key process "
    "production profile project property protected protocol provider proxy public publish python query queue random readonly "
    "receive record redirect reference refresh_token register release remote remove render replace repository request require "
    "resource response result return revision role runtime sample schedule schema scope script search secret secret_access_key "
    "security select sequence serialize server service session setting shared signature socket source standard start static status "
    "storage stream string struct style submit subscribe success suffix summary support switch symbol synchronized system table "
    "target template temporary tenant terminal test text thread throw timeout timestamp token trace transaction transform true type "
    "undefined update upload username utility valid validate value variable version virtual visible volume warning webhook width "
    "window worker workspace wrapper write xml yaml 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
).encode()


class Novelty:
    """Marginal compressed bytes against surroundings and an identifier dictionary."""

    def __init__(self, dictionary: bytes = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def marginal(self, before: str, found: str, after: str) -> int:
        around = len(self.compressor.compress((before + after).encode()))
        return len(self.compressor.compress((before + after + found).encode())) - around


_NOVELTY: list[Novelty] = []


def value_at(found: str) -> int:
    """Where the value of an unspaced NAME=VALUE begins: after the last '=' that follows a name and leaves a long value, or 0.
    What looks like a value itself is no name, so that padding inside a value doesn't cut it."""
    at = len(found.rstrip("="))
    while (at := found.rfind("=", 0, at)) > 0:
        name = found[found.rfind("=", 0, at) + 1 : at]
        if name and found[at + 1] != "=" and len(found) - at - 1 >= LEAST_LONG:
            if len(name) < LEAST_LONG or not any(map(str.isdigit, name)) or SENSITIVE.search(name):
                return at + 1
    return 0


def find(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret value) in code points, in order of start, then kind."""
    spans = []
    assigned = b"=" in data or b":" in data
    long = max(map(len, data.split()), default=0) >= LEAST_LONG  # no pattern but the first spans white space
    if not assigned and not long:
        return spans
    text = data.decode()
    if assigned:
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if long:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
        spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
        for m in CANDIDATE.finditer(text):
            start = m.start() + value_at(m.group())
            value = text[start : m.end()]
            if not any(map(str.isdigit, value)) or not any(map(str.isalpha, value)):
                continue
            if not SENSITIVE.search(text, max(0, m.start() - NAMED_WITHIN), start):
                continue
            if not _NOVELTY:
                _NOVELTY.append(Novelty())
            if _NOVELTY[0].marginal(text[max(0, start - BEFORE) : start], value, text[m.end() : m.end() + AFTER]) >= NOVEL * len(value):
                spans.append((start, 3, m.end(), start))
    return sorted(spans)


def named(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def read(batches):
        for part, texts in text_chunks(batches):
            out = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                spans = find(text)
                counts = [sum(1 for s in spans if s[1] == k) for k in range(len(KINDS))]
                out.append((doc_id, *counts, hashlib.sha256(named([s for s in spans if s[1] < 3]).encode()).hexdigest(), named(spans)))
            yield batch(schema, list(zip(*out, strict=True)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(read, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The rows with each secret value replaced by the mark, n_chars being counted anew; all other columns as they are."""
    names = docs.columns

    def clean(data: bytes) -> str | None:
        text, done, out = data.decode(), 0, []
        for start, end in sorted((value, end) for _, _, end, value in find(data)):
            if end <= done:
                continue
            if start >= done:
                out += [text[done:start], mark]
            done = end
        return "".join(out) + text[done:]

    def read(batches):
        for part, texts in text_chunks(batches):
            was = part.column("text")
            new = pc.if_else(pc.is_valid(was), pa.array(list(map(clean, texts)), pa.string()).cast(was.type), pa.scalar(None, was.type))
            columns = []
            for k, name in enumerate(names):
                column = part.column(k)
                if name == "text":
                    column = new
                elif name == "n_chars":
                    column = pc.if_else(pc.is_valid(new), pc.utf8_length(new).cast(column.type), column)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(read, docs.schema)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
