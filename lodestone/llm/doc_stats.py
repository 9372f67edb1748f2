"""Statistics of a document's text, from its UTF-8 bytes, and the labelled rows that models are fitted on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._base import batch, hashed_words, rolling, text_chunks

SYMBOLS = b"#*$%&|<>"
#: Classes of bytes.
OTHER, CONTINUATION, SYMBOL, UPPER, LOWER, DIGIT, SPACE, LEAD, MARK = range(9)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x80:0xC0] = CONTINUATION
_CLASS[0xC0:] = LEAD
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[ord("!"), ord("?")]] = MARK
_CLASS[list(SYMBOLS)] = SYMBOL

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share",
    "distinct_share", "top_word_share", "log_words_a_line", "one_char_share", "wide_share", "symbol_word_share", "log_top_run", "repeat_bigram_share",
]


def stats(text: bytes, words: np.ndarray) -> tuple[list[int], list[float]]:
    """(the values of COUNTS, those of FEATURES) of a text and its words' hashes."""
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(FEATURES)
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)
    chars = int(len(text) - classes[SPACE] - classes[CONTINUATION])
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        _, back, often = np.unique(rolling(words, 3), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(often[back] > 1)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 3, -1)
        repeated = int((np.cumsum(edge)[:n] > 0).sum())
    _, counts = np.unique(words, return_counts=True)
    pairs = len(np.unique(words[:-1] * np.uint64(0xD1342543DE82EF95) + words[1:])) if n > 1 else 1
    tokens = text.split()
    single = sum(map((1).__eq__, map(len, tokens)))
    with_symbol = sum(1 for t in tokens if t[-1] in SYMBOLS) if classes[SYMBOL] else 0
    same = np.flatnonzero(np.diff(np.concatenate(([True], words[1:] != words[:-1], [True])).nonzero()[0]) > 1)
    letters = max(1, int(classes[UPPER] + classes[LOWER]))
    features = [
        np.log1p(n), chars / n, classes[SYMBOL] / chars, dup_lines / len(lines), repeated / n, classes[UPPER] / letters, classes[DIGIT] / chars, classes[MARK] / n,
        len(counts) / n, counts.max() / n, np.log1p(n / len(lines)), single / n, classes[LEAD] / chars, with_symbol / n, np.log1p(len(same)), 1 - pairs / max(1, n - 1),
    ]
    return [n, chars, int(classes[SYMBOL]), dup_lines, repeated], [float(x) for x in features]


STATS_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def stats_of(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and features of each row; a null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("features", pa.list_(pa.float64()))])

    def read(batches):
        for part, texts in text_chunks(batches):
            counts, features = zip(*map(stats, texts, hashed_words(texts)), strict=True)
            yield batch(schema, [part.column("doc_id").to_pylist(), *zip(*counts, strict=True), list(features)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(read, STATS_DDL)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels no model may learn; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from; of several labels of a document the greatest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    return known.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows, those of least hash of doc_id, hence the same ones at every run."""
    return rows.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(most)


def matrix(column) -> np.ndarray:
    """Of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(FEATURES)))
