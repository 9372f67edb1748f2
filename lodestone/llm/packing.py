"""Best-fit packing of documents into sequences of fixed length.

A document is its token ids and a closing id. Only documents longer than a sequence are cut: into pieces of full length,
the first of which takes the remainder. Pieces are then packed by bulk-synchronous best-fit:

1. Range-sort: pieces are sorted over all partitions by falling length (ties by doc_id, start); a piece's place in that
   order gives its rank within its length.
2. Successor sweep: the longest unplaced length looks up the smallest gap that holds it. All pieces of a length and all
   sequences of equal gap are matched at once, as rank ranges.
3. Conflicts go by rank: where a gap class has fewer sequences than pieces ask for, the lower ranks get them and the rest
   sweep on to the next larger gap, at last to new sequences.
4. Gaps are updated (a range of sequences leaves its class for a smaller one), and the sweep repeats until all lengths are
   placed.

Pieces of one length are interchangeable, so that the sweeps need only their counts: at most `size` lengths and `size`
gap classes, whatever the corpus. The plan of rank ranges is worked out on these bounded counts and applied to the pieces
where they lie. No group of pieces meets in one task.

Cases: a null or empty text is one piece holding the closing id; a null doc_id sorts first; rows that repeat a doc_id are
each packed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import Scratch, batch, text_chunks
from lodestone.llm.word_ids import SpacedWords, word_ids

#: Bytes of text that a worker turns into ids at once.
CHUNK_BYTES = 4 << 20

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_path: str, size: int, end_id: int) -> DataFrame:
    """A row for each piece of each document, with the checksum of its ids."""

    def cut(batches):
        tokens = word_ids(SpacedWords, tokenizer_path)
        for rows, texts in text_chunks(batches, CHUNK_BYTES):
            out = []
            for doc_id, own in zip(rows.column("doc_id").to_pylist(), tokens.encode(texts), strict=True):
                ids = np.append(own, tokens.dtype.type(end_id)).astype("<u4")
                first = len(ids) % size or size
                for piece, start in enumerate([0, *range(first, len(ids), size)]):
                    end = first if piece == 0 else start + size
                    out.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            yield batch(PIECE, list(zip(*out, strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(cut, _PIECE_DDL)


def plan(counts: dict[int, int], size: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """({length: [(first rank, first sequence, offset)]}, number of sequences), from the number of pieces by length.

    gaps holds the gap classes that have sequences, sorted; each class is a queue of ranges [first sequence, count]."""
    gaps: list[int] = []
    ranges: dict[int, deque] = {}
    steps: dict[int, list[tuple[int, int, int]]] = {}
    opened = 0

    def give(gap: int, first: int, count: int) -> None:
        if gap:
            if gap not in ranges:
                ranges[gap] = deque()
                insort(gaps, gap)
            ranges[gap].append([first, count])

    for length in sorted(counts, reverse=True):
        rank, left, own = 0, counts[length], steps.setdefault(length, [])
        while left:
            at = bisect_left(gaps, length)  # the successor among the gaps
            if at < len(gaps):
                gap, queue = gaps[at], ranges[gaps[at]]
                taken = min(left, queue[0][1])
                own.append((rank, queue[0][0], size - gap))
                give(gap - length, queue[0][0], taken)
                queue[0][0] += taken
                queue[0][1] -= taken
                if not queue[0][1]:
                    queue.popleft()
                    if not queue:
                        del ranges[gap], gaps[bisect_left(gaps, gap)]
                rank, left = rank + taken, left - taken
            else:  # new sequences, each filled with as many pieces of this length as it holds
                each = size // length
                full, rest = divmod(left, each)
                for k in range(each):
                    if full:
                        own.append((rank, opened, k * length))
                        rank += full
                give(size - each * length, opened, full)
                opened += full
                for k in range(rest):
                    own.append((rank, opened, k * length))
                    rank += 1
                if rest:
                    give(size - rest * length, opened, 1)
                    opened += 1
                left = 0
    return steps, opened


def best_fit(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ...)."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece")]
    pieces = scratch.save(pieces, "pieces")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a piece's number in the sorted order: its partition and its place there, kept by being written
    ranked = scratch.save(pieces.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    scratch.drop("pieces")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for k, held in sorted((r[0], r[1]) for r in ranked.groupBy(part.alias("part")).agg(F.max(place) + 1).collect()):  # a row a partition
        before[k], total = total, total + held
    counts = {int(r[0]): int(r[1]) for r in ranked.groupBy("length").count().collect()}  # at most `size` rows
    steps, _ = plan(counts, size)
    lengths = sorted(steps, reverse=True)
    first_of = dict(zip(lengths, np.cumsum([0, *[counts[x] for x in lengths]]).tolist(), strict=False))
    flat = np.array([(first_of[x] + rank, sequence, offset) for x in lengths for rank, sequence, offset in steps[x]], np.int64).reshape(-1, 3)
    held = spark.sparkContext.broadcast((flat, before))  # bounded by the square of size, far less in practice

    schema = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place_all(batches):
        flat, before = held.value
        for rows in batches:
            at = rows.column("at").to_numpy()
            rank = (at & ((1 << 33) - 1)) + np.fromiter((before[k] for k in (at >> 33).tolist()), np.int64, len(at))
            k = np.searchsorted(flat[:, 0], rank, side="right") - 1
            new = flat[k, 1] + rank - flat[k, 0], flat[k, 2]
            yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in PIECE] + [pa.array(x) for x in new], schema=schema)

    return ranked.mapInArrow(place_all, f"{_PIECE_DDL}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    return best_fit(pieces_of(docs, tokenizer_path, size, end_id), size)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
