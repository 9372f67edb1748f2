"""Suffix-array dedup on sparse suffix arrays: finds the passages that documents share.

Of all suffixes only those are retained that start at a content-selected minimiser: the least-hashed run of `ANCHOR` words
of each stretch of `gap` starts. Every passage of at least `passage` words that occurs twice holds such a start among its
first `gap` words, the same in both occurrences, and `passage - gap + 1` words follow it inside the passage (the stem).

1. Suffixes whose stem occurs once have no neighbour to match. A bit filter of bounded size holds the other stems; a second
   reading of the texts keeps the suffixes with such stems, with the words on either side of the stem.
2. Sort: the suffixes of a stem are sorted twice, by the words that follow it and by those that precede it, each partition
   holding whole stems.
3. Compare: each suffix is matched with its neighbours in either order, which have its longest match to the right and to the
   left, word by word, up to `gap` words: further words belong to the next retained suffix of the passage. The suffixes of a
   stem with more than `HOT` of them aren't brought together: both orders are made over all partitions by range, where
   suffixes of one stem and equal words are told apart by their places, and the rows on either side of a partition's edge
   are compared by themselves. Matches are the same either way.
4. The extended matches of a document that touch are joined to maximal spans.

A span is a whole repeat of at least `passage - gap + 1` words, and all words of a repeated passage of `passage` words or
more are in spans.

Cases: null and empty texts and texts shorter than a passage give no spans; rows with a null doc_id give none; a row that
repeats another's doc_id and text counts as an occurrence of its own, and its spans are given once; rows that repeat a doc_id
with other text are documents of their own, told apart by text_hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import Scratch, batch, hashed_words, leftmost_minima, mix, rolling, signed, text_chunks
from lodestone.llm.substring import hashed_input, repeated_hashes

ANCHOR, HOT = 8, 4000


def suffixes(words: np.ndarray, passage: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the stem, start) of the retained suffixes."""
    if len(words) < passage:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = rolling(words, ANCHOR)[: len(words) - passage + gap]
    at = leftmost_minima(grams, gap)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    return mix(rolling(words, passage - gap + 1)[at]), at


def common(a: bytes, b: bytes) -> int:
    """Words of 8 bytes that both start with."""
    n = min(len(a), len(b)) // 8
    if not n or a == b:
        return n
    differ = np.flatnonzero(np.frombuffer(a, np.uint64, n) != np.frombuffer(b, np.uint64, n))
    return int(differ[0]) if len(differ) else n


RUN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int64()), ("first_doc_id", pa.int64()), ("later", pa.bool_())])
_RUN_DDL = "doc_id long, text_hash long, lo int, hi int, n long, first_doc_id long, later boolean"
_PLACES = ["doc_id", "text_hash", "pos", "n", "first_doc_id", "first_hash", "first_pos"]


def run(place: tuple, left: int, right: int) -> tuple:
    """The match of a suffix at a place (_PLACES), from the words by which it reaches to the left and to the right."""
    doc_id, text_hash, pos, n, *first = place
    return doc_id, text_hash, pos - left, pos + right, n, first[0], tuple(first) != (doc_id, text_hash, pos)


def spans(docs: DataFrame, passage: int = 50, gap: int = 16) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), start_word, end_word (exclusive), n_words, n_occurrences (the most that a
    stem in the span has), first_doc_id (the least document with such a stem), is_first (no stem of the span occurs earlier)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    stem = passage - gap + 1
    shared = spark.sparkContext.broadcast(repeated_hashes(docs, lambda w: suffixes(w, passage, gap)[0], scratch, "stems"))

    def retain(batches):
        schema = pa.schema([("stem", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])
        for part, texts in text_chunks(batches):
            out = []
            for doc_id, text_hash, words in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), hashed_words(texts), strict=True):
                h, at = suffixes(words, passage, gap)
                held = shared.value.hits(h)
                if held.any():
                    back = words[::-1]
                    for x, p in zip(signed(h[held]).tolist(), at[held].tolist(), strict=True):
                        from_end = len(words) - p
                        out.append((x, doc_id, text_hash, p, back[from_end : from_end + gap].tobytes(), words[p + stem : p + stem + gap].tobytes()))
            if out:
                yield batch(schema, list(zip(*out, strict=True)))

    kept = scratch.save(hashed_input(docs).mapInArrow(retain, "stem long, doc_id long, text_hash long, pos int, before binary, after binary"), "suffixes")
    each = scratch.save(kept.groupBy("stem").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first")).where("n > 1"), "groups")

    def placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
        first = [F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_hash"), F.col("first.pos").alias("first_pos")]
        return rows.join(groups, "stem").select("stem", "before", "after", "doc_id", "text_hash", "pos", "n", *first)

    def compare(batches):
        """Of rows sorted by stem each suffix's match; a stem's suffixes, HOT at most, are held together."""
        held, out = [], []

        def close():
            reach = [[0] * len(held), [0] * len(held)]  # to the left and to the right
            for k, best in enumerate(reach, 1):
                order = sorted(range(len(held)), key=lambda i: held[i][k])
                for i, j in zip(order, order[1:], strict=False):
                    c = common(held[i][k], held[j][k])
                    best[i], best[j] = max(best[i], c), max(best[j], c)
            out.extend(run(x[3:], l, stem + r) for x, l, r in zip(held, *reach, strict=True))
            held.clear()

        for part in batches:
            for row in zip(*(part.column(k).to_pylist() for k in ("stem", "before", "after", *_PLACES)), strict=True):
                if held and row[0] != held[0][0]:
                    close()
                held.append(row)
            if out:
                yield batch(RUN, list(zip(*out, strict=True)))
                out.clear()
        close()
        if out:
            yield batch(RUN, list(zip(*out, strict=True)))

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    large = each.where(F.col("n") > HOT)
    some_large = not large.isEmpty()
    rest = kept.join(large.select("stem"), "stem", "left_anti") if some_large else kept
    matched = placed(rest, each.where(F.col("n") <= HOT)).repartition(n, "stem").sortWithinPartitions("stem").mapInArrow(compare, _RUN_DDL)
    if some_large:
        hot = scratch.save(placed(kept, large), "hot")
        for side in ("before", "after"):
            matched = matched.unionByName(_by_range(hot, side, stem, n, scratch))
    by_doc = matched.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "n", "first_doc_id", "later"))).alias("runs"))

    def join(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("n_words", pa.int32()), ("n_occurrences", pa.int64()), ("first_doc_id", pa.int64()), ("is_first", pa.bool_())])
        for part in batches:
            out = []
            for doc_id, text_hash, runs in zip(*(part.column(k).to_pylist() for k in ("doc_id", "text_hash", "runs")), strict=True):
                now = None
                for x in runs:
                    if now and x["lo"] <= now[1]:
                        now = [now[0], max(now[1], x["hi"]), max(now[2], x["n"]), min(now[3], x["first_doc_id"]), now[4] or x["later"]]
                    else:
                        if now:
                            out.append((doc_id, text_hash, now[0], now[1], now[1] - now[0], now[2], now[3], not now[4]))
                        now = [x["lo"], x["hi"], x["n"], x["first_doc_id"], x["later"]]
                out.append((doc_id, text_hash, now[0], now[1], now[1] - now[0], now[2], now[3], not now[4]))
            if out:
                yield batch(schema, list(zip(*out, strict=True)))

    ddl = "doc_id long, text_hash long, start_word int, end_word int, n_words int, n_occurrences long, first_doc_id long, is_first boolean"
    found = scratch.save(by_doc.mapInArrow(join, ddl), "spans")
    scratch.drop("stems", "suffixes", "groups", "hot", "before", "after")
    return found


def _by_range(hot: DataFrame, side: str, stem: int, n: int, scratch: Scratch) -> DataFrame:
    """The matches of suffixes to one side, from a sort by stem and that side's words over n partitions by range."""
    order = ["stem", side, "doc_id", "text_hash", "pos"]

    def found(a: tuple, b: tuple) -> list[tuple]:
        """Runs of two neighbours (stem, words, place)."""
        if a[0] != b[0]:
            return []
        c = common(a[1], b[1])
        return [run(x[2:], c, stem) if side == "before" else run(x[2:], 0, stem + c) for x in (a, b)]

    def neighbours(batches):
        """Runs, and the partition's first and last row beside null runs."""
        from pyspark import TaskContext

        schema, part = pa.schema([*RUN, ("part", pa.int32()), ("edge", pa.list_(pa.struct(_EDGE)))]), TaskContext.get().partitionId()
        first = last = None
        for rows in batches:
            out = []
            for row in zip(*(rows.column(k).to_pylist() for k in ("stem", side, *_PLACES)), strict=True):
                if last:
                    out += found(last, row)
                first, last = first or row, row
            if out:
                yield batch(schema, [*zip(*out, strict=True), [None] * len(out), [None] * len(out)])
        if last:
            edge = [dict(zip((f.name for f in _EDGE), x, strict=True)) for x in (first, last)]
            yield batch(schema, [*([None] for _ in RUN), [part], [edge]])

    rows = hot.select(*order, *(p for p in _PLACES if p not in order))
    edges = "part int, edge array<struct<stem: long, words: binary, doc_id: long, text_hash: long, pos: int, n: long, first_doc_id: long, first_hash: long, first_pos: int>>"
    runs = scratch.save(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(neighbours, f"{_RUN_DDL}, {edges}"), side)
    ends = [r[0] for r in runs.where("part IS NOT NULL").orderBy("part").select("edge").collect()]  # two rows a partition
    across = [x for a, b in zip(ends, ends[1:], strict=False) for x in found((a[1][0], bytes(a[1][1]), *a[1][2:]), (b[0][0], bytes(b[0][1]), *b[0][2:]))]
    runs = runs.where("part IS NULL").select([f.name for f in RUN])
    return runs.unionByName(hot.sparkSession.createDataFrame(across, _RUN_DDL)) if across else runs


_EDGE = [pa.field(k, t) for k, t in (("stem", pa.int64()), ("words", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("n", pa.int64()), ("first_doc_id", pa.int64()), ("first_hash", pa.int64()), ("first_pos", pa.int32()))]


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
