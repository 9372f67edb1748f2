"""Substring dedup: remove every word covered by a window of words that also starts earlier in the corpus.

Matching statistics come from suffix automata of reference shards. A shard may not grow with the corpus, so that texts
are routed to shards by content:

1. Each window of `window` words picks an anchor, its least-hashed run of `ANCHOR` words. Equal windows pick equal
   anchors. Neighbouring windows share one, and together they make a context: the words that these windows cover.
2. Anchors that occur once can't belong to a repeated window. The others go into a bit filter of bounded size (a hit too
   many costs work only), and a second reading of the texts keeps their contexts as hashes.
3. Of equal contexts all but the earliest are removed outright: each of their windows starts earlier there.
4. The earliest of each context, where its anchor has several contexts, are the reference strings. Those of an anchor meet
   in one shard; each shard's automaton is built in the task that streams its contexts, which gives for each window the
   earliest start of its words.
5. An anchor with more than `SHARD` contexts, as at the edge of a passage that very many documents share, has its windows
   compared by hash in an aggregate with map-side combining instead, for an automaton of it would not be bounded.

No shard is broadcast to all documents: the number of shards grows with the corpus, and its square would be streamed.

Cases: a null or empty text has no words; fewer words than a window: nothing is removed; rows with a null doc_id have no
place in the order and are kept whole; rows that repeat a doc_id are one document to the order, in which only the doc_id and
the start count: of equal windows in two such rows the one that starts earlier in its text is the earlier, and of equal starts
neither, so that rows of the same text get the same result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import BitFilter, Scratch, batch, hashed_words, leftmost_minima, mix, rolling, signed, text_chunks

#: Words of an anchor, contexts of an anchor that an automaton takes, contexts that are put into one automaton.
ANCHOR, SHARD, TOGETHER = 8, 2000, 512


def contexts(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) for each run of windows that share an anchor."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = rolling(words, ANCHOR)
    at = leftmost_minima(grams, window - ANCHOR + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return mix(grams[at[first]]), first, last


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def hashed_input(docs: DataFrame) -> DataFrame:
    """The rows that have a doc_id, and a hash of the text that tells rows of one doc_id apart."""
    return _input(docs).where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(b""))))


def repeated_hashes(docs: DataFrame, hashes_of, scratch: Scratch, name: str) -> BitFilter:
    """A filter of the hashes that hashes_of(words) gives more than once over all documents."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for _, texts in text_chunks(batches):
            found, n = np.unique(np.concatenate([hashes_of(w) for w in hashed_words(texts)]), return_counts=True)
            yield batch(schema, [signed(found), n])

    rows = _input(docs).where("doc_id IS NOT NULL").mapInArrow(count, "h long, n long")
    repeated = scratch.save(rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), name)
    return BitFilter.build(repeated, "h", repeated.count())


def earlier_windows(shard: list[tuple[tuple, int, np.ndarray]], window: int) -> list[tuple[tuple, int, int]]:
    """(document, first, last window) for the windows of a shard's contexts (document, start, words) whose words also
    start earlier in the shard. A document is ordered by the first of what it holds."""
    shard = sorted(shard, key=lambda x: x[:2])
    rank = {x: k for k, x in enumerate(sorted({doc[0] for doc, _, _ in shard}))}
    follow: list[dict] = [{}]
    link, size, first = [-1], [0], [1 << 200]
    for doc, start, words in shard:
        last, place = 0, (rank[doc[0]] << 40) + start
        for end, word in enumerate(words.tolist()):
            where = place + end
            if (known := follow[last].get(word)) is not None:
                if size[known] == size[last] + 1:
                    if where < first[known]:
                        first[known] = where
                    last = known
                    continue
                copy = len(size)
                follow.append(dict(follow[known]))
                link.append(link[known])
                size.append(size[last] + 1)
                first.append(min(first[known], where))
                at = last
                while at >= 0 and follow[at].get(word) == known:
                    follow[at][word] = copy
                    at = link[at]
                link[known] = last = copy
                continue
            new = len(size)
            follow.append({})
            size.append(size[last] + 1)
            first.append(where)
            link.append(0)
            at = last
            while at >= 0 and word not in follow[at]:
                follow[at][word] = new
                at = link[at]
            if at >= 0:
                known = follow[at][word]
                if size[known] == size[at] + 1:
                    link[new] = known
                else:
                    copy = len(size)
                    follow.append(dict(follow[known]))
                    link.append(link[known])
                    size.append(size[at] + 1)
                    first.append(first[known])
                    while at >= 0 and follow[at].get(word) == known:
                        follow[at][word] = copy
                        at = link[at]
                    link[known] = link[new] = copy
            last = new
    for state in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
        if first[state] < first[link[state]]:
            first[link[state]] = first[state]
    found = []
    for doc, start, words in shard:
        state, place = 0, (rank[doc[0]] << 40) + start
        for end, word in enumerate(words.tolist()):
            state = follow[state][word]  # each context is a path of its own, so that the match is all read so far
            while size[link[state]] >= window:
                state = link[state]
            if end + 1 >= window and first[state] < place + end:
                at = start + end + 1 - window
                if found and found[-1][0] == doc and found[-1][2] == at - 1:
                    found[-1] = (doc, found[-1][1], at)
                else:
                    found.append((doc, at, at))
    return found


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, lo, hi): the windows lo to hi of the document start earlier, too."""
    spark = docs.sparkSession
    rows = hashed_input(docs)
    shared = spark.sparkContext.broadcast(repeated_hashes(docs, lambda w: contexts(w, window)[0], scratch, "repeated"))

    def seen(rows_, texts, keep, with_words: bool):
        out = [[] for _ in range(6)]
        for doc_id, text_hash, words in zip(rows_.column("doc_id").to_pylist(), rows_.column("text_hash").to_pylist(), hashed_words(texts), strict=True):
            h, lo, hi = contexts(words, window)
            held = shared.value.hits(h)
            if not held.any():
                continue
            h, lo, hi = h[held], lo[held], hi[held]
            whole = rolling(words, window)
            c = mix(mix(whole[lo] + (hi - lo).astype(np.uint64)) + whole[hi])
            if keep is not None:
                of_doc = (doc_id & (1 << 64) - 1) << 20 & (1 << 64) - 1
                held = keep.hits(c ^ np.uint64(of_doc) ^ lo.astype(np.uint64))
                h, lo, hi, c = h[held], lo[held], hi[held], c[held]
            out[0].append(signed(h))
            out[1].extend([words[a : b + window].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)] if with_words else [signed(c)])
            out[2].append(np.full(len(h), doc_id))
            out[3].append(np.full(len(h), text_hash))
            out[4].append(lo.astype(np.int32))
            out[5].append(hi.astype(np.int32))
        return [x if with_words and k == 1 else np.concatenate(x) for k, x in enumerate(out)] if out[0] else None

    def hashes(batches):
        schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
        for part, texts in text_chunks(batches):
            if (out := seen(part, texts, None, False)) is not None:
                yield batch(schema, out)

    place = F.struct("doc_id", "lo")
    later = ~place.eqNullSafe(F.col("first"))
    held = scratch.save(rows.mapInArrow(hashes, "h long, c long, doc_id long, text_hash long, lo int, hi int"), "contexts")
    each = scratch.save(held.groupBy("h", "c").agg(F.min(place).alias("first"), F.count("*").alias("n")), "distinct")
    copies = held.join(each.where("n > 1").select("h", "c", "first"), ["h", "c"]).where(later).select("doc_id", "text_hash", "lo", "hi")
    several = scratch.save(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "several")
    key = F.col("c").bitwiseXOR(F.shiftleft("first.doc_id", 20)).bitwiseXOR(F.col("first.lo").cast("long"))
    asked = scratch.save(each.join(several.select("h"), "h").select(key.alias("k")), "asked")
    wanted = spark.sparkContext.broadcast(BitFilter.build(asked, "k", asked.count()))

    def strings(batches):
        schema = pa.schema([("h", pa.int64()), ("words", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
        for part, texts in text_chunks(batches):
            if (out := seen(part, texts, wanted.value, True)) is not None:
                yield batch(schema, out)

    reference = scratch.save(rows.mapInArrow(strings, "h long, words binary, doc_id long, text_hash long, lo int, hi int"), "reference")
    hot = several.where(F.col("n") > SHARD).select("h")

    def stream(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

        def compare(shard):
            found = [(doc_id, row, lo, hi) for (doc_id, *rows_), lo, hi in earlier_windows(shard, window) for row in rows_]
            return [batch(schema, list(zip(*found, strict=True)))] if found else []

        def contexts_of(own):
            """A context of each place and words once, with all rows that have it there."""
            return [((doc_id, *sorted(rows_)), lo, np.frombuffer(words, np.uint64)) for (doc_id, lo, words), rows_ in own.items()]

        shard, own, h = [], {}, None
        for part in batches:
            for x, words, doc_id, text_hash, lo in zip(*(part.column(k).to_pylist() for k in ("h", "words", "doc_id", "text_hash", "lo")), strict=True):
                if x != h:
                    if len(own) > 1:
                        shard += contexts_of(own)
                        if len(shard) >= TOGETHER:
                            yield from compare(shard)
                            shard = []
                    h, own = x, {}
                own.setdefault((doc_id, lo, words), set()).add(text_hash)
        if len(own) > 1:
            shard += contexts_of(own)
        if shard:
            yield from compare(shard)

    by_automaton = (
        reference.join(hot, "h", "left_anti").select("h", "words", "doc_id", "text_hash", "lo")
        .repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "h").sortWithinPartitions("h").mapInArrow(stream, "doc_id long, text_hash long, lo int, hi int")
    )

    def split(batches):
        schema = pa.schema([("w", pa.int64()), ("v", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int32())])
        for part in batches:
            for words, doc_id, text_hash, lo in zip(*(part.column(k).to_pylist() for k in ("words", "doc_id", "text_hash", "lo")), strict=True):
                w = rolling(np.frombuffer(words, np.uint64), window)
                v = rolling(mix(np.frombuffer(words, np.uint64) ^ np.uint64(window)), window)
                yield batch(schema, [signed(w), signed(v), np.full(len(w), doc_id), np.full(len(w), text_hash), np.arange(lo, lo + len(w), dtype=np.int32)])

    # both readings of the hot contexts take the same small table
    alone = scratch.save(reference.join(hot, "h", "left_semi").mapInArrow(split, "w long, v long, doc_id long, text_hash long, lo int"), "hot")
    firsts = alone.groupBy("w", "v").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    by_hash = alone.join(firsts, ["w", "v"]).where(later).select("doc_id", "text_hash", "lo", F.col("lo").alias("hi"))
    return copies.unionByName(by_automaton).unionByName(by_hash)


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space)."""
    scratch = Scratch(docs.sparkSession, "substring")
    found = scratch.save(repeated_windows(docs, window, scratch).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "found")
    scratch.drop("repeated", "contexts", "distinct", "several", "asked", "reference", "hot")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def remove(batches):
        for part, texts in text_chunks(batches):
            out = []
            runs = part.column("runs")
            for k, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), texts, strict=True)):
                words = text.split()
                if not runs[k].is_valid:
                    out.append((doc_id, len(words), 0, b" ".join(words).decode()))
                    continue
                lo, hi = (runs[k].values.field(x).to_numpy().astype(np.int64) for x in ("lo", "hi"))
                edge = np.zeros(len(words) + window + 1, np.int64)
                np.add.at(edge, np.minimum(lo, len(words)), 1)
                np.add.at(edge, np.minimum(hi + window, len(words)), -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                out.append((doc_id, len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()))
            yield batch(schema, list(zip(*out, strict=True)))

    rows = _input(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(b""))))
    return rows.join(found, ["doc_id", "text_hash"], "left").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
