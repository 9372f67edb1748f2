"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct shingles (tokens). Documents with the same set form a class; one text of each class
takes part in the join.

1. Classes of tokens. A count sketch over all documents gives each token a level: the doublings of how often it occurs at
   most. Counters of a full sketch hold other tokens too, about as many each, and what nine in ten counters hold at least is
   taken off all of them. Tokens of at most `RARE` occurrences beyond that are rare, the others frequent. The tokens of a set
   are ordered by level, then hash. Any order that all sets share is sound for prefixes, and rare tokens have small buckets at
   any size of the corpus; where the spread of the counters exceeds `RARE` more tokens become frequent.
2. Prefixes. Two sets that are similar enough share k tokens among the first |x| - ceil(t |x|) + k tokens of each. Prefixes
   are extended to k = 1 + |x| / 32, the lesser k of two sets counting. Rare tokens of a prefix are indexed singly, and
   pairs that share fewer than k of them aren't candidates by them.
3. Token combinations. Where a set's rare tokens don't fill its prefix, the prefix is extended to the whole set and its
   combinations are indexed: tokens are dealt by hash into one part more than two similar sets of that size class can
   differ in, so that one part is equal in both, and each part's tokens make one combination. A pair that shares only
   frequent tokens in its prefixes has such an extended prefix on both sides and shares a combination.
4. Verify. First each set meets the least set of the bucket that it most often shares, which joins groups of copies as
   stars, not as all their pairs. Then pairs of a bucket whose sets are in different components yet are compared, where the
   bucket has at most `CROWD` such pairs for each of its sets.
5. Crowds. The sets of a larger bucket are compared with one common set p. Any set will do; best is that of fewest rare
   tokens, which has the fewest edits of its own, so that each bucket proposes it, and the proposal that its sets usually
   meet in all their buckets is taken. Of x only its difference from p is kept: what it has and p lacks, from rare to frequent,
   then what it lacks, from frequent to rare. x and y link if these differences differ in at most K tokens. If they share
   none, both are so near to p that both link with p itself, which is tested. Else their first shared token has places in
   the two differences that add up to K at most, so that one of them is at K / 2 at most: those places are indexed, places
   up to K look them up. The own edits of near copies come first, so that copies of one text that differ by too much don't
   meet, and those that link with p have its component.
6. Components: of at most `ONE_TASK` edges in one task, of more by alternating large-star and small-star steps.
7. Links, where they are asked for: the candidate pairs within a component of stars are compared as well, so that all links
   of a set are counted. These pairs grow with the square of a group of near copies.

Cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer words than a shingle: the
whole sequence is the one token; rows that repeat a doc_id give a row each; a null doc_id gets a row and is linked with
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import BitFilter, Scratch, batch, hashed_words, mix, rolling, signed, text_chunks

#: Counters of the sketch, slices in which it is added up, and the most occurrences of a rare token.
COUNTERS, SLICES, RARE = 1 << 21, 32, 256
#: Pairs of different components in a bucket, for each set in it, beyond which it is a crowd.
CROWD = 16
#: What a shared combination counts for: more than any number of shared tokens.
COMBINED = 1_000_000
#: Edges (16 bytes each) whose components one task finds; each round of steps costs the driver two plans of many joins.
ONE_TASK = 1 << 20


def token_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    sets = []
    for words in hashed_words(texts, lower=True):
        n = min(size, len(words))
        sets.append(np.unique(mix(rolling(words, n) + np.uint64(n))) if n else np.zeros(0, np.uint64))
    return sets


def needed(n: int, percent: int) -> int:
    """Tokens of a set of n that a similar set must share: ceil(percent n / 100)."""
    return (percent * n + 99) // 100


def size_class(n: int, percent: int) -> int:
    """Sets whose sizes are within the ratio percent / 100 are of the same or of neighbouring classes."""
    k, start = 0, 1
    while n >= (start := start * 100 // percent + 1):
        k += 1
    return k


def parts_of(k: int, percent: int) -> int:
    """One more than the tokens in which a set of class k and a similar set that isn't larger can differ."""
    start = 1
    for _ in range(k):
        start = start * 100 // percent + 1
    largest = start * 100 // percent
    return (100 - percent) * 2 * largest // (100 + percent) + 1


def extension(n: int) -> int:
    """Tokens that two similar sets, of n tokens or more, must share in their extended prefixes."""
    return 1 + n // 32


def levels_of(counters: np.ndarray) -> np.ndarray:
    """By counter: the doublings of what it holds beyond the tenth part of counters that hold least."""
    least = int(np.quantile(counters, 0.1))
    return np.concatenate([np.ceil(np.log2(np.maximum(x - least, 1))).astype(np.uint8) for x in np.array_split(counters, SLICES)])


def is_rare(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(own & np.uint64(len(levels) - 1)).astype(np.int64)] <= RARE.bit_length() - 1


def signatures(own: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rare tokens of the set's extended prefix, its combinations if that prefix holds frequent tokens)."""
    n = len(own)
    prefix = n - needed(n, percent) + extension(n)
    level = levels[(own & np.uint64(len(levels) - 1)).astype(np.int64)]
    few = is_rare(own, levels)
    rare = own[few]
    singles = mix(rare[np.argsort(level[few], kind="stable")[:prefix]])
    if len(rare) >= prefix:
        return singles, singles[:0]
    found = []
    k = size_class(n, percent)
    for at in (k, k + 1):
        m = parts_of(at, percent)
        sums = np.arange(m, dtype=np.uint64) + np.uint64((at + 1) << 32)
        np.add.at(sums, (mix(own + np.uint64(7)) % np.uint64(m)).astype(np.int64), own)
        found.append(mix(mix(sums) + np.uint64(at)))
    return singles, np.concatenate(found)


def differing(n: int, m: int, percent: int) -> int:
    """Tokens in which similar sets of n and m tokens differ at most."""
    return (n + m) * (100 - percent) // (100 + percent)


def difference(own: np.ndarray, other: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The tokens of only one of two sorted sets: of the first from rare to frequent, then of the other from frequent to rare."""
    parts = []
    for tokens, sign in ((np.setdiff1d(own, other, assume_unique=True), 1), (np.setdiff1d(other, own, assume_unique=True), -1)):
        level = levels[(tokens & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.int64)
        parts.append(tokens[np.argsort(sign * level, kind="stable")])
    return np.concatenate(parts)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _sets_and_sketch(docs: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, cls) for each row, and the level of each counter."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])

    def read(batches):
        sketch = np.zeros(COUNTERS, np.uint16)
        for part, texts in text_chunks(batches):
            sets = token_sets(texts, size)
            at, n = np.unique((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), return_counts=True)
            sketch[at] = np.minimum(sketch[at] + n, 65535)
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            none = [None] * len(sets)
            cls = [c if len(s) else None for c, s in zip(signed(cls).tolist(), sets, strict=True)]
            yield batch(schema, [part.column("doc_id").to_pylist(), list(map(len, sets)), cls, none, none])
        for k, x in enumerate(np.split(sketch, SLICES)):
            if x.any():
                yield batch(schema, [[None], [None], [None], [k], [zlib.compress(x.tobytes(), 1)]])

    both = scratch.save(_input(docs).mapInArrow(read, "doc_id long, n long, cls long, slice int, counts binary"), "sets")

    def add(batches):
        own: dict[int, np.ndarray] = {}
        for part in batches:
            for k, counts in zip(part.column("slice").to_pylist(), part.column("counts").to_pylist(), strict=True):
                own[k] = own.get(k, 0) + np.frombuffer(zlib.decompress(counts), np.uint16).astype(np.int64)
        out = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
        for k, x in own.items():
            yield batch(out, [[k], [zlib.compress(x.tobytes(), 1)]])

    total = np.zeros(COUNTERS, np.int64)
    width = COUNTERS // SLICES
    for k, x in both.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():  # COUNTERS numbers
        total[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(x), np.int64)
    return both.where("slice IS NULL").select("doc_id", "n", "cls"), levels_of(total)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the edges a, b, the least node that each reaches)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at.reshape(-1), 2)
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label != (up := label[label])).any():
            label = up
    return nodes, nodes[label]


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the least node reachable, for the nodes of the edges (a, b)."""
    smaller, larger = F.least("a", "b"), F.greatest("a", "b")
    edges = scratch.save(edges.select(larger.alias("a"), smaller.alias("b")).where("a <> b").distinct(), f"{name}0")
    if edges.count() <= ONE_TASK:

        def find(batches):
            held = [tuple(part.column(c).to_numpy() for c in "ab") for part in batches]
            if held:
                yield batch(pa.schema([("node", pa.int64()), ("component", pa.int64())]), least_reachable(*map(np.concatenate, zip(*held, strict=True))))

        found = scratch.save(edges.coalesce(1).mapInArrow(find, "node long, component long"), name)
        scratch.drop(f"{name}0")
        return found
    state, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.unionByName(edges.join(least, "a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        edges = scratch.save(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.expr("count(DISTINCT a)")).first()
        if now == state and now[0] == now[2]:  # nothing changes and each node has one edge, to its least
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = now


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other sets that link with this text's); without links that column is left out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    sets, levels = _sets_and_sketch(docs, size, scratch)
    held = spark.sparkContext.broadcast(levels)  # COUNTERS bytes
    # a class is known by its least doc_id, of which alone the texts are read again
    classes = scratch.save(sets.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "classes")

    def of_nodes(batches, keep: BitFilter):
        """The rows whose doc_id a filter of nodes holds."""
        for part in batches:
            keys = np.array([xxhash.xxh64_intdigest(struct.pack("<q", d), 42) for d in part.column("doc_id").to_pylist()], np.uint64)
            yield part.filter(pa.array(keep.hits(keys)))

    representatives = spark.sparkContext.broadcast(BitFilter.build(classes.select(F.xxhash64("node").alias("k")), "k", classes.count()))

    def sign(batches):
        schema = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("combined", pa.bool_())])
        for _, texts in text_chunks(of_nodes(batches, representatives.value)):
            sigs, cls, combined = [], [], []
            for own in token_sets(texts, size):
                if len(own):
                    both = signatures(own, held.value, percent)
                    sigs += both
                    cls.append(np.full(len(both[0]) + len(both[1]), xxhash.xxh64_intdigest(own.tobytes()), np.uint64))
                    combined += [np.zeros(len(both[0]), bool), np.ones(len(both[1]), bool)]
            if sigs:
                yield batch(schema, [signed(np.concatenate(sigs)), signed(np.concatenate(cls)), np.concatenate(combined)])

    def share(batches):
        """Of rows sorted by sig those whose sig several classes have, with the least of these. A rare token's bucket is
        held as a whole: the sketch bounds it."""
        schema = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("lo", pa.int64())])
        left = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def several(sig, cls):
            if not len(sig):
                return None
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            once = np.append(True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]))  # equal texts give equal rows
            sig, cls = sig[once], cls[once]
            starts = np.flatnonzero(np.diff(sig, prepend=~sig[0]))
            n = np.diff(starts, append=len(sig))
            least, most = np.minimum.reduceat(cls, starts), np.maximum.reduceat(cls, starts)
            keep = np.repeat(least != most, n)
            return batch(schema, [sig[keep], cls[keep], np.repeat(least, n)[keep]])

        for part in batches:
            sig, cls = (np.concatenate([a, part.column(c).to_numpy()]) for a, c in zip(left, ("sig", "cls"), strict=True))
            cut = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
            left = sig[cut:], cls[cut:]
            if (found := several(sig[:cut], cls[:cut])) is not None:
                yield found
        if (found := several(*left)) is not None:
            yield found

    index = scratch.save(_input(docs).where("doc_id IS NOT NULL").mapInArrow(sign, "sig long, cls long, combined boolean"), "index")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    singles = index.where("NOT combined").select("sig", "cls").repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(share, "sig long, cls long, lo long")
    # combinations can be as frequent as there are copies: combined before the shuffle, and joined, where skew is split
    combined = index.where("combined").select("sig", "cls")
    lows = combined.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("sig", "lo")
    weighed = singles.withColumn("weight", F.lit(1)).unionByName(combined.join(lows, "sig").distinct().withColumn("weight", F.lit(COMBINED)))
    buckets = scratch.save(weighed, "buckets")
    scratch.drop("index")

    def alike(pairs: DataFrame, a: str, b: str) -> DataFrame:
        """The pairs of classes whose sizes and shared signatures allow them to link."""
        x, y = (classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}")) for c in (a, b))
        least = F.least(f"n_{a}", f"n_{b}")
        return pairs.join(x, a).join(y, b).where((F.greatest(f"n_{a}", f"n_{b}") * percent <= 100 * least) & (F.col("shared") >= 1 + F.expr(f"least(n_{a}, n_{b}) div 32")))

    def tokens_of(wanted: DataFrame, name: str) -> DataFrame:
        """(cls, tokens, rare: how many of them are) of classes: the texts of their least documents are read again."""
        nodes = scratch.save(wanted.distinct().join(classes, "cls").select("cls", "node", F.xxhash64("node").alias("k")), f"{name}-nodes")
        keep = spark.sparkContext.broadcast(BitFilter.build(nodes, "k", nodes.count()))

        def again(batches):
            schema = pa.schema([("cls", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64())), ("rare", pa.int64())])
            for rows, texts in text_chunks(of_nodes(batches, keep.value)):
                own = token_sets(texts, size)
                cls = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], np.uint64)
                rare = [int(is_rare(x, held.value).sum()) for x in own]
                yield batch(schema, [signed(cls), rows.column("doc_id").to_pylist(), list(map(signed, own)), rare])

        read = _input(docs).where("doc_id IS NOT NULL").mapInArrow(again, "cls long, doc_id long, tokens array<long>, rare long")
        own = scratch.save(read.select("cls", "doc_id", "tokens", "rare"), f"{name}-tokens")
        # the filter lets a few others pass, among them copies; without these a class has one row, unless a row is repeated
        other = scratch.save(own.select("cls", "doc_id").join(nodes.select("cls", "node"), "cls", "left").where("NOT doc_id <=> node").select("cls", "doc_id").distinct(), f"{name}-other")
        own = own.join(other, ["cls", "doc_id"], "left_anti").drop("doc_id")
        if not own.groupBy("cls").count().where("count > 1").isEmpty():
            own = scratch.save(own.dropDuplicates(["cls"]), f"{name}-once")
        scratch.drop(f"{name}-nodes")
        return own

    def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
        """Of pairs (x, y) of classes those that link, by their tokens."""
        left, right = (own.select(F.col("cls").alias(c), F.col("tokens").alias(f"t_{c}")) for c in ("x", "y"))
        both = F.size(F.array_intersect("t_x", "t_y"))
        met = pairs.select("x", "y").join(left, "x").join(right, "y")
        return met.where(100 * both >= percent * (F.size("t_x") + F.size("t_y") - both)).select("x", "y")

    star = alike(buckets.where("cls <> lo").groupBy("cls", "lo").agg(F.sum("weight").alias("shared")), "cls", "lo")
    best = star.groupBy("cls").agg(F.max_by("lo", F.struct("shared", "lo")).alias("best"))
    starred = scratch.save(best.select(F.col("cls").alias("x"), F.col("best").alias("y")), "starred")
    first = scratch.save(verified(starred, tokens_of(starred.select(F.explode(F.array("x", "y")).alias("cls")), "first")), "first")
    scratch.drop("starred", "first-tokens", "first-other", "first-once")
    named = classes.select("cls", "node")

    def edges(links: DataFrame) -> DataFrame:
        x, y = named.toDF("x", "a"), named.toDF("y", "b")
        return links.join(x, "x").join(y, "y").select("a", "b")

    known = scratch.save(components(edges(first), scratch, "star").join(named, "node", "right").select("cls", F.coalesce("component", "node").alias("component")), "known")
    in_star = buckets.select("sig", "cls", "weight").join(known.join(classes.select("cls", "n"), "cls"), "cls")
    several = in_star.groupBy("sig").agg(F.min("component").alias("m"), F.max("component").alias("k"), F.count("*").alias("held")).where("m <> k").select("sig", "held")
    # the common set of a crowd: the least of those that its sets met first
    rest = scratch.save(in_star.join(several, "sig"), "rest")
    of_component = rest.where(F.col("held") > CROWD).groupBy("sig", "component").agg(F.count("*").alias("c"))
    many = of_component.groupBy("sig").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own")).where(F.col("c") * F.col("c") - F.col("own") > 2 * CROWD * F.col("c"))
    many = many.select("sig")
    few = rest.join(many, "sig", "left_anti")
    x, y = few.select(F.col("cls").alias("x"), "sig", F.col("component").alias("c"), "n", "weight"), few.select(F.col("cls").alias("y"), "sig", F.col("component").alias("d"), F.col("n").alias("m"))
    across = x.join(y, "sig").where((F.col("c") < F.col("d")) & (F.greatest("n", "m") * percent <= 100 * F.least("n", "m")))
    scratch.drop()
    across = scratch.save(alike(across.groupBy("x", "y").agg(F.sum("weight").alias("shared")), "x", "y").select("x", "y"), "across")
    crowded = rest.join(many, "sig").select("sig", "cls", "component", "n")
    own = tokens_of(across.select(F.explode(F.array("x", "y")).alias("cls")).unionByName(crowded.select("cls")), "second")
    crowded = crowded.join(own.select("cls", "rare"), "cls")
    crowded = scratch.save(crowded, "crowded")

    def usual(rows: DataFrame, key: str) -> DataFrame:
        """The p that most rows of a key have."""
        return rows.groupBy(key, "p").agg(F.count("*").alias("c")).groupBy(key).agg(F.max(F.struct("c", "p")).alias("x")).select(key, F.col("x.p").alias("p"))

    cleanest = crowded.groupBy("sig").agg(F.min(F.struct("rare", "cls", "component")).alias("p"))
    usually = usual(crowded.select("sig", "cls").join(cleanest, "sig"), "cls")
    common = usual(crowded.select("sig", "cls").join(usually, "cls"), "sig").select("sig", F.col("p.cls").alias("common"), F.col("p.component").alias("its"))
    crowd = scratch.save(crowded.join(common, "sig").select("cls", "component", "n", "common", "its").distinct(), "crowd")
    scratch.drop("crowded", "rest")

    def differences(batches):
        """Links with the common set, and the places of the first tokens of the differences."""
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("sig", pa.int64()), ("cls", pa.int64()), ("component", pa.int64()), ("n", pa.int32()), ("size", pa.int32()), ("at", pa.int32())])
        for part in batches:
            links, sigs, of = [], [], []
            for cls, component, common, its, own, other in zip(*(part.column(k) for k in ("cls", "component", "common", "its", "tokens", "others")), strict=True):
                cls, component, common = cls.as_py(), component.as_py(), common.as_py()
                own, other = (a.values.to_numpy().view(np.uint64) for a in (own, other))
                tokens, n = difference(own, other, held.value), len(own)
                if cls != common and len(tokens) <= differing(n, len(other), percent):
                    links.append((cls, common))
                    component = its.as_py()
                first = tokens[: differing(n, 100 * n // percent, percent) + 1]
                sigs.append(mix(first ^ mix(np.full(1, common & (1 << 64) - 1, np.uint64))))
                of.append((cls, component, n, len(tokens)))
            if links:
                yield batch(schema, [*zip(*links, strict=True), *([None] * len(links) for _ in range(6))])
            sizes = list(map(len, sigs))
            if any(sizes):
                none = pa.nulls(sum(sizes), pa.int64())
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                yield batch(schema, [none, none, signed(np.concatenate(sigs)), *(np.repeat(np.array(x), sizes) for x in zip(*of, strict=True)), at])

    other = own.select(F.col("cls").alias("common"), F.col("tokens").alias("others"))
    parted = crowd.join(own.select("cls", "tokens"), "cls").join(other, "common").select("cls", "component", "common", "its", "tokens", "others")
    parted = scratch.save(parted.mapInArrow(differences, "x long, y long, sig long, cls long, component long, n int, size int, at int"), "parted")
    indexed = F.col("at") <= F.expr(f"(n + 100 * n div {percent}) * {100 - percent} div {100 + percent} div 2")
    places = parted.where("sig IS NOT NULL").select("sig", "cls", "component", "n", "size", "at")
    met = places.groupBy("sig").agg(F.min("component").alias("m"), F.max("component").alias("k"), F.max(indexed).alias("found")).where("m <> k AND found").select("sig")
    places = scratch.save(places.join(met, "sig"), "places")
    scratch.drop("crowd")
    x = places.where(indexed).select("sig", F.col("cls").alias("x"), F.col("component").alias("c"), "n", F.col("size").alias("a"), F.col("at").alias("i"))
    y = places.select("sig", F.col("cls").alias("y"), F.col("component").alias("d"), F.col("n").alias("m"), F.col("size").alias("b"), F.col("at").alias("j"))
    # places, and what can be shared from there on: 2 |shared| >= a + b - K
    most = F.expr(f"(n + m) * {100 - percent} div {100 + percent}")
    close = (F.col("i") + F.col("j") <= most) & (2 * F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) >= F.col("a") + F.col("b") - most)
    near = x.join(y, "sig").where((F.col("c") != F.col("d")) & (F.greatest("n", "m") * percent <= 100 * F.least("n", "m")) & close).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    second = verified(across.unionByName(near).distinct(), own).unionByName(parted.where("x IS NOT NULL").select("x", "y"))
    second = scratch.save(second.distinct(), "second")
    scratch.drop("across", "second-tokens", "second-other", "second-once", "parted", "places")
    final = components(edges(first.unionByName(second)), scratch, "all")
    out = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id")]
    if not links:
        of_class = scratch.save(classes.join(final, "node", "left").select("cls", F.coalesce("component", "node").alias("component_id")), "of_class")
        scratch.drop("buckets", "first", "second", "known", "classes")
        return sets.join(of_class, "cls", "left").select(*out)
    # within a component of stars too
    x, y = in_star.select(F.col("cls").alias("x"), "sig", "component", "n", "weight"), in_star.select(F.col("cls").alias("y"), "sig", "component", F.col("n").alias("m"))
    inside = x.join(y, ["sig", "component"]).where((F.col("x") < F.col("y")) & (F.greatest("n", "m") * percent <= 100 * F.least("n", "m")))
    inside = scratch.save(alike(inside.groupBy("x", "y").agg(F.sum("weight").alias("shared")), "x", "y").select("x", "y"), "inside")
    third = scratch.save(verified(inside, tokens_of(inside.select(F.explode(F.array("x", "y")).alias("cls")), "third")), "third")
    all_links = first.unionByName(second).unionByName(third).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    degree = all_links.select(F.explode(F.array("x", "y")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    of_class = scratch.save(
        classes.join(final, "node", "left").join(degree, "cls", "left")
        .select("cls", F.coalesce("component", "node").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "of_class"
    )
    scratch.drop("buckets", "first", "second", "inside", "third-tokens", "third-other", "third-once", "third", "known", "classes")
    return sets.join(of_class, "cls", "left").select(*out, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=False)
