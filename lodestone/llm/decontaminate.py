"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Words are those between ASCII white space, with A-Z in lower case; a shingle is five words in a row, known by its 64-bit
hash. A shingle that several items hold weighs 1, any other 2.

1. Regions. A window as similar to an item as asked shares shingles with it. So only places of a document that hold an
   item's shingle matter, and only windows of the length of such items; and a window needs as many of them as the
   similarity implies. All this loses no match. A document shorter than the item is one window, its whole text; as it may
   weigh less than the item, it may lack more of the item's shingles.
2. SimHash. Each item, and each item-sized window of a region, gets a weighted 64-bit SimHash. Votes of eight bits are added
   at once, in byte lanes of a long: a lane holds at most `MOST_WEIGHT`. Longer windows keep their votes in several groups
   of shingles which are added lane by lane.
3. Multi-index Hamming blocks. A fingerprint is cut in four blocks of 16 bits. Two that differ in at most `radius` < 16 bits
   differ in at most three bits of some block; items are indexed under each block and all values within three bits of it,
   windows look up their own blocks. This finds all windows within the radius.
4. Verify. The exact weighted Jaccard similarity of the two shingle multisets decides.

Cases: null and empty texts and documents of fewer than five words match nothing, nor do items of fewer than five words;
rows with a null doc_id or item_id match nothing; items with the same text are each reported; rows that repeat a doc_id are
one document whose windows are those of all its texts; an empty table on either side gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import Scratch, table

SHINGLE = 5
#: Of the shingles that are added up in byte lanes together, the total weight; the highest lane has the sign.
MOST_WEIGHT = 126
#: Item shingles that are broadcast at most (16 bytes each).
BROADCAST = 400_000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_rows(rows: DataFrame, w: str, at: str, h: str) -> DataFrame:
    """A row for each shingle of the words in column w: its place and hash, computed as the rows are made."""
    placed = rows.where(F.size(w) >= SHINGLE).withColumn(at, F.explode(F.sequence(F.lit(0), F.size(w) - SHINGLE)))
    return placed.withColumn(h, F.xxhash64(*(F.get(w, F.col(at) + k) for k in range(SHINGLE)))).drop(w)


def _spread() -> Column:
    """By byte: a long whose lanes (bytes) are the bits of it."""
    values = []
    for byte in range(256):
        lanes = sum(1 << (8 * bit) for bit in range(8) if byte >> bit & 1)
        values.append(lanes)
    return F.array(*(F.lit(v).cast("long") for v in values))


def simhash(rows: DataFrame, keys: list[str], h: str, weight: str) -> DataFrame:
    """keys, fingerprint: the weighted SimHash of each key's hashes. A bit is set if more than half of the weight has it."""
    # votes are kept apart for every MOST_WEIGHT / 2 shingles, whose lanes can't overflow
    spread = _spread()
    apart = rows.withColumn("_group", F.col("_at") % F.greatest(F.lit(1), F.col("_groups")))
    votes = [F.sum(F.element_at(spread, (F.shiftright(F.col(h), 8 * k).bitwiseAND(255) + 1).cast("int")) * F.col(weight)).alias(f"_v{k}") for k in range(8)]
    lanes = apart.groupBy(*keys, "_group").agg(F.sum(weight).alias("_w"), *votes)
    split = [F.sum(F.shiftright(f"_v{k}", 8 * bit).bitwiseAND(255)).alias(f"_b{8 * k + bit}") for k in range(8) for bit in range(8)]
    each = lanes.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.array(*split).alias("_bits"))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(2 * F.get("_bits", i) > F.col("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return each.select(*keys, bits.alias("fingerprint"))


def _block(fingerprint: str, k: int) -> Column:
    return F.shiftright(fingerprint, 16 * k).bitwiseAND(65535).cast("int")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: each document's most similar window for each item."""
    if not 0 <= radius <= 15:
        raise ValueError("radius must be 0 to 15: four blocks with three differing bits each")
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(f"item_id IS NOT NULL AND size(w) >= {SHINGLE}")
    item_rows = scratch.save(shingle_rows(items.select("item_id", F.size("w").alias("n"), "w"), "w", "at", "h"), "items")
    shared = scratch.save(item_rows.groupBy("h").agg(F.when(F.count_distinct("item_id") > 1, 1).otherwise(2).alias("weight"), F.collect_set("n").alias("lengths")), "shingles")

    # least number of item shingles in a window of n words: J >= s with equal totals W gives a common weight of 2 s W / (1 + s);
    # at least the share of the heaviest shingles is met by counting places, as 2 is the greatest weight and 1 the least
    part = 2 * similarity / (1 + similarity)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").withColumn("t", F.xxhash64("text"))
    worded = text.select("doc_id", "t", words(F.col("text")).alias("w")).withColumn("m", F.size("w"))
    places = shingle_rows(worded, "w", "pos", "h")
    small = shared.count() <= BROADCAST
    known = F.broadcast(shared) if small else shared  # beyond the bound both sides are shuffled
    hits = scratch.save(places.join(known, "h").select("doc_id", "t", "m", "pos", F.explode("lengths").alias("n")).groupBy("doc_id", "t", "n").agg(F.min("m").alias("m"), F.sort_array(F.collect_set("pos")).alias("at")), "hits")
    # a window may begin before its first known shingle by as many places as may be unknown
    # the whole text of a shorter document has J <= common weight / W, so that the item may lack (1 - s) W
    short = F.col("m") < F.col("n")
    unknown = F.floor((F.col("n") - (SHINGLE - 1)) * F.when(short, 1 - similarity).otherwise(1 - part) * 2 + 1e-9).cast("int")
    begins = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.lit(0), p - F.col("unknown")), p))))
    starts = F.explode(F.when(short, F.array_union(F.array(F.lit(0)), begins)).otherwise(begins)).alias("s")
    last = F.col("s") + F.col("n") - SHINGLE
    within = F.size(F.filter("at", lambda p: (p >= F.col("s")) & (p <= last)))
    windows = (
        hits.withColumn("unknown", unknown).where(F.size("at") >= F.col("n") - (SHINGLE - 1) - F.col("unknown"))
        .select("doc_id", "t", "n", "at", "unknown", starts)
        .where(within >= F.col("n") - (SHINGLE - 1) - F.col("unknown")).select("doc_id", "t", "n", "s")
    )
    by_doc = scratch.save(windows.groupBy("doc_id", "t").agg(F.collect_list(F.struct("n", "s")).alias("windows")), "windows")
    held = by_doc.join(text, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "windows", words(F.col("text")).alias("w")).select("doc_id", "t", "w", F.explode("windows").alias("x"))
    each = held.select("doc_id", "t", F.col("x.n").alias("n"), F.col("x.s").alias("s"), F.slice("w", F.col("x.s") + 1, F.col("x.n")).alias("w")).where("size(w) = n OR s = 0")  # else it reaches beyond the end
    window_rows = shingle_rows(each, "w", "_at", "h").join(F.broadcast(shared.select("h", "weight")) if small else shared.select("h", "weight"), "h", "left")
    groups = F.ceil((F.col("n") - (SHINGLE - 1)) / (MOST_WEIGHT // 2)).cast("int").alias("_groups")
    window_rows = scratch.save(window_rows.select("doc_id", "t", "n", "s", "h", "_at", groups, F.coalesce("weight", F.lit(2)).cast("long").alias("weight")), "window-shingles")
    weighed = item_rows.join(shared.select("h", "weight"), "h").select("item_id", "n", "h", F.col("at").alias("_at"), groups, F.col("weight").cast("long").alias("weight"))
    weighed = scratch.save(weighed, "item-shingles")

    ours = simhash(window_rows, ["doc_id", "t", "n", "s"], "h", "weight")
    theirs = simhash(weighed, ["item_id", "n"], "h", "weight")
    near = F.expr("filter(sequence(0, 65535), x -> bit_count(x) <= 3)")  # a constant
    blocks = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _block("fingerprint", k).alias("v")) for k in range(4)))).alias("b")
    indexed = theirs.select("item_id", "n", F.col("fingerprint").alias("of_item"), blocks).select("item_id", "n", "of_item", "b.k", F.explode(F.transform(near, lambda x: F.col("b.v").bitwiseXOR(x))).alias("v"))
    looked = ours.select("doc_id", "t", "n", "s", "fingerprint", blocks).select("doc_id", "t", "n", "s", "fingerprint", "b.k", "b.v")
    hamming = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item")))
    # windows are item-sized, or whole documents that are shorter: an item is held against windows for its own length. The index
    # has 2788 rows for each item, which Spark doesn't foresee: it isn't broadcast, the driver would have to build it
    pairs = looked.join(indexed.hint("merge"), ["n", "k", "v"]).withColumn("hamming", hamming).where(F.col("hamming") <= radius).select("doc_id", "t", "n", "s", "item_id", "hamming").distinct()

    def multiset(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        counted = rows.groupBy(*keys, "h", "weight").agg(F.count("*").alias("c"))
        return counted.groupBy(*keys).agg(F.collect_list(F.struct("h", "c", "weight")).alias(name), F.sum(F.col("c") * F.col("weight")).alias(f"w_{name}"))

    pairs = scratch.save(pairs, "pairs")
    both = pairs.join(multiset(window_rows, ["doc_id", "t", "n", "s"], "a"), ["doc_id", "t", "n", "s"]).join(multiset(weighed, ["item_id"], "b"), "item_id")
    met = F.aggregate(
        F.filter(F.transform("a", lambda x: F.struct(x["c"].alias("c"), x["weight"].alias("w"), F.get(F.filter("b", lambda y: y["h"] == x["h"]), F.lit(0))["c"].alias("d"))), lambda x: x["d"].isNotNull()),
        F.lit(0).cast("long"), lambda acc, x: acc + F.least(x["c"], x["d"]) * x["w"],
    )
    scored = both.withColumn("met", met).withColumn("similarity", F.col("met") / (F.col("w_a") + F.col("w_b") - F.col("met"))).where(F.col("similarity") >= similarity)
    n_words = F.aggregate("a", F.lit(SHINGLE - 1).cast("long"), lambda acc, x: acc + x["c"])
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("s")).alias("s"), n_words.cast("int").alias("n"))).alias("x"))
    found = scratch.save(best.select("doc_id", "item_id", (-F.col("x.s")).cast("int").alias("start_word"), F.col("x.n").alias("n_words"), (-F.col("x.h")).cast("int").alias("hamming"), F.round("x.similarity", 6).alias("similarity")), "found")
    scratch.drop("items", "shingles", "hits", "windows", "window-shingles", "item-shingles", "pairs")
    return found


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
