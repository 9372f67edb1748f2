"""Exact and near duplicates, and groups that must not share content."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X


def first_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key. (dropDuplicates doesn't say which row stays.)"""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")


def bottom_sketch(rows: DataFrame, shingles: str, out: str, size: int = 64) -> DataFrame:
    """Adds the least 64-bit prefixes of the shingles' digests, as sorted hex strings, padded with the last; zeros for none."""
    digests = F.array_sort(F.transform(shingles, lambda s: F.substring(F.sha2(s, 256), 1, 16)))
    # a column of its own, so that digests are taken once
    rows = rows.withColumn(out, F.slice(digests, 1, size))
    padded = F.concat(out, F.array_repeat(F.element_at(out, -1), F.lit(size) - F.size(out)))
    return rows.withColumn(out, F.when(F.size(out) > 0, padded).otherwise(F.array_repeat(F.lit("0" * 16), size)))


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: float = 0.85, size: int = 64, bands: int = 8) -> DataFrame:
    """left, right, method, jaccard: equal normalised texts, and pairs that share a band of the sketch and are similar.

    Members of a class of equal sets are compared by one representative, so that copies don't meet in all their pairs; each
    is then paired with the representative of its class."""
    width = size // bands
    rows = docs.select(F.col(key).alias("id"), X.flat(F.col(text)).alias("flat")).select("id", F.sha2("flat", 256).alias("h"), X.index_terms(F.col("flat")).alias("k"))
    rows = rows.select("id", "h", X.shingles(F.col("k")).alias("s"))
    reps = rows.groupBy("h").agg(F.min("id").alias("id"), F.first("s").alias("s"))
    # copies in this sense pair with the first of their class; a join can be split where a class is large, a window can't
    lead = reps.select("h", F.col("id").alias("left"))
    equal = rows.select("h", F.col("id").alias("right")).join(lead, "h").where("left <> right").select("left", "right", F.lit("exact_normalized_hash").alias("method"), F.lit(1.0).alias("jaccard"))
    sketch = bottom_sketch(reps, "s", "k", size).select("id", "k")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice("k", b * width + 1, width)))).alias("band", "bucket")
    buckets = sketch.select("id", band)
    a, b = buckets.alias("a"), buckets.alias("b")
    candidates = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("left"), F.col("b.id").alias("right")).distinct()
    left, right = reps.select(F.col("id").alias("left"), F.col("s").alias("x")), reps.select(F.col("id").alias("right"), F.col("s").alias("y"))
    similar = candidates.join(left, "left").join(right, "right").withColumn("jaccard", F.coalesce(X.jaccard(F.col("x"), F.col("y")), F.lit(1.0))).where(F.col("jaccard") >= threshold)
    return equal.unionByName(similar.select("left", "right", F.lit("minhash_candidate_jaccard").alias("method"), F.round("jaccard", 8).alias("jaccard")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the executors share; one of this machine only on a local master without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that its executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
    return found.rstrip("/")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of edges (left, right), by least labels over rounds of written tables."""
    spark = edges.sparkSession
    root = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    def drop(name: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    both = save(edges.select(F.col("left").alias("a"), F.col("right").alias("b")).union(edges.select("right", "left")).distinct(), "edges")
    labels, k, total = save(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("c")), "0"), 0, None
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, "a").select("a", F.least("c", "m").alias("c"))
        # pointer jump: the label of the label
        jump = step.select(F.col("a").alias("c"), F.col("c").alias("up"))
        k += 1
        labels = save(step.join(jump, "c", "left").select("a", F.coalesce("up", "c").alias("c")), str(k))
        drop(str(k - 1))
        now = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if now == total:
            drop("edges")
            return labels.select(F.col("a").alias("node"), F.col("c").alias("component"))
        total = now


def complete_sources(rows: DataFrame, source: str, key: Column) -> DataFrame:
    """The sources that stay if, in order of name, a source goes whole as soon as an earlier one that stays holds one of its
    keys. Only sources in conflict are walked in order, component by component; the others stay as they are."""
    held = rows.select(F.col(source).alias("source"), key.alias("h")).distinct()
    n = held.groupBy("h").agg(F.count("*").alias("n"), F.min("source").alias("lead")).where("n > 1")
    links = held.join(n, "h").where("source <> lead").select(F.col("lead"), "source", "h")
    # numbers for names, so that components can be labelled
    names = held.select("source").distinct().withColumn("id", F.xxhash64("source"))
    edges = links.select(F.xxhash64("lead").alias("left"), F.xxhash64("source").alias("right")).distinct()
    comp = components(edges)
    fight = held.join(n.select("h"), "h").join(names, "source").join(comp, F.col("id") == F.col("node")).select("component", "source", "h")

    def walk(own):
        claimed, kept = set(), []
        for name, keys in own.sort_values("source").groupby("source", sort=True)["h"]:
            if claimed.isdisjoint(keys):
                claimed.update(keys)
                kept.append(name)
        return pd.DataFrame({"source": [s for s in own["source"].unique() if s not in set(kept)]})

    gone = fight.groupBy("component").applyInPandas(walk, "source string")
    return held.select("source").distinct().join(gone, "source", "left_anti")
