"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown here on histograms of the labelled rows (at most `SAMPLE` of them, those of least hash) and flattened
into numpy node arrays, by which whole batches are scored level by level. On features of `FALLING` the score may not rise,
on those of `RISING` it may not fall: a split whose leaves disagree is refused, and bounds on the leaf values below a split
keep the order over the whole tree.

Cases: null and empty texts have no words, fail the base rules and aren't kept; with no labels the model keeps what passes the
base rules; a null doc_id is scored like any other; rows that repeat a doc_id get a row each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import Scratch, batch, table
from lodestone.llm.doc_stats import COUNTS, FEATURES, matrix, sample, stats_of, training_labels

SAMPLE = 40_000
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 60, 4, 0.2, 48, 20, 1.0
FALLING = {"symbol_share", "dup_line_share", "repeat_share", "mark_share", "top_word_share", "symbol_word_share"}
RISING = {"distinct_share"}


@dataclass
class Forest:
    """Node arrays over all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total


def fit(x: np.ndarray, y: np.ndarray, falling: set[int], rising: set[int]) -> Forest:
    """Boosting on the logistic loss."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.999
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    if not len(y) or y.min() == y.max():
        return Forest(*(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, float)), np.zeros(0, np.int64), base)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        root = len(nodes)
        roots.append(root)
        nodes.append([0, 0.0, root, root, 0.0])
        todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, depth, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value = float(np.clip(-g / (h + RIDGE), low, high))
            best = (1e-6, None)
            if depth < DEPTH and len(rows) >= 2 * LEAF:
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    own = bins[rows, k]
                    gl, hl, nl = (np.cumsum(np.bincount(own, weights=w, minlength=len(c) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                    lv, rv = -gl / (hl + RIDGE), -(g - gl) / (h - hl + RIDGE)
                    allowed = (nl >= LEAF) & (len(rows) - nl >= LEAF)
                    if k in falling:
                        allowed &= lv >= rv
                    if k in rising:
                        allowed &= lv <= rv
                    gain = np.where(allowed, gain, -1)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], (k, at, lv[at], rv[at]))
            if best[1] is None:
                nodes[node][4] = RATE * value
                margin[rows] += RATE * value
                continue
            k, at, lv, rv = best[1]
            middle = float(np.clip((lv + rv) / 2, low, high))
            ends = {"l": (low, high), "r": (low, high)}
            if k in falling:
                ends = {"l": (middle, high), "r": (low, middle)}
            elif k in rising:
                ends = {"l": (low, middle), "r": (middle, high)}
            left, right = len(nodes), len(nodes) + 1
            nodes[node] = [k, float(cuts[k][at]), left, right, 0.0]
            nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, right, right, 0.0]]
            goes = bins[rows, k] <= at
            todo += [(left, rows[goes], depth + 1, *ends["l"]), (right, rows[~goes], depth + 1, *ends["r"])]
    columns = list(zip(*nodes, strict=True))
    return Forest(*(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)), np.array(roots), base)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality (the trees' probability), kept."""
    spark = docs.sparkSession
    held = Scratch(spark, "quality-rules").save(stats_of(docs), "stats")
    known = sample(held.join(training_labels(labels, "quality"), "doc_id").select("doc_id", "features", "y"), SAMPLE).toPandas()
    x = np.stack(known["features"].to_list()) if len(known) else np.zeros((0, len(FEATURES)))
    forest = spark.sparkContext.broadcast(fit(x, known["y"].to_numpy(float), {FEATURES.index(f) for f in FALLING}, {FEATURES.index(f) for f in RISING}))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("quality", pa.float64())])

    def score(batches):
        for part in batches:
            p = 1 / (1 + np.exp(-forest.value.margin(matrix(part.column("features")))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in COUNTS), pa.array(p)], schema=schema)

    scored = held.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
