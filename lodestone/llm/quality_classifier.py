"""Quality classifier: random Fourier features, ridge regression by partition-summed normal equations, isotonic calibration.

Document statistics are standardised and mapped by `WIDTH` random cosines, whose inner products approximate a Gaussian
kernel. Each partition adds up its part of the normal equations over all labelled rows; the parts are summed row by row of the
matrix, so that only WIDTH x WIDTH numbers reach the driver. The ridge scores of the labelled rows are counted in `BINS` bins,
and pool-adjacent-violators on these counts gives the rising map from score to probability, read off linearly between the
middles of its steps.

Cases: null and empty texts have the statistics of a text without words and are scored like others; with no labels, or
labels of one kind, every score is their mean (0.5 for none); a null doc_id isn't held out; rows that repeat a doc_id get a
row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import Scratch, batch, table
from lodestone.llm.doc_stats import FEATURES, held_out, matrix, stats_of, training_labels

WIDTH, GAMMA, RIDGE, BINS, SEED = 256, 0.06, 1e-3, 2000, 20


@dataclass
class Fourier:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase), np.ones((len(x), 1))])


def isotonic(counts: np.ndarray, positives: np.ndarray, middles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of the steps that pool-adjacent-violators leaves, one count of pseudo-rows in each."""
    steps: list[list[float]] = []  # rows, positives, sum of scores
    for n, p, m in zip(counts, positives, middles, strict=True):
        if n:
            steps.append([n, p, n * m])
            while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
                last = steps.pop()
                steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    n, p, s = np.array(steps).T
    return s / n, p / n


def _ridge(rows: DataFrame, fourier, width: int) -> np.ndarray:
    """Weights from the rows (features, y)."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(fourier)
    schema = pa.schema([("i", pa.int32()), ("row", pa.binary())])

    def part(batches):
        total = np.zeros((width + 1, width + 2))
        for x in batches:
            z = held.value(matrix(x.column("features")))
            total += z.T @ np.hstack([z, x.column("y").to_numpy()[:, None]])
        yield batch(schema, [range(width + 1), [r.tobytes() for r in total]])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for x in batches:
            for i, row in zip(x.column("i").to_pylist(), x.column("row").to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(row)
        if total:
            yield batch(schema, [list(total), [r.tobytes() for r in total.values()]])

    found = rows.mapInArrow(part, "i int, row binary").repartition(8, "i").mapInArrow(add, "i int, row binary").collect()  # width + 1 rows
    system = np.stack([np.frombuffer(r) for _, r in sorted((i, bytes(r)) for i, r in found)])
    n = system[width, width]
    penalty = RIDGE * n * np.eye(width + 1) / width
    penalty[width, width] = 0
    return np.linalg.solve(system[:, :-1] + penalty + 1e-9 * np.eye(width + 1), system[:, -1])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-classifier")
    held = scratch.save(stats_of(docs).select("doc_id", "features"), "stats")
    known = scratch.save(held.join(training_labels(labels, "quality"), "doc_id").select("features", F.col("y").cast("double").alias("y")), "known")
    size = len(FEATURES)
    columns = [f(F.get("features", F.lit(k))).alias(f"{name}{k}") for k in range(size) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    moments = known.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *columns).first()
    share = 0.5 if not moments["n"] else moments["y"]
    model = None
    if 0 < share < 1 and moments["n"] > 1:
        rng = np.random.default_rng(SEED)
        scale = np.array([moments[f"s{k}"] for k in range(size)])
        fourier = Fourier(np.array([moments[f"m{k}"] for k in range(size)]), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, np.sqrt(2 * GAMMA), (size, WIDTH)), rng.uniform(0, 2 * np.pi, WIDTH))
        weights = _ridge(known, fourier, WIDTH)
        raw = spark.sparkContext.broadcast((fourier, weights))

        def binned(batches):
            schema = pa.schema([("bin", pa.int32()), ("y", pa.float64())])
            for x in batches:
                f, w = raw.value
                at = np.clip((f(matrix(x.column("features"))) @ w + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32)
                yield batch(schema, [at, x.column("y")])

        bins = known.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).toPandas().sort_values("bin")
        model = (fourier, weights, *isotonic(bins["n"].to_numpy(float), bins["p"].to_numpy(float), (bins["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5))
    fitted = spark.sparkContext.broadcast(model)

    def score(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for x in batches:
            if fitted.value is None:
                values = np.full(x.num_rows, float(share))
            else:
                f, w, at, p = fitted.value
                values = np.interp(f(matrix(x.column("features"))) @ w, at, p)
            yield batch(schema, [x.column("doc_id"), values])

    scored = held.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), F.round("score", 9).alias("score"), (F.round("score", 9) >= threshold).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
