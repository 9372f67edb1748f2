"""Toxicity: a counterfactually regularised linear classifier over words and word beginnings.

Features are the lower-case words of a document, without punctuation at their ends, and their first three to eight
letters. A feature's value grows with its share of the document's words. Those that tell toxic from other labelled documents are selected by a z-score of their document frequencies (at
most `MOST`), and identity terms that occur are always among them. A logistic model is fitted on at most `SAMPLE` labelled
rows of least hash (its bound), with a penalty on the change of score when the identity terms of a row are swapped
for the next ones of their list: mentions of a group then weigh next to nothing by themselves, while words that are toxic
beside them keep their weight.

Cases: null and empty texts have no features and get the model's base score; with no labels, or labels of one kind, every
score is their mean (0 for none); a null doc_id isn't held out; rows that repeat a doc_id get a row each, and one of
them is fitted on, that of least text hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._base import MEMO_WORDS, Scratch, batch, table, text_chunks
from lodestone.llm.doc_stats import held_out, sample, training_labels

SAMPLE, MOST, LEAST_Z, LEAST_SHARE = 20_000, 512, 5.0, 0.02
RIDGE, SWAP_PENALTY, STEPS = 0.05, 4.0, 400
#: Value of a feature that is there, and what its share of the words is multiplied by; that part is 1 at most.
PRESENT, DENSE = 0.2, 25.0
ENDS = ".,;:!?\"'()[]{}«»“”‘’…*-_"
#: Terms of a list are swapped for one another.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["gay", "straight", "lesbian", "bisexual"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["black", "white", "asian", "latino"], ["immigrants", "citizens", "refugees", "foreigners"],
    ["old", "young"], ["disabled", "deaf", "blind"], ["transgender", "cisgender"], ["africans", "europeans", "americans", "asians"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs", "athées"], ["immigrés", "réfugiés", "étrangers"], ["frauen", "männer"],
    ["muslime", "christen", "juden", "atheisten"], ["einwanderer", "flüchtlinge", "ausländer"], ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos", "ateos"], ["inmigrantes", "refugiados", "extranjeros"],
]
_NEXT = {term: own[(k + 1) % len(own)] for own in IDENTITY for k, term in enumerate(own)}


def bare(word: bytes) -> str:
    return word.decode().lower().strip(ENDS)


def features(word: str) -> list[int]:
    """Of a bare word, as hashes."""
    if not word:
        return []
    names = [f"w {word}", *(f"{n} {word[:n]}" for n in range(3, 9) if len(word) > n)]
    return [xxhash.xxh64_intdigest(x) for x in names]


class Selected(dict):
    """Places of a word's selected features, by the word as written."""

    def __init__(self, places: dict[int, int]):
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = tuple(self.places[h] for h in features(bare(word)) if h in self.places)
        return found

    def of(self, text: bytes, swap: bool = False) -> tuple[list[int], list[float]]:
        """(places, values) of the features that the text has."""
        words = text.split()
        counts: dict[int, int] = {}
        for word, n in Counter(words).items():
            if swap and (other := _NEXT.get(bare(word))):
                word = other.encode()
            for place in self[word]:
                counts[place] = counts.get(place, 0) + n
        return list(counts), [PRESENT + min(1.0, DENSE * n / len(words)) for n in counts.values()]


def fit(rows: list, swapped: list, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and base, by gradient steps with momentum on the logistic loss, ridge and swap penalty. rows, swapped: each
    row's (places, values), as it is and with identity terms swapped."""
    at = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    f, v = (np.concatenate([np.asarray(r[k], t) for r in rows]) for k, t in ((0, np.int64), (1, float)))
    moved = [k for k, (a, b) in enumerate(zip(rows, swapped, strict=True)) if list(a[0]) != list(b[0]) or list(a[1]) != list(b[1])]
    m_at = np.array([k for k, r in enumerate(moved) for _ in (*rows[r][0], *swapped[r][0])], np.int64)
    m_f = np.array([k for r in moved for k in (*rows[r][0], *swapped[r][0])], np.int64)
    m_sign = np.array([s for r in moved for s in (*rows[r][1], *(-x for x in swapped[r][1]))])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, base = np.zeros(width), float(np.log(share / (1 - share)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(np.bincount(at, weights=w[f] * v, minlength=len(rows)) + base)))
        grad = np.bincount(f, weights=(p - y)[at] * v, minlength=width) + RIDGE * w
        if moved:
            change = np.bincount(m_at, weights=w[m_f] * m_sign, minlength=len(moved))
            grad += SWAP_PENALTY * np.bincount(m_f, weights=change[m_at] * m_sign, minlength=width)
        grad = np.append(grad, (p - y).sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, base = w - move[:-1], base - move[-1]
    return w, float(base)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    chosen = training_labels(labels, "toxic")
    # the sample is drawn among labelled documents that are there, and its ids are broadcast: SAMPLE of them at most
    ids = sample(rows.select("doc_id").distinct().join(chosen, "doc_id"), SAMPLE).toPandas()
    share = float(ids["y"].mean()) if len(ids) else 0.0
    model = None
    if 0 < share < 1:
        # the sampled rows are read once; of rows that repeat a doc_id one is fitted on, that of least text hash
        scratch = Scratch(spark, "toxicity")
        one = F.min_by("text", F.xxhash64("text")).alias("text")
        labelled = scratch.save(rows.join(F.broadcast(spark.createDataFrame(ids, "doc_id long, y int")), "doc_id").groupBy("doc_id", "y").agg(one), "labelled")

        def count(batches):
            schema = pa.schema([("h", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])
            of_word: dict[bytes, list[int]] = {}
            for part, texts in text_chunks(batches):
                found: list[np.ndarray] = []
                kind: list[np.ndarray] = []
                for y, text in zip(part.column("y").to_pylist(), texts, strict=True):
                    own: set[int] = set()
                    for w in set(text.split()):
                        if w not in of_word:
                            if len(of_word) >= MEMO_WORDS // 4:
                                of_word.clear()
                            of_word[w] = features(bare(w))
                        own.update(of_word[w])
                    found.append(np.fromiter(own, np.uint64, len(own)))
                    kind.append(np.full(len(own), y))
                h, back = np.unique(np.concatenate(found), return_inverse=True)
                toxic = np.bincount(back, weights=np.concatenate(kind), minlength=len(h)).astype(np.int64)
                yield batch(schema, [h.view(np.int64), toxic, np.bincount(back, minlength=len(h)) - toxic])

        n1, n0 = int(ids["y"].sum()), int(len(ids) - ids["y"].sum())
        a, b = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("other") + 0.5) / (n0 + 1)
        pooled = (F.col("toxic") + F.col("other") + 1) / (n1 + n0 + 2)
        z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
        always = [int(np.uint64(h).astype(np.int64)) for t in _NEXT for h in features(t)[:1]]
        counted = labelled.mapInArrow(count, "h long, toxic long, other long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        telling = (F.abs("z") >= LEAST_Z) & (F.greatest(F.col("toxic") / n1, F.col("other") / n0) >= LEAST_SHARE)
        best = counted.withColumn("z", z).withColumn("always", F.col("h").isin(always)).where(telling | F.col("always")).orderBy(F.desc("always"), F.desc(F.abs("z")), "h").limit(MOST).select("h").toPandas()
        places = spark.sparkContext.broadcast({h & (1 << 64) - 1: k for k, h in enumerate(best["h"].tolist())})

        def lists(batches):
            schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), *((c, pa.list_(t)) for c, t in (("own", pa.int32()), ("values", pa.float64()), ("swapped", pa.int32()), ("new_values", pa.float64())))])
            chosen = Selected(places.value)
            for part, texts in text_chunks(batches):
                own, swapped = ([chosen.of(t, swap) for t in texts] for swap in (False, True))
                yield batch(schema, [part.column("doc_id"), part.column("y"), *zip(*own, strict=True), *zip(*swapped, strict=True)])

        read = labelled.mapInArrow(lists, "doc_id long, y int, own array<int>, values array<double>, swapped array<int>, new_values array<double>")
        known = read.toPandas().sort_values("doc_id")  # SAMPLE rows at most
        scratch.drop("labelled")
        own, swapped = (list(zip(known[a], known[b], strict=True)) for a, b in (("own", "values"), ("swapped", "new_values")))
        model = (places.value, *fit(own, swapped, known["y"].to_numpy(float), len(best)))
    fitted = spark.sparkContext.broadcast(model)

    def score(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        chosen = Selected(fitted.value[0]) if fitted.value else None
        for part, texts in text_chunks(batches):
            if chosen is None:
                values = np.full(len(texts), share)
            else:
                w, base = fitted.value[1:]
                values = 1 / (1 + np.exp(-np.array([base + sum(w[p] * v for p, v in zip(*chosen.of(t), strict=True)) for t in texts])))
            yield batch(schema, [part.column("doc_id").to_pylist(), values])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), F.round("score", 9).alias("score"), (F.round("score", 9) >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
