"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, id_and_text, map_texts, sampled
from .wordhash import WordHasher, byte_table, mixed

#: Bound on the labelled rows that the model is fitted on, and on those of one learner.
FIT_ROWS, LEARNER_ROWS = 48_000, 16_000
#: Bits of the hashed single words; pairs and skip pairs have a region of half that size each.
BITS = 21
THRESHOLD = 0.3
#: Bytes that separate words: all of ASCII but letters and digits.
BETWEEN = [b for b in range(128) if not chr(b).isalnum()]


def word_hashes(texts: list, hasher: WordHasher) -> list[np.ndarray]:
    """Hashes of the lower-cased words of letters and digits of each text."""
    hashes, counts = hasher([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
    return np.split(hashes, np.cumsum(counts)[:-1])


def features(h: np.ndarray, bits: int) -> np.ndarray:
    """Distinct hashed features: words, pairs of neighbours, and pairs with one word skipped. The first is the bias."""
    pairs = mixed(h[:-1] * np.uint64(3) + h[1:])
    skips = mixed(h[:-2] * np.uint64(5) + h[2:])
    one, half = np.uint64(64 - bits), np.uint64(65 - bits)
    start = np.uint64(1 << bits)
    at = np.concatenate([(h >> one) + np.uint64(1), (pairs >> half) + start + np.uint64(1), (skips >> half) + start + start // np.uint64(2) + np.uint64(1)])
    return np.append(0, np.unique(at)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al., 2013) for binary features."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, learner_rows: int = LEARNER_ROWS, bits: int = BITS, epochs: int = 5) -> np.ndarray:
    """Weights learnt from at most about ``rows`` labelled rows.

    The rows are dealt to learners of about ``learner_rows`` each by a hash; a learner is
    one task, and the learners' weights are averaged. What reaches the driver is bounded
    by the size of the table of weights.
    """
    wanted = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    wanted = wanted.filter("doc_id is not null and label in (0, 1)").filter(~held_out("doc_id"))
    wanted, share = bounded_sample(wanted.groupBy("doc_id").agg(F.max("label").alias("label")), rows)
    learners = max(1, -(-wanted.count() // learner_rows))
    texts = sampled(id_and_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")), share)
    sample = texts.dropDuplicates(["doc_id"]).join(wanted, "doc_id").withColumn("learner", F.pmod(F.xxhash64(F.lit("learner"), "doc_id"), F.lit(learners)).cast("int"))
    size = (2 << bits) + 1

    def train(part: pd.DataFrame) -> pd.DataFrame:
        hasher, model = WordHasher(byte_table(BETWEEN, lower=True)), Ftrl(size)
        part = part.sort_values("doc_id")
        known = [(features(h, bits), y) for h, y in zip(word_hashes(part["text"].tolist(), hasher), part["label"], strict=True)]
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(known)):
                model.learn(*known[k])
        w = model.weights()
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": at, "weight": w[at] / learners})

    learnt = sample.groupBy("learner").applyInPandas(train, "feature long, weight double")
    found = learnt.groupBy("feature").agg(F.sum("weight").alias("weight")).toPandas()
    weights = np.zeros(size, np.float32)
    weights[found["feature"].to_numpy(np.int64)] = found["weight"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS, carry: bool = False) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of each whole text.

    * A null or empty text has no features and takes the score of the bias alone.
    * Repeated rows get equal scores; a null id is returned as null and is not held out.
    * With ``carry`` the input row comes along as the struct ``row``.
    """
    at = np.flatnonzero(weights).astype(np.int32)
    held = docs.sparkSession.sparkContext.broadcast((len(weights), at, weights[at]))

    def prepare():
        size, index, values = held.value
        w = np.zeros(size, np.float32)
        w[index] = values
        hasher = WordHasher(byte_table(BETWEEN, lower=True))

        def work(texts: list) -> dict:
            sums = np.array([w[features(h, bits)].sum(dtype=np.float64) for h in word_hashes(texts, hasher)])
            s = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    marked = id_and_text(docs, id_col, text_col, carry).withColumn("held_out", held_out("doc_id"))
    return map_texts(marked, prepare, "score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every text.

    Without labelled rows all weights are zero and each score is 0.5. Unknown labels and
    labels of unknown ids are left out; of repeated labels the larger one counts.
    """
    return score(docs, fit(docs, labels, id_col, text_col, label_col, rows), id_col, text_col, threshold, carry=carry)
