"""Toxicity scores by FTRL-proximal logistic regression."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopsight.llm.common import U64, WordHashes, checkpointed, mixed, plain_words, text_batches, texts_of, trimmed

#: Hashed features; weights are 2 ** BITS values at most, which bounds what is broadcast.
BITS = 20
#: Labelled rows that the model is fitted on, at most, and features that they have together, at most: those with the smallest
#: hash of their id.
MAX_ROWS, MAX_FEATURES = 12_000, 40_000_000


def _raw(h: np.ndarray) -> tuple:
    """Unmixed hashes of words, of pairs of neighbours, of pairs with one word between."""
    return h, h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:], h[:-2] * U64(0xC2B2AE3D27D4EB4F) + h[2:]


def features(words: list[bytes], hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers of a text: words, pairs of neighbours, pairs with one word between."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    found = mixed(np.concatenate(_raw(hashes.of(words)))) >> U64(64 - bits)
    return np.unique(found.astype(np.int64))


class Ftrl:
    """Logistic regression with per-coordinate rates and L1 sparsity (McMahan et al., 2013)."""

    def __init__(self, bits: int = BITS, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias = 1 << bits  # the last coordinate; free of L1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == self.bias, 0.0, self.l1), 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        gradient = weight * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label)
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def train(
    documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    bits: int = BITS, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, passes: int = 6, l1: float = 12.0, alpha: float = 3.0, min_docs: int = 2,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, their weights, bias) from up to max_rows labelled documents.

    labels holds doc_id and a label of 0 or 1; null ids or labels are left out; of several labels
    of one id the largest counts, and of several texts of one id the smallest. Without labelled
    rows there are no weights and the bias is 0. The sample is bounded in rows and features, so one task can fit it;
    it gets hashed features, not texts. Features of fewer than min_docs sampled documents have no
    weight. A feature counts once for each document, however often it stands there.

    l1 and alpha are those with the fewest errors in four folds (crc32 of the id, modulo 5, is 1 to 4)
    of the labelled rows of sf0.1; rows with a remainder of 0 are held out and took no part.
    """
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).dropna()
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "__id"), "__id").limit(max_rows)
    rows = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    rows = rows.join(F.broadcast(chosen), "__id")  # max_rows rows at most
    rows = rows.groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__label").alias("__label"))

    text_batches()

    @F.arrow_udf("array<int>")
    @trimmed
    def hashed(column: pa.Array) -> pa.Array:
        hashes = WordHashes()
        found = [features(plain_words(x), hashes, bits).astype(np.int32) for x in texts_of(column)]
        return pa.array(found, type=pa.list_(pa.int32()))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:  # holds features as 32-bit numbers, those of several documents twice
        pdf = pdf.sort_values("__id", kind="stable")
        model, order = Ftrl(bits, l1=l1, alpha=alpha), np.arange(len(pdf))
        at, y = pdf["__at"].tolist(), pdf["__label"].to_numpy()
        seen = np.zeros((1 << bits) + 1, dtype=np.int32)
        for x in at:
            seen[x] += 1
        for i, x in enumerate(at):
            at[i] = x[seen[x] >= min_docs]
        random = np.random.default_rng(5)
        for _ in range(passes):
            random.shuffle(order)
            for i in order:
                model.learn(at[i], int(y[i]))
        everywhere = np.arange((1 << bits) + 1)
        w = model.weights(everywhere)
        kept = np.flatnonzero(w)
        kept = kept[kept != model.bias]
        return pd.DataFrame({"at": np.append(kept, -1).astype(np.int64), "w": np.append(w[kept], w[model.bias])})

    one = checkpointed(rows.select("__id", "__label", hashed("__text").alias("__at")).withColumn("__all", F.lit(0)))
    sizes = one.select("__id", F.size("__at").cast("long").alias("n"), F.xxhash64(F.lit(11), "__id").alias("h"))  # max_rows at most
    upto = F.sum("n").over(Window.orderBy("h", "__id").rowsBetween(Window.unboundedPreceding, 0))
    one = one.join(F.broadcast(sizes.withColumn("upto", upto).where(F.col("upto") <= max_features).select("__id")), "__id")
    fitted = one.groupBy("__all").applyInPandas(fit, "at long, w double").toPandas()  # 2 ** bits + 1 rows at most
    bias = float(fitted.loc[fitted["at"] < 0, "w"].sum())
    fitted = fitted[fitted["at"] >= 0]
    return fitted["at"].to_numpy(np.int64), fitted["w"].to_numpy(np.float64), bias


def score_column(text, model: tuple, spark, bits: int = BITS):
    """Score of each text, 0 to 1; null and empty texts, and others without known features, have the score of the bias.

    Equal texts have equal scores, whatever their length, order or number.
    """
    text_batches()
    at, w, bias = model
    sent = spark.sparkContext.broadcast((at.astype(np.int32), w.astype(np.float32)))
    kept: dict = {}

    @F.arrow_udf("double")
    @trimmed
    def of(column: pa.Array) -> pa.Array:
        if not kept:
            kept["hashes"] = WordHashes(most=100_000)
            kept["w"] = np.zeros(1 << bits, dtype=np.float32)
            kept["w"][sent.value[0]] = sent.value[1]
        hashes, dense, out = kept["hashes"], kept["w"], []
        for x in texts_of(column):
            words = plain_words(x)
            total = bias
            if words:
                h = hashes.of(words)
                found = []
                for f in _raw(h):
                    f = (mixed(f) >> U64(64 - bits)).astype(np.int64)
                    found.append(f[dense[f] != 0])
                total += float(dense[np.unique(np.concatenate(found))].sum(dtype=np.float64))
            out.append(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))
        return pa.array(out, type=pa.float64())

    return of.asNondeterministic()(text)


def held_out(doc_id):
    """Whether a document is held out for tests; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """labels without those held out for tests: crc32 of the id as text, modulo 5, is 0."""
    return labels.where(~held_out(F.col(doc_id)))
