"""Quality classifier: document evidence with hierarchical empirical Bayes over hosts and paths."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.llm.common import checkpointed, text_batches, texts_of

#: Labelled rows that the document classifier is fitted on, at most.
MAX_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "distinct", "repeats", "common", "symbols", "digits", "upper", "stops", "repeated_lines",
    "short_lines", "symbol_words",
)


def text_features(text: bytes | None) -> list[float]:
    """Plain measures of one text, FEATURES in order; a text without words has zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = text.translate(None, _SYMBOLS)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(counts.values()) / n,
        (size - len(letters)) / size,
        (size - len(text.translate(None, b"0123456789"))) / size,
        (size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size,
        (text.count(b".") + text.count(b"!") + text.count(b"?")) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(len(x) < 20 for x in lines) / len(lines) if lines else 0.0,
        sum(w[-1:] in _MARKS for w in words) / n,
    ]


_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_MARKS = {bytes([b]) for b in _SYMBOLS}


def features_column(text):
    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([text_features(x) for x in texts_of(column)], type=pa.list_(pa.float64()))

    return of(text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """(weights, bias) of raw features: ridge-penalised Newton steps on standardised ones."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), float(np.log(share / (1 - share)))
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, own: str, n: str, around: str) -> float:
    """How many documents the prior of a level is worth, by moments of its group means."""
    w, m, c = F.col(n), F.col(own) / F.col(n), F.col(around)
    row = groups.agg(
        F.sum(w), F.sum(w * w), F.sum(w * (m - c) * (m - c)), F.sum(w * c * (1 - c)), F.count(F.lit(1))
    ).first()
    if not row[0] or row[4] < 2:
        return 1.0
    total, squares, between, within, count = (float(x) for x in row)
    within /= total
    spread = total - squares / total
    tau = (between - (count - 1) * within) / spread if spread > 0 else 0.0
    return float(np.clip(within / tau - 1, 1.0, 1e4)) if tau > 0 else 1e4


def quality_posterior(
    documents: DataFrame, labels: DataFrame, host, path, text: str = "text", doc_id: str = "doc_id",
    label: str = "quality", max_rows: int = MAX_ROWS,
) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, keep for every row of documents.

    evidence is the document classifier's probability of good quality: logistic regression over
    FEATURES, fitted on up to max_rows labelled rows (those with the smallest hash of their id).
    host and path are columns; a path belongs to its host. The mean evidence of a host is shrunk
    towards the mean of all documents, that of a path towards its host's posterior, each as far as
    the spread between groups beyond chance allows, so sparse sites stay near their prior. A
    document's own evidence has no part in its posteriors; score puts its path's posterior odds in
    the place of the global odds under that evidence; keep is score >= 0.5.

    Null hosts and paths are groups of their own; null and empty texts have features of zero;
    repeated rows count and are returned each; labels that are null are left out, of several of
    one id the largest counts. Without labels evidence is 0.5. Other columns are ignored.
    """
    text_batches()
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), host.alias("__host"), path.alias("__path"),
        features_column(F.col(text)).alias("__x"),
    )
    rows = checkpointed(rows)
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y")).dropna()
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    known = known.orderBy(F.xxhash64(F.lit(13), "__id"), "__id").limit(max_rows)
    one = rows.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).groupBy("__id")
    sample = one.agg(F.max("__y").alias("y"), F.min("__x").alias("x")).orderBy("__id").collect()  # max_rows at most
    x = np.array([r["x"] for r in sample], dtype=float).reshape(len(sample), len(FEATURES))
    weights, bias = fit_logistic(x, np.array([r["y"] for r in sample], dtype=float))
    logit = F.lit(bias)
    for i, w in enumerate(weights.tolist()):
        logit = logit + F.lit(w) * F.col("__x")[i]
    logit = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), logit))
    rows = rows.select("doc_id", "__host", "__path", (1 / (1 + F.exp(-logit))).alias("evidence"))
    rows = rows.withColumn("__site", F.coalesce(F.concat(F.lit("="), F.col("__host").cast("string")), F.lit("~")))
    rows = rows.withColumn("__part", F.coalesce(F.concat(F.lit("="), F.col("__path").cast("string")), F.lit("~")))
    paths = rows.groupBy("__site", "__part").agg(F.sum("evidence").alias("s"), F.count(F.lit(1)).alias("n"))
    paths = checkpointed(paths)
    hosts = paths.groupBy("__site").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = float(np.clip(total[0] / total[1], 1e-6, 1 - 1e-6)) if total[1] else 0.5
    above = _strength(hosts.withColumn("c", F.lit(mean)), "s", "n", "c")
    hosts = hosts.select("__site", F.col("s").alias("__hs"), F.col("n").alias("__hn"))
    paths = paths.join(hosts, "__site")
    shrunk = (F.lit(above * mean) + F.col("__hs")) / (above + F.col("__hn"))
    within = _strength(paths.withColumn("c", shrunk), "s", "n", "c")
    out = rows.join(paths, ["__site", "__part"])
    own = F.col("evidence")
    shrunk = (F.lit(above * mean) + F.col("__hs") - own) / (above + F.col("__hn") - 1)
    out = out.withColumn("host_posterior", shrunk)
    shrunk = (within * F.col("host_posterior") + F.col("s") - own) / (within + F.col("n") - 1)
    out = out.withColumn("path_posterior", shrunk)
    prior = float(np.log(mean / (1 - mean)))
    score = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + _logit(F.col("path_posterior")) - prior)))
    out = out.select("doc_id", "evidence", "host_posterior", "path_posterior", score.alias("score"))
    return out.withColumn("keep", (F.col("score") >= 0.5).cast("int"))


def site_of(url):
    """(host, path) columns of a URL: its host, lower-cased, without user and port, and the first segment of its path."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:]+)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)
