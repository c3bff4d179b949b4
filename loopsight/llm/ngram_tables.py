"""Stupid-backoff scores by plain tables: n-grams exploded, counted, joined back and summed, in DataFrame expressions alone.

The same scores as language_model.score_documents, with n-grams as text, so without any collision of
hashes. Every n-gram occurrence crosses the network several times as a row of its own; the README
gives what that takes.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.llm.common import WORD, free
from loopsight.llm.language_model import ALPHA, MIN_COUNT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exploded_grams(documents: DataFrame, text: str = "text", order: int = 3) -> DataFrame:
    """row, at, g1 to g<order>: for each word of each row the n-grams that end with it; null where the text has begun too late."""
    words = F.coalesce(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), _UPPER, _LOWER), F.lit(WORD), 0), F.array().cast("array<string>"))
    rows = documents.select("row", words.alias("w"))
    each = rows.select("row", "w", F.posexplode("w").alias("at", "g1"))
    grams = [F.when(F.col("at") >= n - 1, F.array_join(F.slice("w", F.col("at") - (n - 2), n), " ")).alias(f"g{n}") for n in range(2, order + 1)]
    return each.select("row", "at", "g1", *grams)


def gram_counts(grams: DataFrame, order: int = 3) -> DataFrame:
    """gram, n: how often each n-gram of any order stands in the corpus; summed up within tasks before it's shuffled by hash."""
    return grams.select(F.explode(F.array(*[F.col(f"g{n}") for n in range(1, order + 1)])).alias("gram")).where("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def score_by_tables(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = 3, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, log_score, defined as in language_model.score_documents, for every row of documents.

    Nulls, empty texts, repeated rows and ids, empty tables and other columns are treated as there. A frequent n-gram
    is joined by a hash of itself, a join that Spark can split.
    """
    (row,) = free(documents.columns, "row")
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    grams = exploded_grams(numbered.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text")), "text", order)
    counts = gram_counts(grams, order)
    total = grams.agg(F.count(F.lit(1)).alias("total"))
    # an n-gram's context is the (n-1)-gram that ends with the word before: that n-gram without its last word
    out = grams.withColumns({f"b{n}": F.regexp_replace(f"g{n}", r" [^ ]*$", "") for n in range(2, order + 1)})
    for name in [*(f"g{n}" for n in range(1, order + 1)), *(f"b{n}" for n in range(2, order + 1))]:
        out = out.join(counts.select(F.col("gram").alias(name), F.col("n").alias(f"n_{name}")), name, "left").drop(name)
    out = out.join(total)
    seen = F.least(F.col("at"), F.lit(order - 1))
    score = F.log10(F.col("n_g1") / F.col("total")) + seen * F.log10(F.lit(alpha))
    for n in range(2, order + 1):
        longer = F.log10(F.col(f"n_g{n}") / F.col(f"n_b{n}")) + (seen - (n - 1)) * F.log10(F.lit(alpha))
        score = F.when(F.col(f"n_g{n}") >= max(min_count, 1), longer).otherwise(score)
    sums = out.groupBy("row").agg(F.count(F.lit(1)).alias("n_words"), F.sum(score).alias("log_score"))
    found = numbered.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(row).alias("row")).join(sums, "row", "left")
    return found.select("doc_id", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
