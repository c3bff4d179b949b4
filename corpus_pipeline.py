"""From raw documents to a training mixture: each stage reads what the one before it kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopsight.llm.common import checkpointed, free, table
from loopsight.llm.decontaminate import benchmark_matches
from loopsight.llm.mixing import ADDED, mix_sources
from loopsight.llm.near_copies import drop_near_copies as near_copies_dropped
from loopsight.llm.secret_scan import redact_secrets
from loopsight.llm.toxicity import score_column, train, training_labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; null and empty texts have the score of the bias. Repeated rows all stay or all go."""
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    (score,) = free(docs.columns, "toxicity")
    return docs.withColumn(score, score_column(docs["text"], model, spark)).where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked at a similarity of 0.8 or more over five words.

    Null, empty and blank texts are one group; of repeated rows one stays.
    """
    return near_copies_dropped(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, give or take a fifth of its words; null and empty texts hold none."""
    (leaks,) = free(docs.columns, "leaks")
    found = benchmark_matches(docs, table(spark, sf_dir, "benchmark"), name=leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by [SECRET] and n_chars set to the new length; null texts stay null."""
    return redact_secrets(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with size, source_size, target, copies and taken (words, repeats counted).

    A column of documents keeps its name; one added that has the same name gets an underscore.
    Documents without words are never taken.
    """
    names = free(docs.columns, *ADDED, "taken")
    mixed = mix_sources(docs, names=tuple(names[:4]))
    return mixed.where(F.col(names[3]) > 0).withColumn(names[4], F.col(names[0]) * F.col(names[3]))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("mixing to target weights", mix_to_targets),
]

#: FTRL training, fingerprints and the knapsack program have no SQL form; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
