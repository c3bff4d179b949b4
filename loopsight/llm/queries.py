"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopsight.llm.common import table
from loopsight.llm.decontaminate import benchmark_matches
from loopsight.llm.language_model import score_documents
from loopsight.llm.licenses import license_scan
from loopsight.llm.mixing import mix_sources
from loopsight.llm.quality import quality_posterior
from loopsight.llm.secret_scan import secret_spans
from loopsight.llm.simhash import hex_of, simhash_components
from loopsight.llm.substrings import repeated_phrases
from loopsight.llm.topk import top_k
from loopsight.llm.toxicity import held_out, score_column, train, training_labels


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by quality; the source is the host, the language within it the path. A fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    return quality_posterior(docs, training_labels(table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_phrases(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", license_scan(F.col("text")).alias("x"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", *[f"x.{n}" for n in names])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"))
    per_word = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), per_word.alias("per_word"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("x"))
    return found.select(
        "doc_id", "x.n_assign", "x.n_access", "x.n_hex", F.sha2(F.col("x.base").cast("binary"), 256).alias("base_sha256"),
        "x.spans", "x.layers", "x.cut",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place of a benchmark item in a document; documents without any have no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_matches(docs, table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", F.explode("matches").alias("m"))
    return found.select(
        "doc_id", "m.item_id", F.col("m.start").alias("start_word"), F.col("m.end").alias("end_word"), "m.edits"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs["text"], model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_topk": op2_topk,
    "op3_substrings": op3_substrings,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_language_model": op6_language_model,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

ORACLE_SQL = {
    "op2_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
    "op3_substrings": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        place AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35),
        win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS k FROM place),
        rec AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
        gone AS (SELECT DISTINCT doc_id, s + o AS i FROM rec, range(35) t(o)),
        kept AS (
          SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
          FROM word WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM gone) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
          sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op6_language_model": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        g AS (
          SELECT doc_id, i, x, lag(x) OVER p AS y, lag(x, 2) OVER p AS z FROM word WINDOW p AS (PARTITION BY doc_id ORDER BY i)
        ),
        one AS (SELECT x, count(*) AS n FROM word GROUP BY x),
        two AS (SELECT y, x, count(*) AS n FROM g WHERE i >= 2 GROUP BY y, x),
        three AS (SELECT z, y, x, count(*) AS n FROM g WHERE i >= 3 GROUP BY z, y, x),
        total AS (SELECT count(*) AS n FROM word),
        s AS (
          SELECT g.doc_id, CASE
            WHEN c3.n >= 2 THEN log10(c3.n / b2.n)
            WHEN c2.n >= 2 THEN log10(c2.n / b1.n) + (least(g.i, 3) - 2) * log10(0.4)
            ELSE log10(c1.n / total.n) + (least(g.i, 3) - 1) * log10(0.4) END AS v
          FROM g CROSS JOIN total JOIN one c1 ON c1.x = g.x
          LEFT JOIN one b1 ON b1.x = g.y
          LEFT JOIN two c2 ON c2.y = g.y AND c2.x = g.x
          LEFT JOIN two b2 ON b2.y = g.z AND b2.x = g.y
          LEFT JOIN three c3 ON c3.z = g.z AND c3.y = g.y AND c3.x = g.x
        ),
        t AS (SELECT doc_id, sum(v) AS v FROM s GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(v, 0.0), 4) AS log_score,
          CASE WHEN len(w) > 0 THEN round(v / len(w), 6) END AS per_word
        FROM d LEFT JOIN t USING (doc_id)
    """,
}
