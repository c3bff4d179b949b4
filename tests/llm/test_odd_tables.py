"""Nulls in any column, empty and very long texts, repeated rows, no rows, extra columns with clashing names."""

import pytest

import corpus_pipeline
from loopsight.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, score double, n string, root long, matches int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (None, "alone here", "en", None, 10), (4, LONG, "en", "b", len(LONG)),
    (4, LONG, "en", "b", len(LONG)), (5, LONG + " end", "de", "b", None), (6, "a", "en", "a", 1), (7, "\t \n", "en", "a", 3),
    (8, "token = abcdef123456 under the MIT License", "en", "c", 42), (None, None, None, None, None),
]


@pytest.fixture(scope="module", params=["odd", "none"])
def folder(request, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp(request.param))
    docs = [(*r, 9, "x", 0.5, "y", 3, 1) for r in ROWS]
    vectors = [(0, [1.0, 2.0]), (20, [1.0, None]), (40, None), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]),
               (60, [float("nan"), 1.0]), (80, [3.0]), (3, [float("inf"), 0.0]), (100, [])]
    tables = {
        "documents": (docs, DOCS),
        "labels": ([(1, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (6, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, "alone here"), (2, None), (None, "a"), (3, "")], "item_id long, text string"),
        "embeddings": (vectors, "vec_id long, embedding array<float>"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows if request.param == "odd" else [], schema).write.parquet(f"{d}/{name}.parquet")
    return request.param, d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    kind, d = folder
    rows = queries.QUERIES[name](spark, d).collect()
    if kind == "none":
        assert not rows
    elif name == "op2_topk":
        found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows)
        assert found == [(0, 1, 1, 64 * 64 * 5), (0, 2, 1, 64 * 64 * 5)]
    elif name == "op9_decontamination":
        assert [(r["doc_id"], r["item_id"]) for r in rows] == [(None, 1)]
    else:
        assert len(rows) == len(ROWS)
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


def test_values(spark, folder):
    kind, d = folder
    if kind == "none":
        return
    removed = {r["doc_id"]: r for r in queries.op3_substrings(spark, d).collect()}
    assert removed[4]["n_removed"] == removed[4]["n_words"] == 60_000
    assert removed[1]["n_words"] == removed[2]["n_removed"] == 0
    prints = {r["doc_id"]: r for r in queries.op5_simhash(spark, d).collect()}
    assert prints[1]["fingerprint"] == prints[7]["fingerprint"] == "0" * 16
    assert prints[1]["component_id"] == prints[2]["component_id"] == prints[7]["component_id"] == 1
    assert prints[5]["component_id"] == 4


def test_pipeline(spark, folder):
    kind, d = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.mode("overwrite").parquet(f"{d}/stage{i}")  # fails if a column's name stands twice
        rows = spark.read.parquet(f"{d}/stage{i}").collect()
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        assert kind == "odd" or not rows
        if i < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame(rows, out.schema)
    assert kind == "none" or rows
