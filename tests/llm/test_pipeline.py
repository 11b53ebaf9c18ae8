"""Stages of the pipeline on planted rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from packloom.llm.staging import stage  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = " ".join(f"Sentence number {k} has its own words." for k in range(30))
    near = text.replace("number 3 ", "numeral 3 ")
    planted = [(90_001, text, "en", "src0", len(text)), (90_002, text, "en", "src0", len(text)), (90_003, near, "en", "src0", len(near)), (90_004, "12345 !!!", "en", "src0", 9), (90_005, None, None, None, None)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    steps = dict(corpus_pipeline.STAGES)
    for name in list(steps)[:-1]:
        empty = steps[name](spark, docs.limit(0), FOLDER)
        assert empty.columns == docs.columns and empty.count() == 0
    for name, step in list(steps.items())[:-1]:
        ids = {r["doc_id"] for r in step(spark, docs, FOLDER).collect()}
        if name == "language":
            assert not {90_004, 90_005} & ids and {90_001, 90_002, 90_003} <= ids
        if name == "near_duplicates":
            assert {90_001, 90_004, 90_005} <= ids and not {90_002, 90_003} & ids
        if name == "line_dedup":
            assert 90_001 in ids and 90_002 not in ids and {90_004, 90_005} <= ids
        assert ids <= {r["doc_id"] for r in docs.collect()}


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and clashing columns, through each stage and the next."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    long = " ".join(f"Sentence number {k} has its own words." for k in range(8_000))
    short = "A short text of a few plain words."
    rows = [(None, None, None, None, None), (None, short, None, None, None), (80_001, "", "en", None, 0), (80_002, long, None, "src0", None), (80_003, short, "en", "src0", 1), (80_003, short, "en", "src0", 1), (80_004, None, "en", "src0", None)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    docs = docs.withColumns({c: F.lit(f"clash {c}") for c in ("id", "key", "keep", "n", "digest", "n_removed", "n_lines", "component_id", "kept", "score", "distance", "position", "queue", "__id", "lang_pred")})
    before = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    chained = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, FOLDER), "test")
        chained = stage(step(spark, chained, FOLDER), "test")
        assert out.columns == chained.columns == docs.columns
        assert all(r[c] == f"clash {c}" for r in out.collect() for c in docs.columns[5:])
        found = Counter((r["doc_id"], r["text"]) for r in out.collect())
        if name != "line_dedup":
            assert not found - before
            # equal rows share their fate, rows of a null id stay
            assert found[80_003, short] in (0, 2) and found[None, short] == 1 and found[None, None] == 1
        if name == "language":
            assert found[80_001, ""] == found[80_004, None] == 0 and found[80_002, long] == 1
        elif name != "toxicity":
            assert found[80_001, ""] == found[80_004, None] == found[80_002, long] == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    pieces = packed.groupBy("doc_id").agg(F.sum("length").alias("length"), F.max("doc_tokens").alias("doc_tokens")).collect()
    tokens = {r["doc_id"]: (r["length"], r["doc_tokens"]) for r in pieces}
    assert tokens[80_001] == tokens[80_004] == (1, 1) and tokens[80_003][0] == 2 * tokens[80_003][1] and tokens[80_002][0] == tokens[80_002][1] > 8_000
    assert corpus_pipeline.STAGES[-1][1](spark, chained, FOLDER).where("length < 1 or length > 1024").count() == 0


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, FOLDER), "test")
    columns = ["doc_id", "start", "length", "sequence_id", "offset"]
    assert sorted(docs.select(columns).collect()) == sorted(corpus_pipeline.run(spark, FOLDER).select(columns).collect())
