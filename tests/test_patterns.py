"""The pattern dictionary of a query."""

import random

from packloom import queries


def test_all_patterns_of_the_dictionary_are_applied(spark, tmp_path):
    """700 patterns, each twice in one of two texts: more than 500, fewer than a dictionary holds."""
    rng = random.Random(4)
    blocks = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=64)) for _ in range(700)]
    rows = [(k, "".join(half + rng.sample(half, 350)), "en", "src1", 64 * 700) for k, half in enumerate((blocks[:350], blocks[350:]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["i8_apply_patterns"](spark, str(tmp_path)).collect()
    assert [(r["references"], r["literals"], r["same"]) for r in found] == [(700, 0, True)] * 2
