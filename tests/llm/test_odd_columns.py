"""Inputs without optional columns, and labels that are none."""

import pytest

from emberlog.llm import quality, secret_spans


def test_secrets_are_masked_without_a_size_column(spark):
    docs = spark.createDataFrame([(1, "password=abcdef1 end", "x"), (2, "nothing", "y"), (3, None, "z")],
                                 "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secret_spans.mask_secrets(docs).collect()}
    assert "abcdef1" not in got[1]["text"] and got[1]["text"].startswith("password=")
    assert (got[2]["text"], got[3]["text"], got[1]["source"]) == ("nothing", None, "x")


@pytest.mark.parametrize("kind, values", [
    ("double", [0.0, 1.0, 0.7, None, 2.0]), ("string", ["0", "1", "good", None, "0.5"]), ("int", [0, 1, 5, None, -1]),
])
def test_only_labels_of_0_and_1_teach(spark, kind, values):
    described = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "doc_id long, stats array<double>")
    labels = spark.createDataFrame(list(enumerate(values)), f"doc_id long, quality {kind}")
    rows = quality.labelled(described, labels, "quality").collect()
    assert sorted((r["stats"][0], r["label"]) for r in rows) == [(0.0, 0), (1.0, 1)]
