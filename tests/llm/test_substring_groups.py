"""Groups of substring removal: ids with a stride, and one id of very many rows."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import substrings


def test_strided_ids_are_spread(spark):
    groups = 3
    ids = np.arange(0, 3000, 3)
    assert np.bincount(substrings.group_of(ids, groups), minlength=3).min() > 250
    same = spark.createDataFrame([(int(i),) for i in ids[:50]], "id long").select("id", substrings._group(F.col("id"), groups).alias("g")).collect()
    assert [r.g for r in same] == substrings.group_of(np.array([r.id for r in same]), groups).tolist()


def test_an_id_of_many_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ROWS", 10)
    monkeypatch.setattr(substrings, "CHARS_PER_GROUP", 500)
    shared = "one two three four five six"
    rows = [(1, f"{shared} a{k}") for k in range(3)] + [(7, f"x{k} {shared} y{k}") for k in range(45)] + [(9, f"z {shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert substrings.crowded(docs, "doc_id") == {7: 5}
    got = sorted((r.doc_id, r.kept) for r in substrings.deduplicate(docs, length=6).collect())
    assert got == sorted([(i, t) if i == 1 else (i, " ".join(w for w in t.split() if w not in shared.split())) for i, t in rows])
    monkeypatch.setattr(substrings, "HOT_ROWS", 10_000)
    assert sorted((r.doc_id, r.kept) for r in substrings.deduplicate(docs, length=6).collect()) == got
