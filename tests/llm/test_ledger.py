"""The stored blob ledger: later runs scan only what it lacks; null and repeated paths."""

from pyspark.sql import functions as F

from helixframe.llm import secrets


def test_runs_share_a_stored_ledger(spark, tmp_path):
    at = f"{tmp_path}/ledger"
    text = "password = hunter2hunter2"
    rows = [("a", 1, text), ("a", 2, "clean"), (None, 1, text), (None, 1, text), ("b", 1, None), ("c", 1, f"x {text}")]
    history = spark.createDataFrame(rows, "path string, version int, content string")
    assert secrets.read_ledger(spark, at) is None
    first = secrets.run(history.where("version = 1 AND path IS NOT NULL"), "path", "version", "content", at)
    assert first.where(F.size("assign") > 0).count() == 2
    entries = secrets.read_ledger(spark, at).count()
    assert entries == 3 * len(secrets.RULES)  # two texts with findings and the empty one
    again = secrets.run(history, "path", "version", "content", at)
    assert secrets.read_ledger(spark, at).count() == entries + len(secrets.RULES)  # only "clean" is new
    found = sorted((str(r.path), r.version, [(s.start, s.end) for s in r.assign]) for r in again.collect())
    assert found == [("None", 1, [(0, 25)]), ("None", 1, [(0, 25)]), ("a", 1, [(0, 25)]), ("a", 2, []), ("b", 1, []), ("c", 1, [(2, 27)])]
    newer = (secrets.Rule("assign", secrets.RULES[0].pattern, 2, 6, version=2),)
    secrets.run(history, "path", "version", "content", at, newer)
    assert secrets.read_ledger(spark, at).where("rule = 'assign@2'").count() == 4
