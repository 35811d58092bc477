import pytest

#: Rows with everything that may go wrong: nulls, empty and long texts, ties, repeated rows, and columns named like internal ones.
NASTY = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all the others in the wood at night.", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from all the others in the wood at night.", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, "", None),
    (6, "word " * 3000, "b"),
    (7, "x" * 5000, "c"),
    (8, "Ünïcode text 漢字かな交じり文 \U0001f600 ſKéÀ password = \"hunter2hunter2\" deadbeefdeadbeefdeadbeef", "c"),
    (8, "Ünïcode text 漢字かな交じり文 \U0001f600 ſKéÀ password = \"hunter2hunter2\" deadbeefdeadbeefdeadbeef", "c"),
    (None, "The quick brown fox jumps over the lazy dog and runs away from all the others in the wood at night.", None),
    (None, None, None),
    (9, " \t\n ", "a"),
]
EXTRA = ["_id", "_norm", "kept", "ids", "n_tokens", "secrets", "start", "_text", "_sig", "class_id", "size", "target", "rep", "count", "_gone", "_kept", "_drawn", "epochs", "part", "_epochs", "_copy", "_cuts", "_key", "taken", "copies", "component"]


@pytest.fixture(scope="session")
def nasty(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(NASTY, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in EXTRA})
