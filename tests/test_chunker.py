from pyspark.sql import functions as F

from siltstone.operators.chunking import Limits, chunks, cut, markdown_blocks, split_code, tail
from siltstone.sources import reports

SMALL = Limits(target=10, most=15, overlap=3, least=3)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_fences_are_atomic_and_open_ones_run_on(spark):
    blocks = one(spark, "one\ntwo\n\nthree\n```python\na\n\nb\n```\nfour\n```\nopen\n\nend", markdown_blocks)
    assert [tuple(b)[:3] for b in blocks] == [("one\ntwo", False, None), ("three", False, None), ("```python\na\n\nb\n```", True, "python"), ("four", False, None), ("```\nopen\n\nend", True, None)]


def test_cut_and_tail_keep_the_original(spark):
    assert one(spark, "a b, c  d", lambda c: cut(c, 2)) == ["a b", ", c", "d"]
    assert one(spark, "a b c d", lambda c: tail(c, 2)) == "c d" and one(spark, "a", lambda c: tail(c, 2)) == "a"


def test_long_code_is_fenced_again(spark):
    parts = one(spark, "```py\n" + "\n".join("x = 1" for _ in range(10)) + "\n```", lambda c: split_code(c, F.lit("py"), 15))
    assert all(p.startswith("```py\n") and p.endswith("\n```") for p in parts)
    assert sum(p.count("x = 1") for p in parts) == 10 and len(parts) == 5
    assert one(spark, "```\n" + "y " * 30 + "\n```", lambda c: split_code(c, F.lit(None), 16))[0] == "```\n" + "y " * 9 + "y\n```"


def test_small_tail_merges_and_text_overlaps(spark):
    got = one(spark, "a b c d e f g h\n\ni j k l m n o p\n\nq", lambda c: chunks(c, SMALL))
    assert [c["text"] for c in got] == ["a b c d e f g h", "f g h\n\ni j k l m n o p\n\nq"] and [c["n"] for c in got] == [8, 12]
    assert one(spark, None, chunks) == [] and one(spark, "  \n\n ", chunks) == []


def test_no_overlap_before_code_and_language_of_mixed_chunks(spark):
    got = one(spark, "a b c d e f g h\n\n```py\nx = 1\n```", lambda c: chunks(c, Limits(8, 30, 3, 2)))
    assert got[1]["text"].startswith("```py") and got[1]["language"] == "py"
    mixed = one(spark, "a b\n\n```py\nx\n```", lambda c: chunks(c, Limits(40, 60, 3, 2)))
    assert mixed[0]["code"] and mixed[0]["language"] == "py"
    two = one(spark, "```py\nx\n```\n\n```sh\ny\n```", lambda c: chunks(c, Limits(40, 60, 3, 2)))
    assert len(two) == 1 and two[0]["language"] is None
    joined = one(spark, "```py\n" + "x " * 20 + "\n```\n\nshort", lambda c: chunks(c, Limits(20, 60, 3, 4)))
    assert len(joined) == 1 and joined[0]["language"] is None and joined[0]["code"]


def test_long_prose_is_cut(spark):
    got = one(spark, " ".join(f"w{i}" for i in range(40)), lambda c: chunks(c, Limits(10, 15, 0, 3)))
    assert [c["n"] for c in got] == [15, 15, 10] and " ".join(c["text"] for c in got) == " ".join(f"w{i}" for i in range(40))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", "PASS", True), ("c", "NOT_RUN", False)], "code string, status string, required boolean")
    assert reports.markdown(df, "T").splitlines()[4] == "| a\\|b | PASS | True |"
    assert reports.overall(df).first()["overall"] == "WARNING"
    reports.write_json(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
