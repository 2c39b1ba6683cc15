import random
import re

import pandas as pd
from pyspark.sql import functions as F

from lurescope.functions import text as T

EDGE = [
    "plain", "a\u00a0\u00a0b\u001cc\t\nd", r"C:\new\temp\r x", "SSN 123-45-6789 card 4111 1111 1111 1111",
    "call +1 (555) 123-4567 or 555.123.4567", "1234567890123456", "12-34 56-78 9012 3456",
    "mail a.b+c@d-e.example, x@y", "go http://a.example/x?y=1, www.b.example. <URL> <EMAIL> <SSN>",
    "http://u@v.example:80/123-45-6789/5551234567", "", "   ", "999-99-99991", "٣٣٣-٣٣-٣٣٣٣",
    "+44 20 7946 0958", "123-45-6789-123-45-6789", "a@b.co@c.de", "éç 4111-1111-1111-1111é",
]


def fuzz(n=400):
    rng = random.Random(2)
    pieces = ["123-45-6789", "4111 1111 1111 1111", "(555) 123 4567", "a@b.example", "http://x.example/é",
              "www.q", " ", "-", ".", "7", "55", "@", "<URL>", "\\n", "\n", "text", "\u2003", "+1"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def py_clean(text):
    for literal in ("\\n", "\\t", "\\r"):
        text = text.replace(literal, " ")
    return " ".join(text.split())


def py_redact(text):
    counts = {}
    for token, pattern in T.REDACTIONS:
        text, counts[token] = re.subn(pattern, token, text)
    return text, counts


def test_clean_and_redact_match_python(spark):
    data = EDGE + fuzz()
    frame = spark.createDataFrame(list(enumerate(data)), "id int, raw string")
    frame = frame.withColumn("clean", T.clean_text(F.col("raw")))
    for row in T.with_redaction(frame, "clean").collect():
        want = py_clean(data[row["id"]])
        assert row["clean"] == want
        redacted, counts = py_redact(want)
        assert row["text"] == redacted, want
        got = {t: row[f"n_{t[1:-1].lower()}"] for t in T.TOKENS}
        assert got == counts, want


def test_null_text_and_length_bounds(spark):
    frame = spark.createDataFrame([(None,), ("x" * 9,), ("x" * 10,), ("x" * 50_000,), ("x" * 50_001,)], "t string")
    assert frame.where(T.within_length(F.col("t"))).count() == 3
    assert frame.where(T.within_length(F.col("t"), T.MIN_CHARS, T.MAX_CHARS)).count() == 2
    assert frame.select(T.clean_text(F.col("t"))).first()[0] == ""


def test_casing_and_tokens(spark):
    frame = spark.createDataFrame([("Ab1",), ("",), ("ÀÉ",), ("abc d\u00a0e",)], "t string")
    rows = frame.select(T.uppercase_share(F.col("t")), T.has_capital(F.col("t")), T.token_count(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(0.5, True, 1), (0.0, False, 0), (1.0, False, 1), (0.0, False, 3)]


def test_redact_columns_keeps_other_types(spark):
    frame = spark.createDataFrame([(7, "a@b.example", 1.5)], "email_id bigint, text string, w double")
    native = T.redact_columns(frame, ["text"])
    custom = T.redact_columns(frame, ["text"], lambda s: pd.Series(["***"] * len(s)))
    assert native.schema == custom.schema == frame.schema
    assert native.first()["text"] == "<EMAIL>" and custom.first() == (7, "***", 1.5)


def test_redactor_sees_slices_of_bounded_size(spark):
    rows = [(i, chr(97 + i % 26) * 20_000 if i % 5 else None, "é" * (i % 7)) for i in range(300)] + [(300, "z" * 3_000_000, "")]
    frame = spark.createDataFrame(rows, "id int, text string, other string").coalesce(1)

    def sizes(texts):
        return texts.map(lambda t: f"{t[:1]}{len(t)}", na_action="ignore") + f" {sum(len(t) for t in texts if t)}"

    got = T.redact_columns(frame, ["other", "text"], sizes)
    assert got.columns == ["id", "text", "other"] and T.redact_columns(frame, [], sizes).columns == got.columns
    for (i, text, other), r in zip(rows, got.orderBy("id").collect()):
        if text is None:
            assert r["text"] is None
        else:
            what, seen = r["text"].split(" ")
            assert what == f"{text[0]}{len(text)}" and int(seen) <= max(len(text), 1 << 20)
        assert r["other"].split(" ")[0] == f"{other[:1]}{len(other)}"



def test_redaction_runs_each_pattern_once(spark):
    frame = spark.range(3).select(F.lit("x").alias("raw"))
    plan = T.with_redaction(frame.select(F.concat("raw", F.rand().cast("string")).alias("raw")), "raw")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # One replacement per pattern in the plan, however many columns read the result.
    assert text.count("<SSN>, 1") <= 1 and text.count("<CARD>, 1") <= 1
