import datetime

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of (doc_id, text[, lang]) with the columns of documents and two of clashing names."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENTS).repartition(partitions, "doc_id")
        clash = datetime.date(2024, 1, 1)
        from pyspark.sql import functions as F

        return frame.withColumn("version", F.lit("x")).withColumn("rank", F.lit(clash)).withColumn("words", F.lit(None).cast("int"))

    return make


#: Nulls, an empty text, spaces alone, a repeated row, equal texts and a long one.
ODD = [
    (None, "no id here at all"),
    (7, None),
    (8, ""),
    (9, " \t\n "),
    (10, "same words in this row of text"),
    (10, "same words in this row of text"),
    (11, "same words in this row of text"),
    (12, "Ünïcode  wörds and\x85odd \n spaces <|endoftext|> end "),
    (13, "long word run " * 4000),
    (14, "x" * 30000),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
