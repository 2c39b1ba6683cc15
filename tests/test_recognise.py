import pickle
import random

from pyspark.sql import functions as F

from lurescope.functions import recognise
from lurescope.functions.text import redact_columns

NAMES = [("Ann Lee", "person", 0.9), ("Ann", "person", 0.5), ("ÉLAN Co.", "company", 0.8), ("lee", "place", 0.6), ("Ann Lee", "place", 0.2), ("x", "letter", 0.1), (" ", "blank", 1.0), (None, "none", 1.0)]


def brute(text, names=NAMES, least=0.0, with_numbers=True):
    best = {}
    for n, k, s in names:
        if n and n.strip():
            best[n.lower()] = max(best.get(n.lower(), (-1, "")), (s, k))
    low, found = "".join(c.lower() if len(c.lower()) == 1 else c for c in text), []
    for n, (s, k) in best.items():
        for i in range(len(low) - len(n) + 1):
            j = i + len(n)
            if low[i:j] == n and not (i and text[i - 1].isalnum()) and not (j < len(text) and text[j].isalnum()) and s >= least:
                found.append((i, j, s, k))
    found += recognise.numbers(text) if with_numbers else []
    out = []
    for f in sorted(found, key=lambda f: (f[0], -f[1], -f[2], f[3])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return [(k, a, b, s) for a, b, s, k in out]


def texts(n):
    rng = random.Random(8)
    parts = ["Ann", " ", "Lee", "lee", "LEE", "élan co", ".", "x", "-", "Anna", "ann lee", "4111 1111 1111 1111", "4111111111111112", "1", "İ", "é", "DE89 3704 0044 0532 0130 00", "AB", "_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)] + [None, ""]


def test_check_digits():
    assert [recognise.has_luhn_digit(d) for d in ("4111111111111111", "4111111111111112", "79927398713")] == [True, False, True]
    assert recognise.has_account_digits("GB82WEST12345698765432") and not recognise.has_account_digits("GB83WEST12345698765432")
    found = recognise.numbers("pay GB82 WEST 1234 5698 7654 32 NOW or 4111-1111-1111-1111, not 4111-1111-1111-1112 or x4111111111111111")
    assert [(k, b - a) for a, b, _, k in found] == [("card", 19), ("account", 27)]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts(400)))
    frame = spark.createDataFrame(rows, "id int, t string").repartition(4).withColumn("spans", F.lit(1))
    names = spark.createDataFrame(NAMES, "name string, kind string, score double")
    for part, least in ((100, 0.0), (2, 0.55)):
        parts = recognise.name_parts(names, score="score", part=part)
        assert len(parts) == (1 if part == 100 else 3)
        got = {r["id"]: [tuple(s) for s in r["spans"]] for r in recognise.recognise(frame, "t", parts, least=least).collect()}
        assert got == {i: brute(t or "", least=least) for i, t in rows}


def test_redactor_in_the_hook(spark):
    names = spark.createDataFrame(NAMES, "name string, kind string, score double")
    frame = spark.createDataFrame([(1, "Dear ANN LEE, card 4111 1111 1111 1111."), (2, None), (3, "Anna")], "id int, t string")
    plug = recognise.redactor(recognise.name_parts(names, score="score"))
    assert [r["t"] for r in redact_columns(frame, ["t"], plug).orderBy("id").collect()] == ["Dear <PERSON>, card <CARD>.", None, "Anna"]
    none = recognise.name_parts(names.limit(0))
    assert [len(r["spans"]) for r in recognise.recognise(frame, "t", none).orderBy("id").collect()] == [1, 0, 0]


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("Name "), F.hex("id"), F.lit(" Jr.")).alias("name"), F.lit("person").alias("kind"))
    frame = spark.range(500).select("id", F.concat(F.lit("for name "), F.hex(F.col("id") * 211), F.lit(" jr. and Name "), F.hex(F.col("id") + 200_000), F.lit(" Jr.")).alias("t"))
    found = recognise.recognise(frame, "t", recognise.name_parts(names)).collect()
    for r in found:
        assert [r["t"][s["start"] : s["end"]] for s in r["spans"]] == ([f"name {211 * r['id']:X} jr."] if 211 * r["id"] < 100_000 else [])


ODD = NAMES + [("***", "stars", 0.7), ("-x-", "letter", 0.4), (" ann", "spaced", 0.3), ("Lee Ann.", "person", 0.9), ("ann lee ann lee", "group", 0.8), ("a\0b", "zero", 0.3)]


def odd_texts(n):
    rng = random.Random(9)
    parts = ["Ann", " ", " ", "Lee", "lee.", "*", "***", "-", "-x-", "x", "\u0130", "\U0001F600", "a\0b", "élan co.", "\0"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]
    return rows + rows[:20] + [None, "", "a", "b"]


def test_a_large_table_is_joined_and_never_sent(spark):
    rows = list(enumerate(odd_texts(400)))
    # The frame has columns named like the ones the join needs.
    frame = spark.createDataFrame(rows, "id int, t string").repartition(3).select("id", "t", F.lit(1).alias("_key"), F.lit(2).alias("_found"))
    names = spark.createDataFrame(ODD, "name string, kind string, score double")
    parts = recognise.name_parts(names, score="score", part=3)
    for least, with_numbers in ((0.0, False), (0.5, True)):
        got = recognise.recognise(frame, "t", parts, with_numbers=with_numbers, least=least)
        assert got.columns == ["id", "t", "_key", "_found", "spans"]
        want = {i: brute(t or "", ODD, least, with_numbers) for i, t in rows}
        assert {r["id"]: [tuple(s) for s in r["spans"]] for r in got.collect()} == want
    assert sum(map(len, want.values())) > 100
    # What is sent has one size for any table.
    bytes_sent = (1 << recognise.FILTER_BITS - 3) + 4096
    many = spark.range(300_000).select(F.concat(F.lit("Name "), F.col("id")).alias("name"), F.lit("person").alias("kind"))
    for p in (parts, recognise.name_parts(many)):
        assert p.table is None and len(pickle.dumps(p.pieces.value)) < bytes_sent


def test_redactor_with_a_large_table(spark):
    names = spark.createDataFrame(NAMES, "name string, kind string, score double")
    rows = [(1, "Dear ANN LEE, card 4111 1111 1111 1111.", "Ann"), (2, None, "élan co."), (3, "Anna", None), (1, "Dear ANN LEE, card 4111 1111 1111 1111.", "")]
    frame = spark.createDataFrame(rows, "id int, t string, u string").repartition(2)
    parts = recognise.name_parts(names, score="score", part=2)
    assert parts.table is None
    got = redact_columns(frame, ["t", "u"], recognise.redactor(parts))
    assert got.columns == ["id", "t", "u"]
    dear = "Dear <PERSON>, card <CARD>."
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, dear, "<PERSON>"), (2, None, "<COMPANY>"), (3, "Anna", None), (1, dear, "")], key=str)
