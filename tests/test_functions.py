"""Column functions on literal rows."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import ids, numbers, spans, text, vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"]).select(column).first()[0]


@pytest.mark.parametrize(("days", "name"), [(90, "Q"), (98, "Q"), (168, "H"), (182, "H"), (252, "9M"), (273, "9M"), (365, "FY"), (371, "FY"), (None, "instant"), (140, "other"), (450, "other"), (66, "Q"), (116, "Q"), (117, "other"), (340, "FY"), (391, "other"), (-5, "other")])
def test_spans(spark, days, name):
    assert spark.createDataFrame([(days,)], "d int").select(spans.classify(F.col("d"))).first()[0] == name


def test_inclusive_days_and_dates(spark):
    r = spark.createDataFrame([("2024-01-01", "2024-12-31"), ("x", "2024-02-30")], "a string, b string")
    got = r.select(spans.period_days(spans.iso_date(F.col("a")), spans.iso_date(F.col("b")))).collect()
    assert [x[0] for x in got] == [366, None]
    assert r.select(spans.iso_date(F.lit(" 2024-01-02T00:00"))).first()[0] == dt.date(2024, 1, 2)


def test_uuid5(spark):
    for name in ("a:0:10", "ünï:1:2", ""):
        assert one(spark, ids.uuid5(ids.CHUNK_NAMESPACE, F.col("n")), n=name) == str(uuid.uuid5(uuid.UUID(ids.CHUNK_NAMESPACE), name))


def read(spark, s):
    return [(r.text, r.face, list(r.readings), r.digits, r.money, r.bare_int) for r in one(spark, numbers.readings(F.col("s")), s=s)]


def test_readings(spark):
    assert read(spark, "nothing here") == [] and read(spark, "") == []
    assert read(spark, "up to 2.4 billion dollars")[0][1:3] == (2.4, [2.4e9])
    (a,) = read(spark, "a loss of $(1,234) then")
    assert a == ("(1,234)", -1234.0, [-1234.0, -1234e3, -1234e6, -1234e9, -1234e12], "1234", True, True)
    assert [x[1] for x in read(spark, "-5 on 2022-08-28, 10-15% and v1.2")] == [-5.0, 2022.0, 8.0, 28.0, 10.0, 15.0]
    assert [x[3] for x in read(spark, "007 and .5 and 0")] == ["7", ".5", "0"]
    assert read(spark, "5 millions, 6 millionaires")[0][2] == [5e6]
    assert len(read(spark, "6 millionaires")[0][2]) == 5


def test_a_scale_word_adds_a_reading_for_the_scorer(spark):
    got = one(spark, numbers.parse_numbers(F.col("s")), s="2.4 billion")
    assert got == [2.4e9, 2.4, 2.4e3, 2.4e6, 2.4e9, 2.4e12]


@pytest.mark.parametrize(("answer", "gold", "ok"), [("16,434", 16434e6, True), ("$16.4 billion", 16434e6, True), ("15,000", 16434e6, False), ("none", 5.0, False), ("0.004", 0.0, True), ("(12)", -12.0, True)])
def test_numeric_match(spark, answer, gold, ok):
    assert one(spark, numbers.numeric_match(F.col("a"), F.col("g")), a=answer, g=gold) is ok


def test_renderings(spark):
    got = one(spark, numbers.renderings(F.col("v")), v=-1_234_567.0)
    assert {"1,234,567", "1234567", "(1,234,567)", "1,234", "1235", "(1,235)", "1", "(1)"} <= set(got)
    assert one(spark, numbers.renderings(F.col("v")), v=0.0) == []


def test_citations(spark):
    s = "Rose [1], fell 【2, 3】 and [9;1] in 2022-08-28."
    assert one(spark, text.markers(F.col("s")), s=s) == [1, 2, 3, 9]
    assert one(spark, text.single_markers(F.col("s"), F.lit(5)), s="a [1]【2】［3］ [2, 3] [7] [1]") == [1, 2, 3]
    got = one(spark, text.strip_citations(F.col("s")), s=s)
    assert len(got) == len(s) and got == "Rose    , fell        and       in 2022      ."


def test_sentences_and_json(spark):
    assert one(spark, text.sentences(F.col("s")), s="It made $60.9 billion. Good!  Then\nmore") == ["It made $60.9 billion.", "Good!", "Then", "more"]
    assert one(spark, text.json_object(F.col("s")), s='Here: ```json\n{"a": 1}\n``` ok') == '{"a": 1}'
    assert one(spark, text.json_object(F.col("s")), s="no {broken") is None


def test_words(spark):
    assert one(spark, text.normalise(F.col("s")), s="Assets, Current (Ütal)") == "assets current tal"
    assert one(spark, text.token_set(F.col("s")), s="The cost of the goods") == ["cost", "goods"]
    assert one(spark, text.overlap_score(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(0.49)
    assert one(spark, text.cik10(F.col("s")), s="CIK320193") == "0000320193"
    assert one(spark, text.estimate_tokens(F.col("s")), s="abc") == 1
    assert one(spark, text.item_key(F.lit("II"), F.lit("1A"))) == "II.1A" and one(spark, text.item_key(F.lit(""), F.lit("7"))) == "7"
    args = [F.lit(x) for x in ("T", "10-K", "2024-01-01")]
    assert one(spark, text.embed_text(*args, F.lit("1A"), F.lit("Risks"), F.lit("x"))) == "T 10-K 2024-01-01 -- Item 1A. Risks\n\nx"
    assert one(spark, text.embed_text(*args, F.lit("FULL"), F.lit("Risks"), F.lit("x"))) == "T 10-K 2024-01-01\n\nx"
    assert one(spark, text.archive_url("https://x/", F.lit("0000000012"), F.lit("0-1-2"), F.lit("d.htm"))) == "https://x/12/012/d.htm"
    assert one(spark, text.archive_url("https://x/", F.lit("12"), F.lit(""), F.lit("d.htm"))) == ""


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, a)) == pytest.approx(1.0) and one(spark, vectors.cosine(a, b)) is None
    assert one(spark, vectors.normalised(a)) == [0.6, 0.8] and one(spark, vectors.normalised(b)) == [0.0, 0.0]
