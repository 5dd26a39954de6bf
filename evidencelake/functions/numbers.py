"""Figures in prose as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidencelake.functions import text as T

# How a figure is written, and what a scale word multiplies by.
NUMBER = r"(?<![\w.])([-(]?)\$?\s?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?|\.\d+)(\)?)"
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
SCALE_WORD = r"(?i)^(thousand|million|billion|trillion)s?\b"
TOLERANCE = 0.005
REACH = 14


def _plain(whole: Column) -> Column:
    """A figure's digits and point alone."""
    return F.translate(whole, "-($), \t\n\x0b\f\r", "")


def readings(text: Column) -> Column:
    """Every figure: its text, face value, the values it can stand for, digits, and whether it is money or a bare integer.

    A scale word right after a figure pins its value; without one, each of the
    five scales is a reading. What stands between figures comes from splitting
    by the same pattern, so no positions are needed. A text is searched once and,
    if it has figures, split once; their parts are read off the matches.
    """

    def one(whole, before, after):
        def parts(raw, word):
            size = raw.cast("double")
            negative = whole.startswith("-") | (whole.startswith("(") & whole.endswith(")"))
            scale = F.lit(None).cast("double")
            for name, x in SCALES.items():
                scale = F.when(word == name, F.lit(x)).otherwise(scale)
            bare = F.ltrim(raw, F.lit("0"))
            return F.struct(
                F.trim(whole).alias("text"), F.when(negative, -size).otherwise(size).alias("face"), scale.alias("scale"), F.when(bare == "", "0").otherwise(bare).alias("digits"),
                (F.contains(whole, F.lit("$")) | F.contains(F.substring(before, -2, 2), F.lit("$"))).alias("money"), (~F.contains(raw, F.lit("."))).alias("whole"),
            )

        word = F.lower(F.regexp_extract(F.ltrim(F.substring(after, 1, REACH)), SCALE_WORD, 1))
        return T.let(_plain(whole), lambda raw: T.let(word, lambda w: parts(raw, w)))

    def spread(r):
        every = F.array(r["face"], *[r["face"] * x for x in SCALES.values()])
        named = F.when(r["scale"].isNotNull(), F.array(r["face"] * r["scale"])).otherwise(every)
        return F.struct(r["text"].alias("text"), r["face"].alias("face"), named.alias("readings"), r["digits"].alias("digits"), r["money"].alias("money"), (r["whole"] & r["scale"].isNull()).alias("bare_int"), every.alias("every"))

    def read(t):
        def each(found):
            gaps = F.when(F.size(found) > 0, F.split(t, NUMBER, -1))
            return T.let(gaps, lambda g: F.transform(F.transform(found, lambda w, i: one(w, F.get(g, i), F.get(g, i + 1))), spread))

        return T.let(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), each)

    return T.let(text, read)


def parse_numbers(text: Column) -> Column:
    """Every value an answer could be stating: all five scales of each figure, and the one its scale word names."""
    return F.flatten(F.transform(readings(text), lambda r: F.concat(r["readings"], r["every"])))


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(b))


def numeric_match(answer: Column, gold: Column) -> Column:
    return F.coalesce(F.exists(parse_numbers(answer), lambda v: close(v, gold)), F.lit(False))


def digit_strings(text: Column) -> Column:
    """The digits of every figure, each once; that takes one search and no reading."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: T.let(F.ltrim(_plain(w), F.lit("0")), lambda x: F.when(x == "", "0").otherwise(x))))


def renderings(value: Column) -> Column:
    """How a filing may print a value: in ones, thousands or millions, cut or rounded, grouped or plain, in brackets if negative."""
    size = F.abs(value)

    def at(scale: float) -> Column:
        x = size / F.lit(scale)
        whole = F.array_distinct(F.array(F.floor(x), F.bround(x, 0).cast("bigint")))
        printed = F.flatten(F.transform(whole, lambda n: F.array(F.format_number(n, 0), n.cast("string"), F.when(value < 0, F.concat(F.lit("("), F.format_number(n, 0), F.lit(")"))))))
        return F.when(x >= 1, F.array_compact(printed)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(at(1.0), at(1e3), at(1e6)))
