"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning in a concept phrase, and in a question about entities.
CONCEPT_STOP = ["the", "a", "an", "of", "for", "and", "at", "in", "on", "to", "s"]
# Fixed value: words a lexical index leaves out.
ENGLISH_STOP = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
WHOLE_DOCUMENT = "FULL"

CITATION = r"[\[【［]\s*\d{1,3}(?:\s*[,;]\s*\d{1,3})*\s*[\]】］]"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named: inside a lambda nothing else spares the repetition."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """``words`` without stop words."""
    return F.filter(words(text), lambda w: ~w.isin(*stop)) if stop else words(text)


def normalise(text: Column) -> Column:
    """Lower-case ASCII words joined by one space."""
    return F.array_join(words(text), " ")


def token_set(text: Column) -> Column:
    return F.array_except(words(text), F.array(*map(F.lit, CONCEPT_STOP)))


def entity_terms(text: Column, noise: list[str]) -> Column:
    """Distinct lower-case words of two characters or more, without ``noise``."""
    found = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9&]+)"), F.lit(1)), F.lower)
    return F.filter(F.array_except(found, F.array(*map(F.lit, noise))), lambda w: F.length(w) > 1)


def overlap_score(want: Column, have: Column) -> Column:
    """Share of the wanted words that are there, less a hundredth for each word too many."""
    return F.size(F.array_intersect(want, have)) / F.nullif(F.size(want), F.lit(0)) - F.lit(0.01) * F.size(F.array_except(have, want))


def cik10(text: Column) -> Column:
    return F.lpad(F.regexp_replace(F.upper(F.trim(text)), "^CIK", "").cast("bigint").cast("string"), 10, "0")


def item_key(part: Column, item: Column) -> Column:
    return F.when(part != "", F.concat_ws(".", part, item)).otherwise(item)


def embed_text(ticker: Column, form: Column, period_end: Column, item: Column, title: Column, text: Column) -> Column:
    """Who and when before a passage, so that a ranker can tell filings apart."""
    named = F.concat(F.lit(" -- Item "), item, F.when(title != "", F.concat(F.lit(". "), title)).otherwise(""))
    head = F.concat(F.concat_ws(" ", ticker, form, period_end), F.when(item != WHOLE_DOCUMENT, named).otherwise(""))
    return F.concat(head, F.lit("\n\n"), text)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def archive_url(base: str, cik: Column, accn: Column, doc: Column) -> Column:
    """Path of a filed document; empty if any part is missing."""
    whole = F.concat(F.lit(base.rstrip("/") + "/"), cik.cast("bigint").cast("string"), F.lit("/"), F.regexp_replace(accn, "-", ""), F.lit("/"), doc)
    return F.when((F.coalesce(cik, F.lit("")) != "") & (F.coalesce(accn, F.lit("")) != "") & (F.coalesce(doc, F.lit("")) != ""), whole).otherwise("")


def text_citation(ticker, form, period_end, item_key_, accn, start, end) -> Column:
    item = F.when(item_key_ == WHOLE_DOCUMENT, "").otherwise(F.concat(F.lit(" Item "), item_key_))
    return F.concat(ticker, F.lit(" "), form, F.lit(" "), period_end, item, F.lit(" ["), accn, F.lit(" "), start.cast("string"), F.lit(":"), end.cast("string"), F.lit("]"))


def fact_citation(ticker, form, period_end, tag, accn) -> Column:
    return F.concat(F.concat_ws(" ", ticker, form, period_end.cast("string"), tag), F.lit(" ["), accn, F.lit("]"))


def _blank(text: Column, pattern: str, keep: int = 0) -> Column:
    """Each match blanked but for its first ``keep`` characters; lengths stay, so offsets do."""

    def blank(t):
        gaps = F.split(t, pattern, -1)
        hits = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.substring(m, 1, keep), F.rpad(F.lit(""), F.length(m) - keep, F.lit(" "))))
        return F.when(t.rlike(pattern), F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")).otherwise(t)

    return let(text, blank)


def strip_citations(text: Column) -> Column:
    """Without citation marks, and without month and day of ISO dates."""
    return _blank(_blank(text, CITATION), ISO_DATE, 4)


def markers(text: Column) -> Column:
    """Numbers inside citation brackets, in order, each once."""
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit(r"(\d{1,3})"), F.lit(1))))
    return F.array_distinct(F.transform(found, lambda m: m.cast("int")))


def single_markers(text: Column, shown: Column) -> Column:
    """The narrower reader: single-number brackets of any of four kinds, within 1 to ``shown``."""
    plain = F.translate(text, "【】［］", "[][]")
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda m: m.cast("int"))
    return F.array_distinct(F.filter(found, lambda i: (i >= 1) & (i <= shown)))


def sentences(answer: Column) -> Column:
    """Sentences of an answer: after ``.!?`` and white space, or at line ends."""
    return F.filter(F.transform(F.split(answer, SENTENCE_END), F.trim), lambda s: s != "")


def json_object(reply: Column) -> Column:
    """The text of the JSON object in a model's reply, fenced or bare; null if there is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(reply)
    got = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(got).isNotNull(), F.nullif(got, F.lit("")))


def quote(text: Column, pattern: str, window: int = 240) -> Column:
    """The surroundings of the first match, on one line."""
    at = F.regexp_instr(text, F.lit(pattern))
    got = F.substring(text, F.greatest(F.lit(1), at - window // 2), F.lit(window))
    return F.when(at > 0, F.trim(F.regexp_replace(got, r"\s+", " "))).otherwise("")
