"""Checking answers against the evidence they were given, for all answers at once.

evidence: qid, idx (1-based), kind (fact, text, edge), body, citation, accn,
value, unit, tag, period_end, ticker, char_start, char_end.
answers: qid, answer, question, route, refused, grade_ok (null if never graded),
repairs, repair_log (array).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import numbers as N
from evidencelake.functions import text as T

# Years, guard modes, the words of a refusal and the failure tags.
YEARS = (1900, 2100)
GUARD = ("off", "flag", "block")
TAXONOMY = ("retrieval_miss", "router_wrong", "synthesis_drift", "grader_false_positive")
TIERS = ["period", "question_year", "digits", "scaled", "question", "recomputed"]


def claims(answers: DataFrame) -> DataFrame:
    """qid, pos, text, face, readings, digits, money, bare_int: every figure an answer states."""
    a = answers.select("qid", F.posexplode(N.readings(T.strip_citations(F.col("answer")))).alias("pos", "c"))
    return a.select("qid", "pos", "c.text", "c.face", "c.readings", "c.digits", "c.money", "c.bare_int")


def _carried(evidence: DataFrame) -> DataFrame:
    """One row a question: how many pieces of evidence, where each leads, the figures and years they carry, differences and shares of their values."""
    body = F.regexp_replace(F.coalesce("body", F.lit("")), T.ISO_DATE, " ")
    placed = has_locator() if {"idx", "accn", "tag", "char_start", "char_end"} <= set(evidence.columns) else F.lit(False)
    idx = F.col("idx").cast("int") if "idx" in evidence.columns else F.lit(None).cast("int")
    e = evidence.select("qid", "value", F.struct(idx.alias("i"), placed.alias("found")).alias("place"), body.alias("body"), F.coalesce("body", F.lit("")).alias("raw"), F.col("period_end").cast("string").alias("pe"))
    e = e.withColumn("said", N.readings(F.col("body")))  # read once and then used twice
    printed = N.digit_strings(F.coalesce(F.format_number("value", 0), F.lit("")))
    e = e.withColumn("digits", F.array_distinct(F.concat(F.transform("said", lambda r: r["digits"]), printed)))
    e = e.withColumn("values", F.concat(F.array_compact(F.array("value")), F.flatten(F.transform("said", lambda r: r["readings"]))))
    dated = F.transform(F.regexp_extract_all("raw", F.lit(T.ISO_DATE), F.lit(0)), lambda d: F.substring(d, 1, 4).cast("int"))
    own = F.when(F.col("pe").rlike(r"^\d{4}"), F.array(F.substring("pe", 1, 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    e = e.withColumn("years", F.concat(dated, own))
    per = e.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.collect_list("place").alias("places"),
        F.array_distinct(F.flatten(F.collect_list("digits"))).alias("ev_digits"), F.array_distinct(F.flatten(F.collect_list("values"))).alias("ev_values"),
        F.array_distinct(F.flatten(F.collect_list("years"))).alias("ev_years"), F.collect_list("value").alias("facts"),
    )
    twice = lambda x: F.size(F.filter("facts", x)) > F.size(F.array_distinct(F.filter("facts", x)))
    over = lambda f: T.let(F.array_distinct("facts"), lambda values: F.array_compact(F.flatten(F.transform(values, lambda a: F.flatten(F.transform(values, lambda b: f(a, b)))))))
    none, equal = F.array().cast("array<double>"), F.when(twice(lambda x: x.isNotNull()), F.array(F.lit(0.0)))
    share = over(lambda a, b: F.when((a != b) & (b != 0), F.array(100 * a / F.nullif(b, F.lit(0.0)), 100 * (a - b) / F.nullif(F.abs(b), F.lit(0.0)))).otherwise(none))
    per = per.withColumn("differences", F.concat(over(lambda a, b: F.when(a != b, F.array(a - b)).otherwise(none)), F.coalesce(equal, none)))
    per = per.withColumn("shares", F.concat(share, F.coalesce(F.when(twice(lambda x: x != 0), F.array(F.lit(100.0), F.lit(0.0))), none)))
    return per.drop("facts")


_CARRIED = {"n_evidence": "bigint", "places": "array<struct<i:int,found:boolean>>", "ev_digits": "array<string>", "ev_values": "array<double>", "ev_years": "array<int>", "differences": "array<double>", "shares": "array<double>"}


def _checked(answers: DataFrame, evidence: DataFrame, tolerance: float = N.TOLERANCE, key: str = "qid") -> DataFrame:
    """``answers`` with numbers (pos, text, face, status, how) and with what their evidence carries.

    An answer meets its evidence in one join, and everything else is worked out
    in its row. ``key`` is the answers' column that evidence goes by: versions of
    one answer share it, and with it evidence that is read once.
    """
    said = N.readings(T.strip_citations(F.col("answer")))
    a = answers.withColumn("_said", said).withColumn("_asked", N.digit_strings(F.coalesce("question", F.lit(""))))
    j = a.join(_carried(evidence).withColumnRenamed("qid", "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    for col, kind in _CARRIED.items():
        j = j.withColumn(col, F.coalesce(col, F.lit(0) if kind == "bigint" else F.array().cast(kind)))
    near = lambda a, b: N.close(a, b, tolerance)

    def how(c):
        year = F.when((F.abs(c["face"]) < 1e6), c["face"].cast("int"))
        is_year = c["bare_int"] & ~c["money"] & year.between(*YEARS)
        scaled = F.exists(c["readings"], lambda r: F.exists("ev_values", lambda v: near(r, v)))
        pairs = F.exists(c["readings"], lambda r: F.exists("differences", lambda v: near(r, v))) | F.exists("shares", lambda v: near(c["face"], v))
        return (
            F.when(is_year & F.array_contains("ev_years", year), "period")
            .when(is_year & F.array_contains("_asked", year.cast("string")), "question")
            .when(F.array_contains("ev_digits", c["digits"]), "digits")
            .when(scaled, "scaled")
            .when(F.array_contains("_asked", c["digits"]), "question")
            .when(pairs, "recomputed")
            .otherwise("")
        )

    def judged(c, i):
        status = lambda h: F.when(h.isin("digits", "scaled"), "supported").when(h == "recomputed", "derived").when(h.isin("period", "question"), "context").otherwise("unsupported")
        return T.let(how(c), lambda h: F.struct(i.alias("pos"), c["text"].alias("text"), c["face"].alias("face"), status(h).alias("status"), h.alias("how")))

    return j.withColumn("numbers", F.coalesce(F.transform("_said", judged), F.array().cast("array<struct<pos:int,text:string,face:double,status:string,how:string>>"))).drop("_said", "_asked")


def check_numbers(answers: DataFrame, evidence: DataFrame, tolerance: float = N.TOLERANCE) -> DataFrame:
    """Each claim with status (supported, derived, context, unsupported) and how: the strongest reason that holds.

    Claims of a question are held against what its own evidence carries, which is
    what a retriever kept for it: some tens of rows. Differences and shares of
    its facts are made once for the question, not for each claim.
    """
    n = _checked(answers.select("qid", "answer", "question"), evidence, tolerance)
    return n.select("qid", F.explode("numbers").alias("n")).select("qid", "n.*")


def has_locator(prefix: str = ""):
    """A way back to the filing: an accession number with a span, or with a tag and a period."""
    c = lambda x: F.col(prefix + x)
    span = F.coalesce(c("char_end"), F.lit(0)) > F.coalesce(c("char_start"), F.lit(0))
    named = (F.coalesce(c("tag"), F.lit("")) != "") & (F.coalesce(c("period_end").cast("string"), F.lit("")) != "")
    return (F.coalesce(c("accn"), F.lit("")) != "") & (span | named)


def citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, made, dangling, unlocatable: an answer's markers by what they lead to."""
    m = answers.select("qid", F.posexplode_outer(T.markers(F.col("answer"))).alias("pos", "i"))
    e = evidence.select("qid", F.col("idx").alias("i"), has_locator().alias("found"))
    j = m.join(e, ["qid", "i"], "left")
    of = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull() & cond, F.struct("pos", "i")))), lambda x: x["i"])
    return j.groupBy("qid").agg(of(F.col("found")).alias("made"), of(F.col("found").isNull()).alias("dangling"), of(~F.col("found")).alias("unlocatable"))


def uncited(answers: DataFrame) -> DataFrame:
    """qid, uncited: sentences that state a figure without a citation; else the whole answer if it cites nothing at all."""
    return answers.select("qid", _bare(F.col("answer")).alias("uncited"))


def _bare(text):
    bare = F.filter(T.sentences(text), lambda s: ~s.rlike(T.CITATION) & T.strip_citations(s).rlike(N.NUMBER))
    nothing = ~text.rlike(T.CITATION) & (F.trim(T.strip_citations(text)) != "")
    return T.let(bare, lambda b: F.when(F.size(b) > 0, b).when(nothing, F.array(F.trim(text))).otherwise(F.array().cast("array<string>")))


def recheck_facts(answers: DataFrame, evidence: DataFrame, stored: DataFrame, tolerance: float = N.TOLERANCE) -> DataFrame:
    """qid, unrechecked: facts (ticker, tag, period) the store no longer holds, or whose stored value no figure of the answer states.

    stored: qid, idx, val for fact evidence found in the store again (``lookup.recheck``).
    """
    said = answers.select("qid", F.flatten(F.transform(N.readings(T.strip_citations(F.col("answer"))), lambda r: r["readings"])).alias("said")).filter(F.size("said") > 0)
    key = ["qid", "ticker", "tag", "period_end"]
    f = evidence.filter((F.col("kind") == "fact") & F.col("value").isNotNull() & (F.col("ticker") != "") & (F.col("tag") != ""))
    f = f.groupBy(*key).agg(F.min("idx").alias("idx")).join(said, "qid").join(stored.select("qid", "idx", "val"), ["qid", "idx"], "left")
    name = F.concat_ws(" ", "ticker", "tag", F.col("period_end").cast("string"))
    lost = F.when(F.col("val").isNull(), F.concat(name, F.lit(" is no longer in the store")))
    bad = lost.when(~F.exists("said", lambda r: N.close(r, F.col("val"), tolerance)), F.concat(name, F.lit(" is "), F.format_number("val", 0), F.lit(" in the store, and no figure in the answer matches it")))
    return f.withColumn("problem", bad).groupBy("qid").agg(F.array_sort(F.collect_list("problem")).alias("unrechecked"))


def verdicts(answers: DataFrame, evidence: DataFrame, stored: DataFrame | None = None, key: str = "qid") -> DataFrame:
    """One row an answer: its claims, citations, uncited sentences, failure tags and ok. ``key`` is the answers' column that evidence goes by."""
    none = F.array().cast("array<string>")
    v = _checked(answers, evidence, key=key).withColumn("n_bad", F.size(F.filter("numbers", lambda n: n["status"] == "unsupported"))).withColumn("_marks", T.markers(F.col("answer")))
    leads = lambda cond: F.filter("_marks", lambda i: cond(F.filter("places", lambda p: p["i"] == i)))
    v = v.withColumn("made", leads(lambda p: F.exists(p, lambda x: x["found"]))).withColumn("dangling", leads(lambda p: F.size(p) == 0)).withColumn("unlocatable", leads(lambda p: F.exists(p, lambda x: ~x["found"])))
    v = v.join(recheck_facts(answers, evidence, stored), "qid", "left") if stored is not None else v.withColumn("unrechecked", none)
    v = v.withColumn("unrechecked", F.coalesce("unrechecked", none))
    v = v.withColumn("uncited", F.when((F.col("n_evidence") > 0) & ~F.col("refused"), _bare(F.col("answer"))).otherwise(none))
    drift = (F.size("unrechecked") > 0) | (F.col("n_bad") > 0)
    ok = F.coalesce("grade_ok", F.lit(False))
    miss = (F.col("route") != "refuse") & ((F.col("n_evidence") == 0) | (F.col("grade_ok").isNotNull() & ~ok))
    left = (F.col("repairs") > 0) & F.exists("repair_log", lambda s: F.contains(s, F.lit("fall back")) | F.contains(s, F.lit("text retriever")))
    tags = F.array_compact(F.array(F.when(miss, TAXONOMY[0]), F.when(left, TAXONOMY[1]), F.when(drift, TAXONOMY[2]), F.when(ok & (drift | (F.size("dangling") > 0)), TAXONOMY[3])))
    clean = ~drift & (F.size("dangling") == 0) & (F.size("unlocatable") == 0) & (F.size("uncited") == 0)
    return v.withColumn("taxonomy", tags).withColumn("ok", clean).select("qid", "answer", "route", "refused", "numbers", "made", "dangling", "unlocatable", "uncited", "unrechecked", "taxonomy", "ok")


def guard(v: DataFrame, mode: str = "block", refusal: str = "") -> DataFrame:
    """``v`` with what ships: in ``block`` mode a failing answer becomes the refusal; the other modes let it through."""
    if mode not in GUARD:
        raise ValueError(f"{mode!r} is not one of {GUARD}")
    blocked = ~F.col("ok") if mode == "block" else F.lit(False)
    return v.withColumn("blocked", blocked).withColumn("shipped", F.when(F.col("blocked"), F.lit(refusal)).otherwise(F.col("answer")))


def guard_report(g: DataFrame) -> DataFrame:
    """One row of tallies over all answers."""
    total = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    of = lambda f: total(F.size(F.filter("numbers", f)))
    r = g.agg(
        F.count(F.lit(1)).alias("answers"), total(F.col("ok")).alias("verified"), total(F.col("blocked")).alias("blocked"),
        of(lambda n: n["status"] != "context").alias("figures"), of(lambda n: n["status"] == "supported").alias("supported"), of(lambda n: n["how"] == "digits").alias("by_digits"),
        of(lambda n: n["status"] == "derived").alias("derived"), of(lambda n: n["status"] == "unsupported").alias("unsupported"),
        total(F.size("made")).alias("citations"), total(F.size("dangling")).alias("dangling"), total(F.size("unlocatable")).alias("unlocatable"), total(F.size("uncited")).alias("uncited"),
    )
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return r.withColumn("hallucination_rate", share(F.col("unsupported"), F.col("figures"))).withColumn("locator_rate", share(F.col("citations"), F.col("citations") + F.col("dangling") + F.col("unlocatable")))


def taxonomy_counts(v: DataFrame) -> DataFrame:
    return v.select(F.explode("taxonomy").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def decompose(answers: DataFrame, numbers: DataFrame) -> DataFrame:
    """qid, sentence number, sentence, text, status: each checked figure at the sentence that states it, repeats in order."""
    s = answers.select("qid", F.posexplode(T.sentences(F.col("answer"))).alias("sno", "sentence"))
    f = s.select("qid", "sno", "sentence", F.posexplode(F.transform(N.readings(T.strip_citations(F.col("sentence"))), lambda r: r["text"])).alias("fno", "text"))
    from pyspark.sql import Window

    f = f.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "text").orderBy("sno", "fno")))
    n = numbers.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "text").orderBy("pos"))).select("qid", "text", "nth", "status", "how")
    return f.join(n, ["qid", "text", "nth"], "left").select("qid", "sno", "sentence", "text", "status", "how")


def mutations(answers: DataFrame) -> DataFrame:
    """Wrong versions of answers for a negative control: a figure changed, citations dangling, citations gone, a figure added."""
    a = F.col("answer")
    changed = F.regexp_replace(a, r"(?<![\w.,])(\d)(?=[\d,]*\d)", "9$1")
    rows = [("figure_changed", changed), ("dangling", F.regexp_replace(a, r"\[\d+\]", "[99]")), ("uncited", F.regexp_replace(a, r"\s*\[\d+\]", "")), ("figure_added", F.concat(a, F.lit(" It also reported 987,654,321 in total [1].")))]
    every = F.array(*[F.struct(F.lit(name).alias("mutation"), x.alias("text")) for name, x in rows])
    out = answers.withColumn("_m", F.explode(F.filter(every, lambda m: m["text"] != a)))
    return out.withColumn("answer", F.col("_m.text")).withColumn("mutation", F.col("_m.mutation")).drop("_m")
