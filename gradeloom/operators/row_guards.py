"""Row guards: each takes judged rows and returns them with marks taken back, given or kept.

Rows: submission_id, item_pos, criterion, category, exact_match, marks_awarded, max_possible, reason,
evidence (array), and ``text`` (the script), ``reference`` (question and rubric text) and ``journal_lines``
(the script's lines with Dr or Cr and the keys of their numbers) joined by ``submission_id`` once before the chain. All guards are projections, so a chain of them is one stage.
Each guard that changes marks appends (guard, delta, reason) to ``audit``. Nulls: marks and maxima
count as 0, evidence as empty, texts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arithmetic
from ..functions import criteria as C
from ..functions import numbers as N
from ..functions import text as X

# Fixed value: the sides of a journal.
SIDE = r"(?i)\b(?:dr|cr)\b"
AUDIT = "array<struct<guard:string,delta:double,reason:string>>"


def prepare(judged: DataFrame, scripts: DataFrame) -> DataFrame:
    """Judged rows with their script's text and reference, defaults in place and an empty audit."""
    j = judged.withColumns({
        "marks_awarded": F.coalesce(F.col("marks_awarded").cast("double"), F.lit(0.0)),
        "max_possible": F.coalesce(F.col("max_possible").cast("double"), F.lit(0.0)),
        "evidence": F.coalesce("evidence", F.array().cast("array<string>")),
        "reason": F.coalesce("reason", F.lit("")),
        "category": F.lower(F.coalesce("category", F.lit(""))),
        "exact_match": F.coalesce("exact_match", F.lit(False)),
        "audit": F.array().cast(AUDIT),
    })
    text = F.coalesce("text", F.lit(""))
    # The journal lines of a script are indexed once, not for each of its rows.
    s = scripts.select("submission_id", text.alias("text"), F.coalesce("reference", F.lit("")).alias("reference"), N.line_index(text, SIDE).alias("journal_lines"))
    return j.join(s, "submission_id", "left").fillna("", ["text", "reference"])


def _set(df: DataFrame, guard: str, marks: Column, why: str | Column, note: bool = True) -> DataFrame:
    """New marks where they differ, with an audit entry and, if ``note``, the reason in front of the row's own."""
    df = df.withColumn("_new", F.coalesce(marks, F.col("marks_awarded")))
    changed = F.col("_new") != F.col("marks_awarded")
    why = F.lit(why) if isinstance(why, str) else why
    entry = F.array(F.struct(F.lit(guard).alias("guard"), (F.col("_new") - F.col("marks_awarded")).alias("delta"), why.alias("reason")))
    out = {"audit": F.when(changed, F.concat("audit", entry)).otherwise(F.col("audit")), "marks_awarded": F.col("_new")}
    if note:
        out["reason"] = F.when(changed, F.trim(F.concat(why, F.lit(" "), F.col("reason")))).otherwise(F.col("reason"))
    return df.withColumns(out).drop("_new")


def _zero_if(df: DataFrame, guard: str, fires: Column, why: str | Column) -> DataFrame:
    return _set(df, guard, F.when((F.col("marks_awarded") > 0) & F.coalesce(fires, F.lit(False)), 0.0).otherwise(F.col("marks_awarded")), why)


def clamp(df: DataFrame) -> DataFrame:
    """between 0 and the maximum, in quarters, half to even."""
    return _set(df, "F5", X.quarter(F.greatest(F.least("marks_awarded", "max_possible"), F.lit(0.0))), "Marks brought into range.", note=False)


def missing_evidence(df: DataFrame) -> DataFrame:
    """marks without evidence go."""
    return _zero_if(df, "F6", F.size("evidence") == 0, "Marks revoked (no evidence).")


def is_searchable(norm: Column) -> Column:
    """Evidence long or distinctive enough to be looked for: 12 characters, or a figure, ratio, or long word."""
    words = F.filter(F.split(norm, " "), lambda w: w != "")
    figure = norm.rlike("[0-9]") & (F.length(norm) >= 4)
    ratio = norm.rlike("[/%]") & (F.length(norm) >= 3)
    word = (F.size(words) <= 3) & F.exists(words, lambda w: F.length(w) >= 7)
    return (F.length(norm) >= 12) | figure | ratio | word


def is_present(norm: Column, text_norm: Column) -> Column:
    """In the text as a whole, or one of its first ten-word (8) or five-word (6) runs of longer words is."""
    words = F.filter(F.split(norm, " "), lambda w: F.length(w) >= 3)
    found = lambda n, most: F.exists(F.slice(X.ngrams(words, n), 1, most), lambda g: F.contains(text_norm, g))
    return F.contains(text_norm, norm) | found(10, 8) | found(5, 6)


def evidence_presence(df: DataFrame) -> DataFrame:
    """some searchable piece of evidence must stand in the script."""
    return _zero_if(df, "F7", ~in_script(), "Marks revoked (evidence not found in the script).")


def taint(df: DataFrame) -> DataFrame:
    """F8: evidence that also stands in the question or rubric does not count, unless it holds figures or hardly any words."""
    def own(e: Column, reference: Column) -> Column:
        words = F.filter(F.split(e, " "), lambda w: F.length(w) >= 4)
        return ~F.contains(reference, e) | e.rlike(r"[0-9]{3}|[0-9]\.[0-9]{2}") | (F.size(words) < 2)

    fine = X.let(X.evidence_norm(F.col("reference")), lambda r: F.exists(F.transform("evidence", X.evidence_norm), lambda e: own(e, r)))
    return _zero_if(df, "F8", (F.col("reference") != "") & ~fine, "Marks revoked (evidence is copied from the question).")


# Words of income criteria and of evidence for them.
INCOME = r"(?i)\b(profit|contribution|revenue|income|earning)\b"
INCOME_EVIDENCE = r"(?i)\b(profits?|contribution|revenue|income|earnings?|loss|oci|exchange|reserve|comprehensive|nci|eps)\b|p[&/]l|\bpl\b|\bfx\b"


def income_context(df: DataFrame) -> DataFrame:
    """small criteria that name profit or income need evidence that does."""
    fires = ~F.col("category").isin("journal", "calculation", "calc", "narrative") & (F.col("max_possible") <= 1) & F.col("criterion").rlike(INCOME) & ~F.array_join("evidence", " ").rlike(INCOME_EVIDENCE)
    return _zero_if(df, "F9", fires, "Marks revoked (evidence lacks profit context).")


def alignment(df: DataFrame) -> DataFrame:
    """evidence of a long narrative criterion of less than a mark must bear on it (see criteria.aligned)."""
    fine = C.aligned(X.evidence_norm(F.col("criterion")), X.evidence_norm(F.array_join("evidence", " ")))
    return _zero_if(df, "F10", ~F.col("criterion").rlike("[£$]") & (F.col("max_possible") < 1) & ~fine, "Marks revoked (evidence does not bear on the criterion).")


# Words that do not say what is required.
NEGATION_STOP = [
    "required", "necessary", "must", "should", "would", "which", "this", "that", "also", "have", "been", "will", "need", "needs", "being",
    "review", "report", "audit", "before", "after",
]


# Spellings of "number of", words that require, words that deny.
NUMBER_OF, REQUIRES, DENIES = r"\bnos?\.?\s+of\b", r"\brequired\b|\bnecessary\b|\bmust\b", r"\b(?:no|not)\s+(?:\w+\s+){0,2}"


def negation(df: DataFrame) -> DataFrame:
    """a criterion that requires something is not met by evidence that denies it; "no of" means number of."""
    words = F.filter(F.regexp_extract_all(F.lower("criterion"), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(NEGATION_STOP))
    said = F.regexp_replace(F.lower(F.array_join("evidence", " ")), NUMBER_OF, "number of")
    denies = F.exists(F.slice(words, 1, 6), lambda w: F.rlike(said, F.concat(F.lit(DENIES), F.left(w, F.lit(7)))))
    return _zero_if(df, "F11", F.lower("criterion").rlike(REQUIRES) & denies, "Marks revoked (evidence contradicts the criterion).")


#: A calculation as it is written: figures with operators between them.
CALCULATION = r"\(?[0-9][0-9.,£$mkp% ]*(?:[x×*/+-] ?[0-9£$.,mkp%() ]+)+"
MOST_PIECES = 12


def in_script() -> Column:
    """Whether some searchable piece of the row's evidence stands in its script."""
    return X.let(X.evidence_norm(F.col("text")), lambda t: F.exists(F.transform("evidence", X.evidence_norm), lambda e: is_searchable(e) & is_present(e, t)))


def calculated(df: DataFrame) -> DataFrame:
    """full marks where a calculation works out to the amount a criterion states after GBP.

    F12: a row without marks whose own bracket, "(416,000 x GBP25)", works out to the stated amount gets them if any
    calculation of the script does; it becomes the first evidence. F13: a row with less than its maximum, some of whose evidence stands in the
    script, gets them if one of the first ``MOST_PIECES`` different calculations in its evidence does. A criterion about
    income takes only what speaks of it. Arithmetic runs in Arrow functions.
    """
    bracket, stated = arithmetic.bracket_value(F.col("criterion")), C.expected_amount(F.col("criterion"))
    near = F.abs(bracket - stated) <= F.greatest(F.lit(2.0), 1e-6 * F.greatest(F.abs(bracket), F.abs(stated)))
    found = lambda c: F.regexp_extract_all(c, F.lit(CALCULATION), F.lit(0))
    said = F.array_join("evidence", " ")
    key = lambda e: F.lower(F.regexp_replace(e, r"\s+", ""))
    first = F.aggregate(found(said), F.array().cast("array<string>"), lambda acc, e: F.when(F.exists(acc, lambda x: key(x) == key(e)), acc).otherwise(F.concat(acc, F.array(e))))
    income = F.col("criterion").rlike(INCOME)
    lost = (F.col("marks_awarded") == 0) & (F.col("max_possible") > 0) & F.coalesce(near, F.lit(False))
    short = (F.col("marks_awarded") < F.col("max_possible")) & stated.isNotNull() & (~income | said.rlike(INCOME)) & in_script()
    # Neither search needs what the other finds: a row that F12 credits has all its marks.
    df = df.withColumns({"_amount": stated, "_script": F.when(lost, F.array_distinct(found("text"))), "_said": F.when(short, F.slice(first, 1, MOST_PIECES))})
    df = df.withColumns({"_made": arithmetic.first_that_makes("_script", "_amount"), "_agrees": arithmetic.first_that_makes("_said", "_amount")})
    hit = F.col("_made").isNotNull() & (~income | F.concat_ws(" ", "evidence", "_made").rlike(INCOME))
    df = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    df = _set(df, "F12", F.when(F.col("_hit"), F.col("max_possible")).otherwise(F.col("marks_awarded")), "Full marks (calculation found in the script).")
    df = _set(df, "F13", F.when(F.col("_agrees").isNotNull(), F.col("max_possible")).otherwise(F.col("marks_awarded")), "Full marks (calculation agrees).")
    df = df.withColumn("evidence", F.when(F.col("_hit") & ~F.array_contains("evidence", F.col("_made")), F.concat(F.array("_made"), "evidence")).otherwise(F.col("evidence")))
    return df.drop("_amount", "_script", "_made", "_said", "_agrees", "_hit")


def strict_numbers(df: DataFrame) -> DataFrame:
    """full marks need every figure of the criterion in the evidence, or the result of its bracket, or a calculation that works out
    to it, unless the reason grants an own figure, or it rests on other figures, and the figure need not be exact."""
    figures = F.filter(X.numbers(F.regexp_replace("criterion", r"(?i)\b(?:19|20)[0-9]{2}\b", "")), lambda n: F.length(F.regexp_replace(n, "[^0-9]", "")) >= 2)
    said = F.array_join("evidence", " ")
    seen = F.struct(N.number_keys(said).alias("keys"), F.regexp_replace(said, "[, ]", "").alias("joined"))
    all_there = X.let(seen, lambda s: F.forall(figures, lambda n: N.stands_in(n.try_cast("double"), s["keys"]) | F.contains(s["joined"], n)))
    result = arithmetic.bracket_value(F.col("criterion"))
    derived = F.coalesce(F.exists(C.expected_spellings(result), lambda v: F.contains(F.lower(F.regexp_replace(said, "[, ]", "")), F.regexp_replace(v, " ", ""))), F.lit(False))
    rests = F.size(F.coalesce("of_source_ids", F.array().cast("array<string>"))) > 0 if "of_source_ids" in df.columns else F.lit(False)
    own = (F.col("reason").rlike(r"(?i)\bown.?figure\b|\bof\b") | rests) & ~F.col("exact_match")
    asked = (F.col("marks_awarded") > 0) & (F.col("marks_awarded") >= F.col("max_possible")) & result.isNotNull()
    df = df.withColumns({"_result": result, "_said": F.when(asked, F.regexp_extract_all(said, F.lit(CALCULATION), F.lit(0)))})
    df = df.withColumn("_made", arithmetic.first_that_makes("_said", "_result"))
    fires = (F.col("marks_awarded") >= F.col("max_possible")) & (F.size(figures) > 0) & ~own & ~all_there & ~derived & F.col("_made").isNull()
    return _zero_if(df, "F15", fires, "Marks revoked (figures not in the evidence).").drop("_result", "_said", "_made")


def journal_direction(df: DataFrame) -> DataFrame:
    """F16: a journal line must say Dr or Cr as the criterion does; full marks without its amount become half."""
    side = F.regexp_extract(F.lower("criterion"), r"^(dr|cr)\b", 1)
    said = F.lower(F.array_join("evidence", " "))
    df = _zero_if(df, "F16", (side != "") & ~F.when(side == "dr", said.rlike(r"\bdr\b|\bdebit")).otherwise(said.rlike(r"\bcr\b|\bcredit")), "Marks revoked (journal side missing).")
    figures = X.salient_numbers(F.col("criterion"))
    there = X.let(N.number_keys(said), lambda keys: F.exists(figures, lambda n: N.stands_in(n.try_cast("double"), keys)))
    lesser = F.greatest(F.lit(0.25), F.least(X.quarter(F.col("max_possible") / 2), F.col("max_possible") - 0.25))
    reduce = (side != "") & (F.size(figures) > 0) & (F.col("marks_awarded") >= F.col("max_possible")) & (F.col("max_possible") > 0.25) & ~there
    return _set(df, "F16", F.when(reduce, lesser).otherwise(F.col("marks_awarded")), "Own figure: journal amount differs.")


def journal_line(df: DataFrame) -> DataFrame:
    """full marks for a journal criterion whose side, a figure and a word stand in one line of the script."""
    side = F.regexp_extract(F.lower("criterion"), r"^(dr|cr)\b", 1)
    words = F.filter(X.tokens(F.col("criterion"), 4), lambda w: ~w.rlike("[0-9]"))
    figures = X.salient_numbers(F.col("criterion"))

    def fits(line: Column, keys: Column) -> Column:
        low = F.lower(line)
        return F.rlike(low, F.concat(F.lit(r"\b"), side, F.lit(r"\b"))) & F.exists(figures, lambda n: N.stands_in(n.try_cast("double"), keys)) & F.exists(words, lambda w: F.contains(low, w))

    due = (side != "") & (F.col("marks_awarded") == 0)
    df = df.withColumn("_line", F.when(due, F.get(F.filter("journal_lines", lambda r: fits(r["line"], r["keys"])), 0)["line"]))
    df = _set(df, "F17", F.when(F.col("_line").isNotNull(), F.col("max_possible")).otherwise(F.col("marks_awarded")), "Full marks (journal line found).")
    return df.withColumn("evidence", F.when(F.col("_line").isNotNull(), F.concat("evidence", F.array("_line"))).otherwise(F.col("evidence"))).drop("_line")


def own_figure_flag(df: DataFrame) -> DataFrame:
    """part marks of a calculation or journal are own-figure marks."""
    return df.withColumn("is_of_mark", (F.col("marks_awarded") > 0) & (F.col("marks_awarded") < F.col("max_possible")) & F.col("category").isin("calculation", "calc", "journal"))


def distinct_evidence(df: DataFrame) -> DataFrame:
    """evidence equal up to pipes and spaces once, the first spelling kept."""
    key = lambda e: F.lower(F.regexp_replace(e, r"[ \t|]+", ""))
    first = F.aggregate("evidence", F.array().cast("array<string>"), lambda acc, e: F.when(F.exists(acc, lambda x: key(x) == key(e)), acc).otherwise(F.concat(acc, F.array(e))))
    return df.withColumn("evidence", first)


CHAIN: list[Callable[[DataFrame], DataFrame]] = [
    clamp, missing_evidence, evidence_presence, taint, income_context, alignment, negation, calculated,
    strict_numbers, journal_direction, journal_line, own_figure_flag, distinct_evidence,
]


def apply(rows: DataFrame) -> DataFrame:
    """All row guards in their order, each seeing the marks the one before it left."""
    for guard in CHAIN:
        rows = rows.transform(guard)
    return rows


def partial_credit(df: DataFrame) -> DataFrame:
    """F14, not in the chain: half the maximum, in quarters, where evidence stands in the script but no marks were given."""
    return _set(df, "F14", F.when((F.col("marks_awarded") == 0) & in_script(), X.quarter(F.col("max_possible") / 2)).otherwise(F.col("marks_awarded")), "Partial credit.")


def displayed(df: DataFrame) -> DataFrame:
    """rows that are shown: those with marks, and those whose marks were given elsewhere."""
    return df.filter((F.col("marks_awarded") > 0) | F.coalesce(F.contains("reason", F.lit("Marks given above/below")), F.lit(False)))
