"""An index of the numbers that stand in a text, so that figures are looked up instead of searched by a pattern each.

A figure may be written in some ten ways (see text.value_variants). Every number of a text has the keys
under which those ways find it: the number up to each of its points and commas, since "1,234" also stands
in "1,234.50", the number with a million sign at it, and, for numbers of one or two digits, a key of their own that
says that a million word follows. A figure stands in a text if one of its keys is among the text's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

# A number of its own, and the million sign right behind it.
RUN = r"(?i)(?<![0-9.,])[0-9][0-9.,]*(?:m(?![0-9]))?"
SMALL = r"(?i)(?<![0-9.,])([0-9]{1,2}) ?(?:m|mn|million)\b"
#: Stands for a million word after a number of one or two digits.
SCALED = "~"
#: Parts that the longest spelling of a figure has: seven groups of digits and a fraction, and one more.
MOST_PARTS = 9
JOURNAL = r"(?i)^\s*(?:debit|credit|dr\b|cr\b)\b"


def number_keys(text: Column) -> Column:
    """Distinct keys of all numbers of a text; numbers of one or two digits only with a million word or sign."""

    def of(run: Column) -> Column:
        number = F.regexp_replace(run, "[mM]$", "")
        signed = F.when((number != run) & F.rlike(number, F.lit("[0-9]$")), F.array(F.concat(number, F.lit("m")))).otherwise(F.array().cast("array<string>"))
        up_to = X.let(F.slice(F.regexp_extract_all(number, F.lit("[.,]*[0-9]+"), F.lit(0)), 1, MOST_PARTS), lambda parts: F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "")))
        return F.concat(up_to, signed)

    plain = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), of))
    plain = F.filter(plain, lambda k: (F.length(k) > 2) | F.endswith(k, F.lit("m")))
    small = F.transform(F.regexp_extract_all(text, F.lit(SMALL), F.lit(1)), lambda d: F.concat(d, F.lit(SCALED)))
    return F.array_distinct(F.concat(plain, small))


def figure_keys(value: Column) -> Column:
    """The keys under which a figure is found."""
    return F.transform(X.value_variants(value), lambda v: F.when(F.length(v).between(1, 2) & ~F.endswith(v, F.lit("m")), F.concat(v, F.lit(SCALED))).otherwise(v))


def stands_in(value: Column, keys: Column) -> Column:
    """Whether a figure stands in the text whose keys these are; null for a null figure or text."""
    return F.when(value.isNotNull(), F.arrays_overlap(figure_keys(value), keys))


def value_in_text(value: Column, text: Column) -> Column:
    """Whether a figure stands in a text as a number of its own, in any spelling; one or two bare digits need a million word."""
    return stands_in(value, number_keys(text))


def line_index(text: Column, only: str = "") -> Column:
    """The lines of a text (that match ``only``) with the keys of their numbers: array of (line, keys); those without a number are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(only)))
    rows = F.transform(lines, lambda x: F.struct(F.trim(x).alias("line"), number_keys(x).alias("keys")))
    return F.filter(rows, lambda r: F.size(r["keys"]) > 0)


def working_index(text: Column) -> Column:
    """``line_index`` without the lines of journals."""
    return F.filter(line_index(text), lambda r: ~F.rlike(r["line"], F.lit(JOURNAL)))


def first_line(value: Column, index: Column) -> Column:
    """The first line of an index that states the value; null without one."""
    found = X.let(figure_keys(value), lambda keys: F.get(F.filter(index, lambda r: F.arrays_overlap(keys, r["keys"])), 0)["line"])
    return F.when(value.isNotNull(), found)


def number_index(scripts: DataFrame) -> DataFrame:
    """(submission_id, key, line_no) of all scripts (submission_id, text): the inverted index that joins look figures up in."""
    lines = scripts.select("submission_id", F.posexplode(F.split("text", "\n")).alias("line_no", "_line"))
    return lines.select("submission_id", F.explode(number_keys(F.col("_line"))).alias("key"), "line_no")
