"""Text and number column functions: normalisers, spellings, tokens, sections, predicates.

All are built-in expressions, so they stay inside generated code and push down with their query.
Nulls give null unless a docstring says otherwise.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, commentary phrases, labels that are no criteria, heading words, short criteria.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "for", "on", "at", "by", "as", "is", "are",
    "was", "were", "be", "been", "being", "with", "that", "this", "it", "its", "from", "into",
    "will", "would", "should", "can", "could", "may", "might", "there", "therefore",
]
COMMENTARY = ["tutorial note", "proof of adjustment", "appears to have been correctly dealt with", "alternative assumption"]
NO_CRITERIA = ["handwritten annotation", "annotation", "hr", "told - land.", "told - land", "tutor note", "tutorial note", "marking guide", "mark scheme", "scenario", "memorandum", "memo"]
HEADING_WORDS = ["revised", "consolidated", "statement", "changes", "equity", "prepare", "calculate", "determine", "explain"]
SHORT_CRITERIA = [
    "goodwill", "reserves", "depreciation", "impairment", "revaluation", "nci", "oci", "eps", "investment", "associate", "subsidiary",
    "sale proceeds", "fair value", "net assets", "share capital", "share premium", "retained earnings", "exchange gain", "revaluation gain", "revaluation loss",
]
NBSP, TIMES, EN_DASH, EM_DASH = " ", "×", "–", "—"


def let(value: Column, body) -> Column:
    """``body`` of a value computed once: a plain expression inside a lambda is computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def evidence_norm(text: Column) -> Column:
    """Lower case with spaces folded; every character but ``a-z 0-9 % / ( ) . , -`` is a space."""
    folded = F.translate(text, NBSP + TIMES + EN_DASH, " x-")
    kept = F.regexp_replace(F.lower(folded), r"[^a-z0-9%/().,\- ]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def clean_text(text: Column) -> Column:
    """Control characters out, three or more spaces two, three or more newlines two, line ends and ends trimmed."""
    x = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    x = F.regexp_replace(x, " {3,}", "  ")
    x = F.regexp_replace(x, "[ \t]+\n", "\n")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def symbol_norm(text: Column) -> Column:
    """Spellings of one figure made equal: currency and brackets off, dashes one, million as m, digit groups joined."""
    x = F.lower(F.translate(text, NBSP + EN_DASH + EM_DASH + "−", " ---"))
    x = F.regexp_replace(x, r"[£$€]|\bgbp\b|\busd\b", "")
    x = F.regexp_replace(x, r"\(([0-9][0-9.,]*)\)", "-$1")
    x = F.regexp_replace(x, r"([0-9]) ?(?:million|mn)\b", "$1m")
    x = F.regexp_replace(x, r"([0-9])[, ](?=[0-9]{3}(?:[^0-9]|$))", "$1")
    x = F.regexp_replace(x, r"[(),;:]", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\n]+", " "))


def line_norm(text: Column) -> Column:
    """White space, commas, semicolons and pipes dropped."""
    return F.regexp_replace(text, r"[ \t\n\r,;|]+", "")


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case runs of ASCII letters and digits with at least ``least`` characters, stop words out, in order."""
    # One pattern, as functions over arrays are not compiled: at the start of a run, no whole stop word.
    stop = "|".join(w for w in STOP_WORDS if len(w) >= least)
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9])(?!(?:{stop})(?![a-z0-9]))[a-z0-9]{{{max(least, 1)},}}"), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts between sentence ends followed by white space, and lines; blank ones out."""
    parts = F.transform(F.split(text, r"(?<=[.!?])[ \t\n\r]+|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def numbers(text: Column) -> Column:
    """Numbers as written, without their commas."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda n: F.regexp_replace(n, ",", ""))


def salient_numbers(text: Column) -> Column:
    """Distinct numbers of two digits or more."""
    return F.array_distinct(F.filter(numbers(text), lambda n: F.length(F.regexp_replace(n, "[^0-9]", "")) >= 2))


def grouped(n: Column) -> Column:
    """A whole number with thousands commas."""
    return F.format_number(n.cast("long"), 0)


def short(n: Column) -> Column:
    """A number without trailing zeros, as ``%g`` writes small ones."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", n.cast("double")), "0+$", ""), r"\.$", "")


def value_variants(value: Column) -> Column:
    """Spellings of a figure stated in thousands or in full."""
    v = F.abs(F.floor(value.cast("double"))).cast("long")
    base = F.array(v.cast("string"), grouped(v))
    thousand = v * 1000
    million = short(v / 1000.0)
    up = F.when((v > 0) & (v < 10_000_000), F.array(thousand.cast("string"), grouped(thousand), F.concat(grouped(thousand), F.lit(".00")), F.concat(thousand.cast("string"), F.lit(".00")), million, F.concat(million, F.lit("m")))).otherwise(F.array().cast("array<string>"))
    whole = (v / 1000).cast("long")
    down = F.when((v >= 1000) & (v % 1000 == 0), F.array(whole.cast("string"), grouped(whole), F.concat(whole.cast("string"), F.lit("m")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(base, up, down))


def variant_in_text(variant: Column, text: Column) -> Column:
    """Whether one spelling stands in the text as a number of its own; one or two bare digits need a million word. Figures are
    looked up in all their spellings by numbers.value_in_text."""
    literal = F.regexp_replace(variant, r"([.])", r"\\$1")
    plain = F.concat(F.lit(r"(?i)(?<![0-9.,])"), literal, F.lit(r"(?![0-9])"))
    small = F.concat(F.lit(r"(?i)(?<![0-9.,])"), literal, F.lit(r" ?(?:m|mn|million)\b"))
    return F.when(variant.rlike("^[0-9]{1,2}$"), F.rlike(text, small)).otherwise(F.rlike(text, plain))


def is_deduction(value: Column, text: Column) -> Column:
    """Whether the text writes the figure in brackets or after less, deduct or minus."""
    def written(v: Column) -> Column:
        v = F.regexp_replace(v, r"([.])", r"\\$1")
        return F.rlike(text, F.concat(F.lit(r"(?i)\([£$€]? ?"), v, F.lit(r"(?:m|k)?\)|\b(?:less|deduct|minus)\b[^0-9\n]{0,40}[£$€]?"), v, F.lit("(?![0-9])")))

    return F.exists(value_variants(value), written)


def number_token(token: Column) -> Column:
    """Value of a number with currency, commas, fraction, percent, pence or scale word; null if it is none."""
    t = F.regexp_replace(F.lower(F.trim(token)), r"[£$€, ]|gbp|usd", "")
    number = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")
    fraction = F.regexp_extract(t, r"^([0-9]+)/[0-9]+$", 1).try_cast("double") / F.nullif(F.regexp_extract(t, r"^[0-9]+/([0-9]+)$", 1).try_cast("double"), F.lit(0.0))
    unit = F.regexp_extract(t, r"^[0-9]*\.?[0-9]+([a-z%]*)$", 1)
    return (
        F.when(t.rlike(r"^[0-9]+/[0-9]+$"), fraction)
        .when(~t.rlike(r"^[0-9]*\.?[0-9]+[a-z%]*$"), None)
        .when(unit == "", number)
        .when(unit.isin("m", "mn", "million"), number * 1_000_000)
        .when(unit.isin("k", "thousand"), number * 1000)
        .when(unit.isin("p", "%"), number / 100)
    )


def marks_value(marks: Column) -> Column:
    """Marks as a number: plain, "1/2", "3 1/2", or a leading fraction; null for other text."""
    t = F.trim(marks)
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("double")
    mixed, fraction = r"^([0-9]+) +([0-9]+)/([0-9]+)", r"^([0-9]+)/([0-9]+)"
    return (
        F.when(t.rlike(mixed), part(mixed, 1) + part(mixed, 2) / F.nullif(part(mixed, 3), F.lit(0.0)))
        .when(t.rlike(fraction), part(fraction, 1) / F.nullif(part(fraction, 2), F.lit(0.0)))
        .otherwise(t.try_cast("double"))
    )


def marks_text(x: Column, places: int = 2) -> Column:
    """Marks without trailing zeros, half to even."""
    return F.regexp_replace(F.format_string(f"%.{places}f", F.bround(x.cast("double"), places)), r"\.?0+$", "")


def page_list(text: Column) -> Column:
    """Pages of "1-3, 5": inclusive ranges, order and repeats kept, invalid parts left out."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: p.rlike(r"^[0-9]{1,6}( *- *[0-9]{1,6})?$"))

    def pages(p: Column) -> Column:
        a = F.regexp_extract(p, "^([0-9]+)", 1).cast("int")
        b = F.regexp_extract(p, "([0-9]+)$", 1).cast("int")
        return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(good, pages))


def title_number(title: Column) -> Column:
    """Question number that a title starts with, decimals allowed; empty if there is none."""
    return F.regexp_extract(F.trim(title), r"(?i)^(?:question *|q\.? *)?([0-9]+(?:\.[0-9]+)?)(?![0-9])", 1)


def digit_share(text: Column) -> Column:
    """Digits among the characters that are not white space; 0 for none."""
    solid = F.length(F.regexp_replace(text, r"[ \t\n\r]", ""))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return F.when(solid > 0, digits / solid).otherwise(F.lit(0.0))


def is_prose(text: Column, most: float = 0.35) -> Column:
    return digit_share(text) <= most


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""

    def runs(w: Column) -> Column:
        count = F.size(w) - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def header_candidates(header: Column) -> Column:
    """Word runs of a column header, longest first; a single word needs three letters, a run three characters."""
    words = F.filter(F.split(F.trim(header), r"[ \t\n]+"), lambda w: w != "")
    def runs(n: Column) -> Column:
        count = F.size(words) - n + 1
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))

    every = F.flatten(F.transform(F.sequence(F.greatest(F.size(words), F.lit(1)), F.lit(1)), runs))
    return F.array_distinct(F.filter(every, lambda g: (F.length(g) >= 3) & (g.contains(" ") | g.rlike("[A-Za-z]{3}"))))


def candidate_fragments(text: Column, most: int = 4) -> Column:
    """Parts between newlines, semicolons and pipes of at least six characters, longest first; the text itself if there is none."""
    parts = F.filter(F.transform(F.split(text, r"[\n;|]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 6)
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("l"), i.alias("i"), p.alias("p"))))
    found = F.slice(F.array_distinct(F.transform(ranked, lambda x: x["p"])), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(text)))


def evidence_list(text: Column) -> Column:
    """Evidence split at newlines and semicolons, never at pipes, so table rows stay whole."""
    return F.filter(F.transform(F.split(text, r"[\n;]"), lambda p: F.trim(p)), lambda p: p != "")


def row_variants(row: Column) -> Column:
    """A table row as "label last", as its cells joined, and as written."""
    cells = F.filter(F.transform(F.split(row, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    last = F.element_at(cells, -1)
    short_form = F.when((F.size(cells) > 1) & last.rlike("[0-9]"), F.array(F.concat_ws(" ", F.element_at(cells, 1), last))).otherwise(F.array().cast("array<string>"))
    return F.when(row.contains("|") & (F.size(cells) > 0), F.array_distinct(F.concat(short_form, F.array(F.array_join(cells, " "), row)))).otherwise(F.array(row))


def is_informative(anchor: Column) -> Column:
    """An anchor worth searching: six characters, not a bare year, and a digit, ratio or two tokens."""
    t = F.trim(anchor)
    return (F.length(t) >= 6) & ~t.rlike("^(19|20)[0-9]{2}$") & (t.rlike("[0-9]") | t.contains(":") | (F.size(tokens(t)) >= 2))


def is_heading_line(line: Column) -> Column:
    """Short, without figures, and closed by a colon or all capitals or numbered."""
    t = F.trim(line)
    words = F.size(F.filter(F.split(t, " +"), lambda w: w != ""))
    return (words <= 8) & (t.rlike(":$") | t.rlike(r"^[A-Z][A-Z &/-]+$") | t.rlike(r"^(?:\(?[a-z0-9]{1,3}[.)]) [A-Z]")) & ~t.rlike("[0-9]{3}")


def is_valid_criterion(text: Column) -> Column:
    """Whether a rubric line states something that can be marked; null and blank lines do not."""
    split = lambda x: F.filter(F.split(x, r"[ \t\n]+"), lambda w: w != "")

    def valid(t: Column, bare: Column, words: Column, rest: Column) -> Column:
        journal = F.get(rest, 0).isin("dr", "cr")
        figure = bare.rlike("[0-9]")
        notation = t.rlike(r"^[0-9]+ */ *[0-9]+( *(mk|marks?).*)?$|^[0-9]+ +[0-9]+/[0-9]+ *$")
        numbered = (bare != t) & (F.size(rest) <= 5) & ~figure & ~F.coalesce(journal, F.lit(False))
        topic = (F.size(rest) <= 4) & ~figure & ~F.coalesce(journal, F.lit(False)) & F.arrays_overlap(rest, F.array(*map(F.lit, HEADING_WORDS)))
        line_item = (F.size(words) >= 3) | ((F.size(words) >= 2) & F.get(words, 0).isin("dr", "cr")) | t.rlike(r"[0-9()]|gbp|usd|eur|percent") | t.isin(SHORT_CRITERIA)
        return F.coalesce((t != "") & ~notation & ~t.isin(NO_CRITERIA) & ~numbered & ~topic & line_item, F.lit(False))

    # Each of these is used several times, and would be made again for each use.
    low = F.struct(F.lower(F.trim(text)).alias("t"), F.regexp_replace(F.lower(F.trim(text)), r"^\([0-9]+\)[ \t]*|^[0-9]+[.)][ \t]*", "").alias("bare"))
    parts = lambda x: F.struct(x["t"].alias("t"), x["bare"].alias("bare"), split(x["t"]).alias("words"), split(x["bare"]).alias("rest"))
    return let(low, lambda x: let(parts(x), lambda y: valid(y["t"], y["bare"], y["words"], y["rest"])))


def has_commentary(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for phrase in COMMENTARY:
        out = out | low.contains(phrase)
    return out


def error_class(message: Column) -> Column:
    """Kind of an error by its text, the first that fits: quota, rate, auth, network, file, database, else unexpected."""
    low = F.lower(message)
    # The phrases that tell the kinds.
    return (
        F.when(low.contains("insufficient_quota") | (low.contains("429") & low.contains("quota")), "quota")
        .when(low.rlike("429|rate_limit|rate limit"), "rate")
        .when(low.rlike("401|invalid_api_key|authentication"), "auth")
        .when(low.rlike("timeout|timed out|connection|network|ssl"), "network")
        .when(low.rlike("no pages rendered|no such file|filenotfounderror"), "file")
        .when(low.contains("mongo"), "database")
        .otherwise("unexpected")
    )


def comment_parts(comment: Column) -> Column:
    """Struct (anchor, note) of "anchor -> note" with a sub-question prefix like [4.1] off; no arrow, no anchor."""
    c = F.regexp_replace(comment, r"^\[[0-9.]+(?:\([a-z]\))?\] *", "")
    has = c.rlike(r"(?:→|->)")
    return F.struct(F.when(has, F.trim(F.regexp_extract(c, r"^(.*?) *(?:→|->)", 1))).alias("anchor"), F.when(has, F.trim(F.regexp_extract(c, r"(?s)(?:→|->) *(.*)$", 1))).otherwise(F.trim(c)).alias("note"))


def is_annotation(comment: Column) -> Column:
    """One line with an arrow and at least two full stops after it."""
    after = F.regexp_extract(comment, r"(?:→|->)(.*)$", 1)
    return comment.rlike("→|->") & ~comment.contains("\n") & (F.length(F.regexp_replace(after, "[^.]", "")) >= 2)


def html_text(html: Column) -> Column:
    """Visible text of a page: comments, scripts, styles and tags out, white space single."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def isolate_json(text: Column) -> Column:
    """The part from the first bracket to the last one of its kind, code fences and byte-order mark off."""
    return F.regexp_extract(F.regexp_replace(text, "﻿|```(?:json)?", ""), r"(?s)(\{.*\}|\[.*\])", 1)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_.-]+", "_")


def quarter(marks: Column) -> Column:
    """Marks in quarters, half to even."""
    return F.bround(marks / 0.25, 0) * 0.25


def half(marks: Column) -> Column:
    """Marks in halves, half to even."""
    return F.bround(marks / 0.5, 0) * 0.5


def half_up(marks: Column) -> Column:
    """Marks in halves, half upwards, as totals are rounded."""
    return F.floor(marks * 2 + 0.5) / 2




def same_question(a: Column, b: Column) -> Column:
    """Whether two question labels agree: their digits are equal or one's start the other's; a missing side agrees."""
    x, y = (F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "") for c in (a, b))
    return (x == "") | (y == "") | F.startswith(x, y) | F.startswith(y, x)


def inline_sections(text: Column) -> Column:
    """Sections of "Title (3 Marks)" lines: array of (title, marks, body); empty without such a line."""
    parts = F.split(text, r"\n(?=[^\n]{1,120}\([0-9]+(?:\.[0-9]+)? ?(?i:marks?|mks?)\))")
    head = r"^([^\n]*?) *\(([0-9]+(?:\.[0-9]+)?) ?(?i:marks?|mks?)\)[^\n]*"
    titled = F.filter(parts, lambda p: p.rlike(head))
    return F.transform(titled, lambda p: F.struct(F.trim(F.regexp_extract(p, head, 1)).alias("title"), F.regexp_extract(p, head, 2).try_cast("double").alias("marks"), F.regexp_replace(F.regexp_replace(p, head, ""), r"^[ \t\n]+|[ \t\n]+$", "").alias("body")))


def sections(text: Column) -> Column:
    """Parts of a script between "--- label ---" lines: array of (label, body); the part before the first header has the
    label "" and is left out if it is empty; no headers, no parts."""
    header = r"(?m)^[ \t]*-{3,}[ \t]*([^\n]*?[^ \t\n])[ \t]*-{3,}[ \t]*$"
    labels = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(header), F.lit(1)))
    # The line ends around a header belong to it; the last part has none behind it.
    inner = lambda b, i, n: F.regexp_replace(F.when(i < n - 1, F.regexp_replace(b, r"\n\z", "")).otherwise(b), F.when(i == 0, F.lit(r"\z.")).otherwise(F.lit(r"\A\n")), F.lit(""))
    bodies = let(F.split(text, header, -1), lambda bs: F.transform(bs, lambda b, i: inner(b, i, F.size(bs))))
    every = F.zip_with(labels, bodies, lambda a, b: F.struct(a.alias("label"), F.coalesce(b, F.lit("")).alias("body")))
    return F.when(F.size(labels) > 1, F.filter(every, lambda s, i: (i > 0) | (s["body"] != ""))).when(text.isNotNull(), F.array().cast("array<struct<label:string,body:string>>"))


def section_of(evidence: Column, bodies: Column) -> Column:
    """Index of the one body that holds the evidence, white space, commas, semicolons and pipes ignored; null if none or
    several do, or if it has under eight such characters. ``bodies``: array of normalised texts (see line_norm, lower case)."""
    needle = F.lower(line_norm(evidence))
    hits = F.filter(F.transform(bodies, lambda b, i: F.when(F.contains(b, needle), i)), lambda i: i.isNotNull())
    return F.when((F.length(needle) >= 8) & (F.size(hits) == 1), F.get(hits, 0))


def body_points(body: Column) -> Column:
    """Points of a section body: bullets and blank lines part it, parts over 150 characters part at sentences; ten characters at least."""
    blocks = F.split(body, r"\n[ \t]*\n|\n[ \t]*(?:[-*•–]|[0-9]{1,2}[.)]|\([a-z0-9]{1,3}\))[ \t]+")
    first = F.transform(blocks, lambda b: F.regexp_replace(F.trim(F.regexp_replace(b, r"[ \t\n]+", " ")), r"^(?:[-*•–]|[0-9]{1,2}[.)]|\([a-z0-9]{1,3}\)) +", ""))
    cut = F.flatten(F.transform(first, lambda b: F.when(F.length(b) > 150, sentences(b)).otherwise(F.array(b))))
    return F.filter(cut, lambda p: F.length(p) >= 10)


def _spellings(first: Column, rules: list[tuple[str, str]]) -> Column:
    every = F.array(first, *(F.regexp_replace(first, a, b) for a, b in rules))
    kept = F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: v != "")
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))))


def anchor_variations(anchor: Column) -> Column:
    """Spellings to search an anchor under: percent, currencies, dashes, times, divided by and units; distinct, case ignored."""
    return _spellings(anchor, [
        (r" ?%", " percent"), (r"(?i) ?per ?cent\b", "%"), (r"(?i)\bGBP ?", "£"), ("£", "GBP "), (r"(?i)\bUSD ?", "\\$"), (r"\$", "USD "), ("[£$€]", ""),
        ("[–—−]", "-"), ("-", "–"), (r" ?[xX×] ?", " x "), (r" ?[xX*] ?", " × "), ("÷", "/"), ("/", " ÷ "), (r"(?i)([0-9]) ?million\b", "$1m"), (r"(?i)([0-9])m\b", "$1 million"), (r"(?i)([0-9])k\b", "$1,000"),
    ])


def number_variations(number: Column) -> Column:
    """A figure with and without groups, spaces, cents and fraction spaces."""
    plain = F.regexp_replace(number, "[, ]", "")
    whole = F.regexp_replace(plain, r"\.00$", "").try_cast("long")
    made = F.when(whole.isNotNull(), F.array(whole.cast("string"), grouped(whole), F.translate(grouped(whole), ",", " "), F.concat(grouped(whole), F.lit(".00")))).otherwise(F.array().cast("array<string>"))
    fraction = F.when(number.contains("/"), F.array(F.regexp_replace(number, " */ *", "/"), F.regexp_replace(number, " */ *", " / "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.trim(number)), made, fraction))


def context_words(text: Column, most: int = 6) -> Column:
    """First distinct tokens of a text that are no figures."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda w: ~w.rlike("^[0-9]+$"))), 1, most)


def grounded_anchor(anchor: Column, text: Column) -> Column:
    """An anchor that stands in the text (white space and case folded): itself if it has five words at most, else its
    first run of five, four or three words that does; failing that the first five, four or three words that do; else its first four words."""
    fold = lambda c: F.lower(F.regexp_replace(F.trim(c), r"[ \t\n\r]+", " "))

    def pick(words: Column) -> Column:
        def choose(body: Column) -> Column:
            fits = lambda n: F.get(F.filter(ngrams(words, n), lambda g: F.contains(body, F.lower(g))), 0)
            whole = F.array_join(words, " ")
            short_enough = F.when((F.size(words) <= 5) & F.contains(body, F.lower(whole)), whole)
            return F.coalesce(short_enough, fits(5), fits(4), fits(3), F.array_join(F.slice(words, 1, 4), " "))

        return let(fold(text), choose)

    return let(F.filter(F.split(F.trim(anchor), r"[ \t\n\r]+"), lambda w: w != ""), pick)


def question_max_marks(document: Column, matched: Column, leaf_sum: Column, marks: Column, judged: Column, all_questions: Column) -> Column:
    """A question's maximum: stated in the text ("maximum marks: N"), of the matched question, of its leaves, of its own
    keys, a closing "(N)", the judge's total, the sum of all questions; the first that is positive."""
    stated = F.regexp_extract(document, r"(?i)(?:maximum|total|available)[ _]marks?[ :=]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    closing = F.regexp_extract(document, r"\(([0-9]+(?:\.[0-9]+)?)(?: ?(?i:marks?))?\)[ \t\n.]*$", 1).try_cast("double")
    positive = lambda c: F.when(c.cast("double") > 0, c.cast("double"))
    return F.coalesce(*map(positive, (stated, matched, leaf_sum, marks, closing, judged, all_questions)))


def tool_arguments(message: Column) -> Column:
    """The arguments of a message's first tool call, in either layout; null without one."""
    return F.coalesce(F.get_json_object(message, "$.tool_calls[0].function.arguments"), F.get_json_object(message, "$.tool_calls[0].args"), F.get_json_object(message, "$.additional_kwargs.tool_calls[0].function.arguments"))
