"""Column functions about criteria: expected amounts and spellings, focus words, groups, columns, keywords, working lines.

All are built-in expressions. Nulls give null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers as N
from . import text as X

# Words after which a criterion speaks of something else; words that say nothing about its focus.
HEAD_ENDS = ["DISAMBIGUATION", "CONTEXT", "TUTORIAL NOTE", "ACCEPT EITHER", "NOT A DUPLICATE", "AWARD ALSO", "TWO-METHOD NOTE", "ONE JOURNAL ENTRY", "NO FURTHER MARKS"]
FOCUS_STOP = ["the", "a", "an", "to", "of", "at", "in", "for", "and", "or", "on", "is", "as", "by", "its", "it", "this", "that", "mark", "marks", "row", "line"]
# Words of keywords that stand on almost any line.
KEYWORD_STOP = ["the", "and", "for", "with", "from", "that", "this", "less", "add", "total", "year", "value", "amount", "figure", "shares", "share"]
LEAST_KEYWORD = 4
# Names of statement columns.
COLUMNS = ["retained_earnings", "nci", "share_premium", "share_option_reserve", "other_components", "equity_share_capital", "total"]
# Words that mean the same in marking.
SYNONYMS = [
    ["exchange", "forex", "currency", "translation", "retranslation"],
    ["movement", "gain", "loss", "difference", "change"],
    ["charged", "debited", "expensed", "recognised", "recognized", "impact"],
    ["closing", "close", "closed", "yearend"],
    ["revaluation", "revalued", "remeasured", "remeasurement", "restated"],
    ["consolidation", "consolidated", "consolidate"],
    ["profit", "income", "earnings"],
    ["comprehensive", "reserve", "surplus"],
    ["cyclist", "rider", "employee", "staff", "member", "player", "worker"],
    ["associate", "equity", "accounted"],
]
# Words that do not align evidence with a criterion.
ALIGNMENT_STOP = [
    "the", "a", "an", "and", "or", "to", "of", "in", "for", "on", "at", "as", "is", "are", "was", "were", "be", "been", "being", "with", "from", "by", "this", "that", "these",
    "those", "should", "would", "will", "must", "therefore", "account", "accounts", "year", "statement", "financial", "reporting", "treatment",
]
# Phrases and words of headings.
HEADING_PHRASES = r"calculated as follows|is as follows|^revised consolidated statement|^the basic eps"
HEADING_KEYWORDS = r"calculated|as follows|accounting|treatment|journal|statement|revised|electrostatic"


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def expected_amount(criterion: Column) -> Column:
    """The first amount after GBP, "GBP2.6 million" or "GBP910,000", in full; null without one."""
    amount = r"(?i)\bgbp\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(million|m|thousand|k)?\b"
    scale = F.lower(F.regexp_extract(criterion, amount, 2))
    number = F.regexp_replace(F.regexp_extract(criterion, amount, 1), ",", "").try_cast("double")
    return number * F.when(scale.isin("million", "m"), 1e6).when(scale.isin("thousand", "k"), 1e3).otherwise(1.0)


def expected_spellings(value: Column) -> Column:
    """Spellings of an expected figure: whole, in millions or thousands where it is round, else with two and four decimals."""
    v = value.cast("double")
    n = F.round(v).cast("long")
    short = lambda x, form: F.regexp_replace(F.regexp_replace(F.format_string(form, x), "0+$", ""), r"\.$", "")
    million, thousand = (n / 1_000_000).cast("long").cast("string"), (n / 1000).cast("long").cast("string")
    round_forms = F.when(n % 1_000_000 == 0, F.array(n.cast("string"), F.concat(million, F.lit("m")), F.concat(million, F.lit(" million"))))
    round_forms = round_forms.when((n % 1000 == 0) & (n >= 10_000), F.array(n.cast("string"), F.concat(thousand, F.lit("k")))).otherwise(F.array(n.cast("string")))
    return F.when(F.abs(v - n) < 1e-6, round_forms).when(v.isNotNull(), F.array_distinct(F.array(short(v, "%.2f"), short(v, "%.4f"))))


def working_line(value: Column, text: Column) -> Column:
    """The first line, not of a journal, that states the value as a number of its own; null without one."""
    return N.first_line(value, N.working_index(text))


def head(criterion: Column) -> Column:
    """The part of a criterion that says what it tests."""
    return F.get(F.split(criterion, "|".join(HEAD_ENDS), 2), 0)


def focus_tokens(phrase: Column) -> Column:
    """Distinct content words of three letters or more, lower case, in order."""
    words = F.transform(F.regexp_extract_all(phrase, F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(_words(FOCUS_STOP), w)))


def meets(word: Column, others: Column) -> Column:
    """Whether one of the others starts with the word's first five letters, or the word with its first five."""
    return F.exists(others, lambda o: F.startswith(o, F.left(word, F.lit(5))) | F.startswith(word, F.left(o, F.lit(5))))


def focus_score(tokens: Column, of: Column) -> Column:
    """Share of the tokens that a criterion's head has, prefixes of five letters counting; 0 without tokens."""
    said = F.transform(F.regexp_extract_all(of, F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)
    return X.let(said, lambda s: F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: meets(t, s))) / F.size(tokens)).otherwise(0.0))


def group_key(criterion_id: Column, *of_ids: Column) -> Column:
    """Letters that start the id ("AB12" is AB), else the part before the point of the first own-figure id; empty without either."""
    letters = F.nullif(F.upper(F.regexp_extract(criterion_id, "^([A-Za-z]+)", 1)), F.lit(""))
    return F.coalesce(letters, *(F.nullif(F.upper(F.trim(F.substring_index(o, ".", 1))), F.lit("")) for o in of_ids), F.lit(""))


def keyword_tokens(keywords: Column) -> Column:
    """X11: distinct words of four letters or more of an array of keywords, lower case, common ones and figures out."""
    words = F.transform(F.flatten(F.transform(keywords, lambda k: F.regexp_extract_all(k, F.lit("[A-Za-z]+"), F.lit(0)))), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= LEAST_KEYWORD) & ~F.array_contains(_words(KEYWORD_STOP), w)))


def line_supports(line: Column, wanted: Column) -> Column:
    """X11: whether a line has one of the wanted words, or one of four letters or more that starts one or that one starts; true if nothing is wanted."""
    said = F.transform(F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)

    def has(words: Column) -> Column:
        return F.exists(wanted, lambda w: F.array_contains(words, w) | F.exists(words, lambda s: (F.length(s) >= LEAST_KEYWORD) & (F.startswith(w, s) | F.startswith(s, w))))

    return (F.size(wanted) == 0) | X.let(said, has)


def stem_match(word: Column, said: Column) -> Column:
    """Whether a word shares its stem (five letters, four of shorter words) with one of the text's; words under four letters must be there."""
    stem = F.when(F.length(word) >= 6, F.left(word, F.lit(5))).otherwise(F.left(word, F.lit(4)))
    near = F.exists(said, lambda t: (F.length(t) >= 3) & (F.startswith(t, stem) | F.startswith(word, F.left(t, F.greatest(F.lit(4), F.least(F.length(t), F.lit(5)))))))
    return F.when(F.length(word) < 4, F.array_contains(said, word)).otherwise(near)


def keyword_in_text(keyword: Column, text: Column) -> Column:
    """A word by its stem; a phrase literally, or by the stems of at least half of its words of four letters; blank ones never."""
    k, low = F.lower(F.trim(keyword)), F.lower(text)
    said = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    parts = F.filter(F.regexp_extract_all(k, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4)

    def phrase(words: Column) -> Column:
        return X.let(parts, lambda p: (F.size(p) > 0) & (F.size(F.filter(p, lambda w: stem_match(w, words))) >= F.greatest(F.lit(1), F.floor((F.size(p) + 1) / 2))))

    found = X.let(said, lambda words: F.when(k.rlike("[ /-]"), F.contains(low, k) | phrase(words)).otherwise((F.length(k) >= 3) & stem_match(k, words)))
    return F.coalesce(found & (k != ""), F.lit(False))


def said_keys(low: Column) -> Column:
    """The keys by which X13 finds the words of a lower-case text: up to five letters of each, and four after "4"."""
    words = lambda least: F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?<![a-z])([a-z]{{{least},{max(least, 5)}}})"), F.lit(1)))
    return F.concat(words(3), F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit("(?<![a-z])([a-z]{4})"), F.lit(1))), lambda w: F.concat(F.lit("4"), w)))


def stem_keys(word: Column) -> Column:
    """The keys under which ``stem_match`` finds a word among ``said_keys``."""
    stem = F.when(F.length(word) >= 6, F.array(F.left(word, F.lit(5)), F.left(word, F.lit(4)), F.left(word, F.lit(3)))).otherwise(F.array(F.concat(F.lit("4"), F.left(word, F.lit(4))), F.left(word, F.lit(3))))
    return F.when(F.length(word) < 4, F.array(word)).otherwise(stem)


def asked_keys(keywords: Column) -> Column:
    """Keywords as ``keywords_met`` takes them: array of (phrase: the phrase, null for a single word; parts: the keys of each word; need: how many of them)."""

    def of(k: Column) -> Column:
        parted = k.rlike("[ /-]")
        single = F.when(F.length(k) >= 3, F.array(stem_keys(k))).otherwise(F.array().cast("array<array<string>>"))
        several = F.transform(F.filter(F.regexp_extract_all(k, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4), stem_keys)
        return X.let(F.when(parted, several).otherwise(single), lambda p: F.struct(F.when(parted & (k != ""), k).alias("phrase"), p.alias("parts"), F.greatest(F.lit(1), F.floor((F.size(p) + 1) / 2).cast("int")).alias("need")))

    return F.transform(F.transform(keywords, lambda k: F.lower(F.trim(k))), of)


def keywords_met(asked: Column, low: Column, said: Column) -> Column:
    """X13 for a keyword of ``asked_keys`` and the ``said_keys`` of a lower-case text."""
    literal = F.coalesce(F.contains(low, asked["phrase"]), F.lit(False))
    return literal | F.coalesce(F.size(F.filter(asked["parts"], lambda keys: F.arrays_overlap(keys, said))) >= asked["need"], F.lit(False))


def keyword_score(keywords: Column, text: Column) -> Column:
    """Share of the keywords that stand in the text; 0 without keywords."""
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: keyword_in_text(k, text))) / F.size(keywords)).otherwise(0.0)


def comma_pattern(digits: Column) -> Column:
    """A pattern for a whole number with or without comma groups, spaces around the commas allowed."""
    grouped = F.replace(X.grouped(digits.try_cast("long")), F.lit(","), F.lit(r"\s*,\s*"))
    return F.when(~digits.rlike("^[0-9]+$") | (F.length(digits) <= 3), digits).otherwise(F.concat(F.lit("(?:"), digits, F.lit("|"), grouped, F.lit(")")))


def column_key(name: Column) -> Column:
    """Canonical key of a statement column, from a rubric's tag or a table's header."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]+", " "))
    t = F.trim(F.regexp_replace(t, r"\bpound\b", ""))
    has = lambda x: t.contains(x)
    return (
        F.when(t == "", "").when(has("non controlling") | (t == "nci") | t.startswith("nci "), "nci").when(has("retained"), "retained_earnings")
        .when(has("share premium") | (t == "premium"), "share_premium").when(has("option"), "share_option_reserve").when(has("other component") | has("other reserve"), "other_components")
        .when(has("share capital") | has("equity share"), "equity_share_capital").when(has("total"), "total").otherwise(F.regexp_replace(t, r"\s+", "_"))
    )


def table_header(text: Column) -> Column:
    """Keys of the cells of the first row with three pipes and two known columns (a total is none); null without one."""
    known = _words([c for c in COLUMNS if c != "total"])
    rows = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, r"[^|]", "")) >= 3)
    keys = F.transform(rows, lambda x: F.transform(F.split(x, r"\|"), lambda c: column_key(F.trim(c))))
    return F.get(F.filter(keys, lambda k: F.size(F.array_intersect(k, known)) >= 2), 0)


def strict_numbers_apply(criterion: Column) -> Column:
    """F15's gate: short currency items, and criteria that mainly consist of one bracketed product or quotient."""
    c = F.trim(criterion)
    inside = F.regexp_extract(c, r"\(([^)]*)\)", 1)
    before = F.trim(F.regexp_extract(c, r"^([^(]*)\(", 1))
    currency = (F.size(X.numbers(c)) <= 3) & (F.length(c) <= 80)
    bracket = c.rlike(r"\([^)]*\)") & ~((F.length(c) > 100) & (F.length(before) > 60)) & inside.rlike("[0-9]") & ~inside.rlike("[+-]") & F.lower(inside).rlike("[x*/]")
    return F.when(c.rlike("(?i)^(?:usd|gbp|eur)"), currency).otherwise(bracket)


def heading_like(line: Column) -> Column:
    """a line that ends with a colon or announces something rather than states it."""
    t = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    plain = ~t.rlike("[0-9]") & (F.size(F.split(t, " ")) <= 12) & t.rlike(HEADING_KEYWORDS)
    return F.coalesce((t != "") & (t.rlike(":$") | t.rlike(HEADING_PHRASES) | plain), F.lit(False))


def value_like(word: Column) -> Column:
    """a word that is a figure other than zero: with a currency or percent sign, or plain with two digits; "W1" is none."""
    t = F.trim(word)
    digits = F.regexp_replace(t, "[^0-9]", "")
    signed = t.rlike("[£$%]") & (digits != "")
    bare = F.regexp_replace(F.regexp_replace(t, ",", ""), r"^[()]+|[()]+$", "")
    plain = bare.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$") & (F.length(digits) >= 2)
    return F.coalesce((t != "") & ~t.rlike(r"^[A-Za-z]{1,3}[0-9]{1,3}$") & F.when(signed, digits.rlike("[1-9]")).otherwise(plain & digits.rlike("[1-9]")), F.lit(False))


def column_header_line(line: Column) -> Column:
    """a line without a digit and with four words or more of three characters that start with a letter."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: (F.length(w) >= 3) & w.rlike("^[A-Za-z]"))
    return F.coalesce(~line.rlike("[0-9]") & (F.size(words) >= 4), F.lit(False))


def prose_words(text: Column, least: int = 8) -> Column:
    """whether a text has eight words of two letters or more."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))) >= least, F.lit(False))


def aligned(criterion: Column, evidence: Column) -> Column:
    """whether normalised evidence bears on a normalised narrative criterion.

    Two shared content words, or one and a digit, or one of seven letters; words of one synonym group
    count as shared once. Figures of three digits speak for themselves where evidence has hardly any
    words, or few words and a figure of the criterion. Criteria with amounts, journal lines and short
    labels are always aligned.
    """
    exempt = criterion.rlike(r"\b[0-9]{3,}\b|[£$]|\bgbp\b|^(?:dr|cr) ") | ((F.length(criterion) < 50) & (F.size(F.split(criterion, " ")) < 8)) | (criterion == "")
    groups = {w: i for i, g in enumerate(SYNONYMS) for b in g for w in ([b] if b.endswith("s") else [b, b + "s"])}
    group_of = F.create_map(*(F.lit(x) for pair in sorted(groups.items()) for x in pair))
    wanted = F.array_distinct(F.filter(F.regexp_extract_all(criterion, F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~F.array_contains(_words(ALIGNMENT_STOP), w)))
    said = F.array_distinct(F.regexp_extract_all(evidence, F.lit("[a-z]{4,}"), F.lit(0)))
    figures = F.filter(F.transform(F.regexp_extract_all(criterion, F.lit(r"[0-9][0-9,]*\.?[0-9]*"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "")), lambda n: F.length(n) >= 3)

    def decide(x: Column) -> Column:
        same = F.array_intersect(x["w"], x["s"])
        in_groups = lambda ws: F.array_distinct(F.filter(F.transform(ws, lambda w: F.try_element_at(group_of, w)), lambda g: g.isNotNull()))
        more = F.size(F.array_intersect(in_groups(F.array_except(x["w"], same)), in_groups(x["s"])))
        overlap = F.size(same) + more
        long_figure = evidence.rlike("[0-9]{3,}")
        numeric = (F.size(x["s"]) <= 1) & long_figure
        quoted = F.size(x["s"]).between(2, 3) & long_figure & F.exists(figures, lambda n: F.contains(F.regexp_replace(evidence, "[, ]", ""), n))
        return (F.size(x["w"]) == 0) | numeric | quoted | (overlap >= 2) | ((overlap >= 1) & evidence.rlike("[0-9]")) | F.exists(same, lambda w: F.length(w) >= 7)

    return exempt | ((evidence != "") & X.let(F.struct(wanted.alias("w"), said.alias("s")), decide))
