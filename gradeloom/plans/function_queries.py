"""One query for each column function, each the library's function over a whole table, with its rule as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic
from ..functions import criteria as C
from ..functions import numbers as N
from ..functions import text as X
from ..operators import finalize
from .guard_queries import ALIGNED, ALIGNED_STEPS, KEY, SAID, any_sql, in_text_sql, prepared, variants_sql, words_sql
from .marking_view import VIEW, judged, scripts
from .queries import _NUMBERS_SQL, _SENTENCES_SQL, _STOP_SQL, _norm_sql, _short_sql, query, table

def over_rows(spark, sf_dir, *columns):
    return prepared(spark, sf_dir).select(*KEY, *columns)


def over_documents(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


def from_rows(value: str, name: str, where: str = "") -> str:
    return f"{VIEW} SELECT submission_id, item_pos, {value} AS {name} FROM r {where}"


# Texts and numbers


@query(from_rows(_norm_sql("criterion"), "norm"))
def x01_evidence_norm(spark, sf_dir):
    return over_rows(spark, sf_dir, X.evidence_norm(F.col("criterion")).alias("norm"))


@query(f"""{VIEW} SELECT submission_id, item_pos, {in_text_sql('expected_amount', 'text')} AS present FROM r""")
def x03_value_in_text(spark, sf_dir):
    return over_rows(spark, sf_dir, N.value_in_text(F.col("expected_amount"), F.col("text")).alias("present"))


_TOKENS = [("'£' || format('{:,}', f)", "CAST(f AS DOUBLE)"), ("(f / 1000.0) || 'm'", "f / 1000.0 * 1000000"), ("n || 'k'", "n * 1000.0"), ("n || 'p'", "n / 100.0"), ("n || '%'", "n / 100.0"), ("n || '/12'", "n / 12.0"), ("'see ' || n", "CAST(NULL AS DOUBLE)")]


@query(f"{VIEW} SELECT submission_id, item_pos, CASE item_pos % 7 " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(_TOKENS)) + " END AS value FROM r")
def x04_number_token(spark, sf_dir):
    return _with_numbers(spark, sf_dir).select(*KEY, X.number_token(_small(F.col("n"), F.col("f"))).alias("value"))


def _with_numbers(spark, sf_dir):
    """Rows with the view's small number n and figure f (the part's, and the supplier's place)."""
    from .marking_view import ORDER
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    return li.select(F.col("l_orderkey").alias("submission_id"), rank.alias("item_pos"), ((F.col("l_partkey") % 40 + 1) * 125).alias("f"), (F.col("l_suppkey") % 9 + 2).alias("n"))


def _small(n, f):
    made = [F.concat(F.lit("£"), X.grouped(f)), F.concat(f / 1000.0, F.lit("m")), F.concat(n, F.lit("k")), F.concat(n, F.lit("p")), F.concat(n, F.lit("%")), F.concat(n, F.lit("/12")), F.concat(F.lit("see "), n)]
    return F.element_at(F.array(*made), (F.col("item_pos") % 7 + 1).cast("int"))


@query(f"{VIEW} SELECT submission_id, item_pos, CASE WHEN kind = 2 THEN CAST(p AS DOUBLE) END AS value FROM r")
def x05_bracket_value(spark, sf_dir):
    return over_rows(spark, sf_dir, arithmetic.bracket_value(F.col("criterion")).alias("value"))


_SPELLED = "array_to_string(CASE WHEN v % 1000000 = 0 THEN [CAST(v AS VARCHAR), CAST(v // 1000000 AS VARCHAR) || 'm', CAST(v // 1000000 AS VARCHAR) || ' million'] WHEN v % 1000 = 0 AND v >= 10000 THEN [CAST(v AS VARCHAR), CAST(v // 1000 AS VARCHAR) || 'k'] ELSE [CAST(v AS VARCHAR)] END, '|')"


@query(f"""{VIEW} SELECT submission_id, item_pos, CASE WHEN item_pos % 2 = 0 THEN {_SPELLED} ELSE array_to_string(list_distinct([f / 1000.0 || '']), '|') END AS spellings
FROM (SELECT *, CASE item_pos % 4 WHEN 0 THEN p ELSE f * 8000 END AS v FROM r) WHERE item_pos % 2 = 0 OR f % 1000 <> 0""")
def x07_expected_spellings(spark, sf_dir):
    rows = _with_numbers(spark, sf_dir).filter("item_pos % 2 = 0 or f % 1000 <> 0")
    whole = F.when(F.col("item_pos") % 4 == 0, F.col("n") * F.col("f")).otherwise(F.col("f") * 8000).cast("double")
    value = F.when(F.col("item_pos") % 2 == 0, whole).otherwise(F.col("f") / 1000.0)
    # Figures in thousands have three decimals at most, so two and four decimals differ only where the third is set.
    spelled = C.expected_spellings(value)
    return rows.select(*KEY, F.when(F.col("item_pos") % 2 == 0, F.array_join(spelled, "|")).otherwise(F.element_at(spelled, -1)).alias("spellings"))


@query(f"{VIEW} SELECT submission_id, item_pos, CASE WHEN kind = 2 THEN CAST(f AS DOUBLE) WHEN kind = 14 THEN CAST(f AS DOUBLE) END * CASE WHEN item_pos % 3 = 1 THEN 1000000.0 WHEN item_pos % 3 = 2 THEN 1000.0 ELSE 1.0 END AS amount FROM r")
def x08_expected_amount(spark, sf_dir):
    scaled = F.regexp_replace("criterion", "(GBP[0-9]+)", F.when(F.col("item_pos") % 3 == 1, F.lit("$1 million")).when(F.col("item_pos") % 3 == 2, F.lit("$1k")).otherwise(F.lit("$1")))
    return over_rows(spark, sf_dir, C.expected_amount(scaled).alias("amount"))


@query(f"""{VIEW} SELECT submission_id, item_pos, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda line: line <> '' AND NOT regexp_matches(line, '(?i)^\\s*(?:debit|credit|dr\\b|cr\\b)\\b') AND {in_text_sql('expected_amount', 'line')})[1] AS line FROM r""")
def x09_working_line(spark, sf_dir):
    """Each script's lines are indexed once, not for each of its rows."""
    rows = judged(spark, sf_dir)
    indexed = scripts(rows).select("submission_id", N.working_index(F.col("text")).alias("index"))
    return rows.join(indexed, "submission_id").select(*KEY, N.first_line(F.col("expected_amount"), F.col("index")).alias("line"))


_FOCUS_STOP = "[" + ", ".join(f"'{w}'" for w in C.FOCUS_STOP) + "]"
_FOCUS = f"list_distinct(list_filter(list_transform(regexp_extract_all({{c}}, '[A-Za-z]{{{{3,}}}}'), lambda w: lower(w)), lambda w: NOT list_contains({_FOCUS_STOP}, w)))"


@query(f"""{VIEW}, t AS (SELECT *, {_FOCUS.format(c=SAID)} AS ft, list_transform(regexp_extract_all(criterion, '[A-Za-z]{{3,}}'), lambda w: lower(w)) AS hw FROM r)
SELECT submission_id, item_pos, len(ft) AS n_tokens, CASE WHEN len(ft) > 0 THEN len(list_filter(ft, lambda a: len(list_filter(hw, lambda o: starts_with(o, left(a, 5)) OR starts_with(a, left(o, 5)))) > 0)) / len(ft) ELSE 0.0 END AS score, grp AS group_key FROM t""")
def x10_focus_score(spark, sf_dir):
    rows = prepared(spark, sf_dir).withColumn("criterion", F.concat("criterion", F.lit(" CONTEXT profit revenue goodwill audit receivables assets")))
    tokens = C.focus_tokens(F.array_join("evidence", " "))
    return rows.select(*KEY, F.size(tokens).cast("long").alias("n_tokens"), C.focus_score(tokens, C.head(F.col("criterion"))).alias("score"), C.group_key(F.col("criterion_id")).alias("group_key"))


_KEYWORD_STOP = "[" + ", ".join(f"'{w}'" for w in C.KEYWORD_STOP) + "]"
_WANTED = f"list_distinct(list_filter(list_transform(regexp_extract_all(criterion, '[A-Za-z]+'), lambda w: lower(w)), lambda w: length(w) >= 4 AND NOT list_contains({_KEYWORD_STOP}, w)))"


@query(f"""{VIEW}, t AS (SELECT *, {_WANTED} AS ws, list_transform(regexp_extract_all({SAID}, '[A-Za-z]+'), lambda w: lower(w)) AS ls FROM r)
SELECT submission_id, item_pos, len(ws) AS wanted, len(ws) = 0 OR len(list_filter(ws, lambda w: list_contains(ls, w) OR len(list_filter(ls, lambda s: length(s) >= 4 AND (starts_with(w, s) OR starts_with(s, w)))) > 0)) > 0 AS supports FROM t""")
def x11_line_supports(spark, sf_dir):
    wanted = C.keyword_tokens(F.array("criterion"))
    return over_rows(spark, sf_dir, F.size(wanted).cast("long").alias("wanted"), C.line_supports(F.array_join("evidence", " "), wanted).alias("supports"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\r,;|]+', '', 'g')) AS digest FROM documents")
def x12_line_norm(spark, sf_dir):
    return over_documents(spark, sf_dir, F.md5(X.line_norm(F.col("text"))).alias("digest"))


def _stem_sql(k: str, words: str) -> str:
    near = f"len(list_filter({words}, lambda t: length(t) >= 3 AND (starts_with(t, CASE WHEN length({k}) >= 6 THEN left({k}, 5) ELSE left({k}, 4) END) OR starts_with({k}, left(t, greatest(4, least(length(t), 5))))))) > 0"
    return f"CASE WHEN length({k}) < 4 THEN list_contains({words}, {k}) ELSE {near} END"


@query(f"""{VIEW}, t AS (SELECT *, regexp_extract_all(lower({SAID}), '[a-z]+') AS said_w, list_filter(regexp_extract_all(lower(trim(criterion)), '[a-z]+'), lambda w: length(w) >= 4) AS parts, lower(trim(criterion)) AS k FROM r)
SELECT submission_id, item_pos, CASE WHEN regexp_matches(k, '[ /-]') THEN contains(lower({SAID}), k) OR (len(parts) > 0 AND len(list_filter(parts, lambda w: {_stem_sql('w', 'said_w')})) >= greatest(1, (len(parts) + 1) // 2)) ELSE length(k) >= 3 AND {_stem_sql('k', 'said_w')} END AS found FROM t""")
def x13_keyword_in_text(spark, sf_dir):
    return over_rows(spark, sf_dir, C.keyword_in_text(F.col("criterion"), F.array_join("evidence", " ")).alias("found"))


@query(f"""{VIEW}, t AS (SELECT *, regexp_extract_all(lower({SAID}), '[a-z]+') AS said_w, {words_sql('lower(criterion)')} AS ks FROM r)
SELECT submission_id, item_pos, CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda k: {_stem_sql('k', 'said_w')})) / len(ks) ELSE 0.0 END AS score FROM t""")
def a15_keyword_score(spark, sf_dir):
    keywords = F.regexp_extract_all(F.lower("criterion"), F.lit("[a-z]{4,}"), F.lit(0))
    return over_rows(spark, sf_dir, C.keyword_score(keywords, F.array_join("evidence", " ")).alias("score"))


@query(rf"""WITH a AS (SELECT doc_id, lower(translate(text, '{X.NBSP}{X.EN_DASH}{X.EM_DASH}−', ' ---')) AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '[£$€]|\bgbp\b|\busd\b', '', 'g'), '\(([0-9][0-9.,]*)\)', '-\1', 'g'), '([0-9]) ?(?:million|mn)\b', '\1m', 'g') || ' ' AS x FROM a),
c AS (SELECT doc_id, x, 0 AS i FROM b),
g AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '([0-9])[, ]([0-9]{{3}})([^0-9])', '\1' || chr(1) || '\2\3', 'g'), '([0-9])[, ]([0-9]{{3}})([^0-9])', '\1' || chr(1) || '\2\3', 'g'), '([0-9])[, ]([0-9]{{3}})([^0-9])', '\1' || chr(1) || '\2\3', 'g'), '([0-9])[, ]([0-9]{{3}})([^0-9])', '\1' || chr(1) || '\2\3', 'g') AS x FROM c)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(x, chr(1), ''), '[(),;:]', ' ', 'g'), '[ \t\n]+', ' ', 'g'))) AS digest FROM g""")
def x16_symbol_norm(spark, sf_dir):
    return over_documents(spark, sf_dir, F.md5(X.symbol_norm(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP_SQL}, w)) AS t FROM documents)")
def x17_tokens(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return over_documents(spark, sf_dir, F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"""{VIEW}, v AS (SELECT submission_id, item_pos, f, n FROM r)
SELECT submission_id, item_pos, len(list_distinct(vs)) AS n_forms, list_contains(vs, '£' || f || ' at ' || n || ' percent') AS has_percent, list_contains(vs, 'GBP ' || f || ' at ' || n || '%') AS has_gbp, list_contains(vs, f || ' at ' || n || '%') AS has_bare FROM (
  SELECT *, ['£' || f || ' at ' || n || '%', '£' || f || ' at ' || n || ' percent', 'GBP ' || f || ' at ' || n || '%', f || ' at ' || n || '%'] AS vs FROM v)""")
def x18_anchor_variations(spark, sf_dir):
    rows = _with_numbers(spark, sf_dir)
    said = F.concat(F.lit("£"), "f", F.lit(" at "), "n", F.lit("%"))
    forms = X.anchor_variations(said)
    has = lambda c: F.array_contains(forms, c)
    return rows.select(*KEY, F.size(forms).cast("long").alias("n_forms"), has(F.concat(F.lit("£"), "f", F.lit(" at "), "n", F.lit(" percent"))).alias("has_percent"), has(F.concat(F.lit("GBP "), "f", F.lit(" at "), "n", F.lit("%"))).alias("has_gbp"), has(F.concat("f", F.lit(" at "), "n", F.lit("%"))).alias("has_bare"))


@query("SELECT p_partkey, array_to_string(list_distinct([CAST(v AS VARCHAR), format('{:,}', v), replace(format('{:,}', v), ',', ' '), format('{:,}', v) || '.00']), '|') = '' AS empty, len(list_distinct([CAST(v AS VARCHAR), format('{:,}', v), replace(format('{:,}', v), ',', ' '), format('{:,}', v) || '.00'])) AS n, list_contains([replace(format('{:,}', v), ',', ' ')], replace(format('{:,}', v), ',', ' ')) AS spaced FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 2500 AS v FROM part)")
def x19_number_variations(spark, sf_dir):
    v = F.col("p_size").cast("long") * 2500
    forms = X.number_variations(X.grouped(v))
    return table(spark, sf_dir, "part").select("p_partkey", (F.array_join(forms, "|") == "").alias("empty"), F.size(forms).cast("long").alias("n"), F.array_contains(forms, F.translate(X.grouped(v), ",", " ")).alias("spaced"))


_GRAMS = "flatten(list_transform(list_reverse(range(1, len(ws) + 1)), lambda n: list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))))"


@query(f"""SELECT p_partkey, array_to_string(list_filter({_GRAMS}, lambda g: length(g) >= 3 AND (contains(g, ' ') OR regexp_matches(g, '[A-Za-z]{{3}}'))), '|') AS grams FROM (SELECT p_partkey, string_split('Acq ' || (p_size % 9) || ' ' || p_type, ' ') AS ws FROM part)""")
def x20_header_candidates(spark, sf_dir):
    header = F.concat(F.lit("Acq "), F.col("p_size") % 9, F.lit(" "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.header_candidates(header), "|").alias("grams"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({_NUMBERS_SQL.format(c='text')}, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 2))), '|') AS numbers FROM documents")
def x21_salient_numbers(spark, sf_dir):
    return over_documents(spark, sf_dir, F.array_join(F.array_sort(X.salient_numbers(F.col("text"))), "|").alias("numbers"))


@query("SELECT p_partkey, " + _short_sql("q").replace("%.6f", "%.2f") + " AS marks, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN CAST(p_size AS DOUBLE) END AS parsed FROM (SELECT *, p_size / 4.0 AS q FROM part)")
def x22_marks_text(spark, sf_dir):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat("p_size", F.lit(" 1/2"))).when(k == 1, "1/2 mk each max 3").when(k == 2, F.col("p_size").cast("string")).otherwise("HR")
    return table(spark, sf_dir, "part").select("p_partkey", X.marks_text(F.col("p_size") / 4.0).alias("marks"), X.marks_value(said).alias("parsed"))


_COLUMN_NAMES = ["Retained Earnings", "NCI", "Share Premium £000", "Option reserve", "Other components of equity", "Equity share capital", "Total", "Non-controlling interest", "Note 4", ""]


@query("SELECT p_partkey, (['retained_earnings', 'nci', 'share_premium', 'share_option_reserve', 'other_components', 'equity_share_capital', 'total', 'nci', 'note', ''])[p_partkey % 10 + 1] AS key, CASE WHEN p_partkey % 10 IN (0, 2, 3, 4, 5) THEN (['retained_earnings', 'nci', 'share_premium', 'share_option_reserve', 'other_components', 'equity_share_capital'])[p_partkey % 10 + 1] || '|nci|total|note' END AS header FROM part")
def x24_column_key(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _COLUMN_NAMES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    text = F.concat(F.lit("Statement\na | b\n"), name, F.lit(" | NCI | Total | Note\nrow | 1 | 2 | 3"))
    return table(spark, sf_dir, "part").select("p_partkey", C.column_key(name).alias("key"), F.array_join(C.table_header(text), "|").alias("header"))


@query(f"""{VIEW} SELECT submission_id, item_pos, {any_sql(variants_sql("expected_amount"), "s", f"regexp_matches({SAID}, '(?i)\\([£$€]? ?' || replace(s, '.', '\\.') || '(?:m|k)?\\)|\\b(?:less|deduct|minus)\\b[^0-9\n]{{0,40}}[£$€]?' || replace(s, '.', '\\.') || '($|[^0-9])')")} AS deducted FROM r""")
def x25_is_deduction(spark, sf_dir):
    return over_rows(spark, sf_dir, X.is_deduction(F.col("expected_amount"), F.array_join("evidence", " ")).alias("deducted"))


@query("SELECT c_custkey, regexp_replace(trim(c_name || ' (' || c_mktsegment || ') #' || c_custkey), '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM customer")
def x26_safe_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.safe_name(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") #"), "c_custkey")).alias("name"))


@query("SELECT p_partkey, CASE WHEN v < 1000 THEN CAST(v AS VARCHAR) ELSE '(?:' || v || '|' || replace(format('{:,}', v), ',', '\\s*,\\s*') || ')' END AS pattern, true AS matches FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 1250 ELSE 1000001 END AS v FROM part)")
def x27_comma_pattern(spark, sf_dir):
    v = F.col("p_size").cast("long") * F.when(F.col("p_partkey") % 3 == 0, 7).when(F.col("p_partkey") % 3 == 1, 1250).otherwise(1000001)
    pattern = C.comma_pattern(v.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", pattern.alias("pattern"), F.rlike(F.concat(F.lit("x "), F.regexp_replace(X.grouped(v), ",", " , "), F.lit(" y")), pattern).alias("matches"))


@query(f"""WITH w AS (SELECT doc_id, ws[i] AS w, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP_SQL}, w) AND NOT regexp_matches(w, '^[0-9]+$')) AS ws FROM documents))),
f AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k FROM w GROUP BY doc_id, w)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (WHERE k <= 6), '') AS words FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def x28_context_words(spark, sf_dir):
    words = X.context_words(F.col("text"))
    return over_documents(spark, sf_dir, F.array_join(words, " ").alias("words"))


# Predicates


_NO_CRITERIA = "[" + ", ".join(f"'{w}'" for w in X.NO_CRITERIA) + "]"
_HEADINGS = "[" + ", ".join(f"'{w}'" for w in X.HEADING_WORDS) + "]"
_SHORT = "[" + ", ".join(f"'{w}'" for w in X.SHORT_CRITERIA) + "]"
_SPLIT = r"list_filter(string_split_regex({c}, '[ \t\n]+'), lambda w: w <> '')"
_RUBRIC_LINES = ["{f}/4", "Handwritten annotation", "1) Retained part", "Prepare statement", "Goodwill", "Dr Cash", "3 1/2", "The change of {f} in the year", "(2) Explain equity", "Revaluation gain", "x", "Cost {f}"]


@query(rf"""{VIEW}, t AS (SELECT submission_id, item_pos, lower(trim(replace(([{', '.join("'" + x + "'" for x in _RUBRIC_LINES)}])[CAST((f // 125 + item_pos) % 12 + 1 AS INTEGER)], '{{f}}', CAST(f AS VARCHAR)))) AS t FROM r),
u AS (SELECT *, regexp_replace(t, '^\([0-9]+\)[ \t]*|^[0-9]+[.)][ \t]*', '') AS bare FROM t),
v AS (SELECT *, {_SPLIT.format(c='t')} AS ws, {_SPLIT.format(c='bare')} AS rs, regexp_matches(bare, '[0-9]') AS figure, coalesce(({_SPLIT.format(c='bare')})[1] IN ('dr', 'cr'), false) AS journal FROM u)
SELECT submission_id, item_pos, t <> '' AND NOT regexp_matches(t, '^[0-9]+ */ *[0-9]+( *(mk|marks?).*)?$|^[0-9]+ +[0-9]+/[0-9]+ *$') AND NOT list_contains({_NO_CRITERIA}, t) AND NOT (bare <> t AND len(rs) <= 5 AND NOT figure AND NOT journal)
  AND NOT (len(rs) <= 4 AND NOT figure AND NOT journal AND list_has_any(rs, {_HEADINGS})) AND (len(ws) >= 3 OR (len(ws) >= 2 AND ws[1] IN ('dr', 'cr')) OR regexp_matches(t, '[0-9()]|gbp|usd|eur|percent') OR list_contains({_SHORT}, t)) AS valid FROM v""")
def f01_valid_criterion(spark, sf_dir):
    rows = _with_numbers(spark, sf_dir)
    line = F.element_at(F.array(*map(F.lit, _RUBRIC_LINES)), ((F.floor(F.col("f") / 125) + F.col("item_pos")) % 12 + 1).cast("int"))
    return rows.select(*KEY, X.is_valid_criterion(F.replace(line, F.lit("{f}"), F.col("f").cast("string"))).alias("valid"))


@query("SELECT event_id, a = '' OR b = '' OR starts_with(a, b) OR starts_with(b, a) AS same FROM (SELECT event_id, CAST(event_id % 41 AS VARCHAR) AS a, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id % 5 AS VARCHAR) END AS b FROM events)")
def f02_same_question(spark, sf_dir):
    e = F.col("event_id")
    a, b = F.concat(F.lit("Question "), e % 41), F.when(e % 7 != 0, F.concat(F.lit("("), e % 5, F.lit(")")))
    return table(spark, sf_dir, "events").select("event_id", X.same_question(a, b).alias("same"))


@query(rf"SELECT conv_id, turn, md5(t) AS line, length(t) >= 6 AND NOT regexp_matches(t, '^(19|20)[0-9]{{2}}$') AND (regexp_matches(t, '[0-9]') OR contains(t, ':') OR len(list_filter(regexp_extract_all(lower(t), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP_SQL}, w))) >= 2) AS informative FROM (SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN left(text, 12) WHEN 1 THEN '20' || lpad(CAST(turn % 100 AS VARCHAR), 2, '0') ELSE left(text, 30) END) AS t FROM conversations)")
def f21_informative(spark, sf_dir):
    line = F.when(F.col("turn") % 3 == 0, F.left("text", F.lit(12))).when(F.col("turn") % 3 == 1, F.concat(F.lit("20"), F.lpad((F.col("turn") % 100).cast("string"), 2, "0"))).otherwise(F.left("text", F.lit(30)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.trim(line)).alias("line"), X.is_informative(line).alias("informative"))


_SPACED = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"


@query(rf"""{VIEW}, t AS (SELECT submission_id, item_pos, criterion || CASE WHEN item_pos % 5 = 0 THEN ' as follows' WHEN item_pos % 5 = 1 THEN ':' ELSE '' END AS x, {SAID} AS said, evidence[1] AS word FROM r), u AS (SELECT *, lower({_SPACED}) AS low FROM t)
SELECT submission_id, item_pos, low <> '' AND (regexp_matches(low, ':$') OR regexp_matches(low, '{C.HEADING_PHRASES}') OR (NOT regexp_matches(low, '[0-9]') AND len(string_split(low, ' ')) <= 12 AND regexp_matches(low, '{C.HEADING_KEYWORDS}'))) AS heading,
  NOT regexp_matches(x, '[0-9]') AND len(list_filter(string_split_regex(trim(x), '\s+'), lambda w: length(w) >= 3 AND regexp_matches(w, '^[A-Za-z]'))) >= 4 AS header,
  coalesce(regexp_matches(replace(word, ',', ''), '^[(]*-?[0-9]+(?:\.[0-9]+)?[)]*$') AND length(regexp_replace(word, '[^0-9]', '', 'g')) >= 2, false) AS figure FROM u""")
def f22_line_predicates(spark, sf_dir):
    x = F.concat("criterion", F.when(F.col("item_pos") % 5 == 0, " as follows").when(F.col("item_pos") % 5 == 1, ":").otherwise(""))
    return over_rows(spark, sf_dir, C.heading_like(x).alias("heading"), C.column_header_line(x).alias("header"), C.value_like(F.get("evidence", 0)).alias("figure"))


@query(f"{VIEW}, t AS (SELECT submission_id, item_pos, criterion AS t FROM r) SELECT submission_id, item_pos, len(list_filter(string_split_regex(t, ' +'), lambda w: w <> '')) <= 8 AND (regexp_matches(t, ':$') OR regexp_matches(t, '^[A-Z][A-Z &/-]+$') OR regexp_matches(t, '^(?:\\(?[a-z0-9]{{1,3}}[.)]) [A-Z]')) AND NOT regexp_matches(t, '[0-9]{{3}}') AS heading FROM (SELECT submission_id, item_pos, CASE item_pos % 4 WHEN 0 THEN upper(t) WHEN 1 THEN 'a) ' || t WHEN 2 THEN t || ':' ELSE t END AS t FROM t)")
def f22_heading_line(spark, sf_dir):
    t, k = F.col("criterion"), F.col("item_pos") % 4
    return over_rows(spark, sf_dir, X.is_heading_line(F.when(k == 0, F.upper(t)).when(k == 1, F.concat(F.lit("a) "), t)).when(k == 2, F.concat(t, F.lit(":"))).otherwise(t)).alias("heading"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{2,}')) >= 8 AS prose FROM documents")
def f26_prose_words(spark, sf_dir):
    return over_documents(spark, sf_dir, C.prose_words(F.col("text")).alias("prose"))


@query(f"{VIEW}, a0 AS (SELECT *, {_norm_sql('criterion')} AS cn, {_norm_sql(SAID)} AS jn FROM r), {ALIGNED_STEPS} SELECT submission_id, item_pos, {ALIGNED} AS aligned FROM a4")
def f10_aligned(spark, sf_dir):
    return over_rows(spark, sf_dir, C.aligned(X.evidence_norm(F.col("criterion")), X.evidence_norm(F.array_join("evidence", " "))).alias("aligned"))


@query(rf"{VIEW} SELECT submission_id, item_pos, CASE WHEN regexp_matches(c, '(?i)^(?:usd|gbp|eur)') THEN len(regexp_extract_all(c, '[0-9][0-9,]*(?:\.[0-9]+)?')) <= 3 AND length(c) <= 80 ELSE kind = 2 END AS strict FROM (SELECT *, CASE WHEN item_pos % 3 = 0 THEN 'GBP ' ELSE '' END || criterion AS c FROM r)")
def f15_strict_gate(spark, sf_dir):
    return over_rows(spark, sf_dir, C.strict_numbers_apply(F.concat(F.when(F.col("item_pos") % 3 == 0, "GBP ").otherwise(""), "criterion")).alias("strict"))


# Parsing


@query("SELECT event_id, array_to_string(list_transform(range(0, CASE WHEN a <= b THEN b - a + 1 ELSE 0 END), lambda i: CAST(a + i AS VARCHAR)) || [CAST(a AS VARCHAR), CAST(b AS VARCHAR)], ',') AS pages FROM (SELECT event_id, CAST(event_id % 9 + 1 AS BIGINT) AS a, CAST(event_id % 7 + 3 AS BIGINT) AS b FROM events)")
def p01_page_list(spark, sf_dir):
    a, b = F.col("event_id") % 9 + 1, F.col("event_id") % 7 + 3
    text = F.concat(a, F.lit(" - "), b, F.lit(", "), a, F.lit(",x,"), b)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.page_list(text), ",").alias("pages"))


@query(f"""SELECT doc_id, len(p) AS n_points, md5(array_to_string(p, chr(10))) AS digest FROM (SELECT doc_id, list_filter(flatten(list_transform(list_transform(string_split_regex(text, '\\n[ \t]*\\n|\\n[ \t]*(?:[-*•–]|[0-9]{{1,2}}[.)]|\\([a-z0-9]{{1,3}}\\))[ \t]+'),
  lambda b: regexp_replace(trim(regexp_replace(b, '[ \t\n]+', ' ', 'g')), '^(?:[-*•–]|[0-9]{{1,2}}[.)]|\\([a-z0-9]{{1,3}}\\)) +', '')), lambda b: CASE WHEN length(b) > 150 THEN {_SENTENCES_SQL.format(c='b')} ELSE [b] END)), lambda s: length(s) >= 10) AS p FROM documents)""")
def p10_body_points(spark, sf_dir):
    p = X.body_points(F.col("text"))
    return over_documents(spark, sf_dir, F.size(p).cast("long").alias("n_points"), F.md5(F.array_join(p, "\n")).alias("digest"))


@query(f"""{VIEW}, ln AS (SELECT submission_id, ls[i] AS line, i FROM (SELECT submission_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM script)),
h AS (SELECT *, regexp_matches(line, '^--- .* ---$') AS head, count(*) FILTER (WHERE regexp_matches(line, '^--- .* ---$')) OVER (PARTITION BY submission_id ORDER BY i) AS sec FROM ln)
SELECT submission_id, CAST(sec - 1 AS INTEGER) AS number, max(CASE WHEN head THEN regexp_extract(line, '^--- (.*) ---$', 1) END) AS label, md5(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '')) AS body FROM h GROUP BY 1, 2""")
def p14_sections(spark, sf_dir):
    from .marking_view import judged, scripts

    s = scripts(judged(spark, sf_dir))
    return s.select("submission_id", F.posexplode(X.sections(F.col("text"))).alias("number", "x")).select("submission_id", "number", "x.label", F.md5("x.body").alias("body"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 17 END AS n FROM events")
def p15_isolate_json(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, "no answer").otherwise(F.concat(F.lit('Here it is:\n```json\n{"kind": "'), "event_type", F.lit('", "n": '), F.col("event_id") % 17, F.lit("}\n```\nDone.")))
    doc = F.from_json(X.isolate_json(said), "kind string, n long")
    return table(spark, sf_dir, "events").select("event_id", doc["kind"].alias("kind"), doc["n"].alias("n"))


@query(f"{VIEW} SELECT submission_id, item_pos, array_to_string(list_filter(list_transform(string_split_regex(text, '[\\n;]'), lambda p: trim(p)), lambda p: p <> ''), ' / ') AS parts FROM r")
def p18_evidence_list(spark, sf_dir):
    return over_rows(spark, sf_dir, F.array_join(X.evidence_list(F.col("text")), " / ").alias("parts"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || p_size || '#' || p_name || ' ' || p_brand || ' ' || p_size || '#' || p_name || ' | ' || p_brand || ' | ' || p_size END AS forms FROM part""")
def p19_row_variants(spark, sf_dir):
    row = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" | ", "p_name", "p_brand", "p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.row_variants(row), "#").alias("forms"))


@query("SELECT event_id, CASE WHEN k < 2 THEN event_type END AS anchor, CASE WHEN k < 2 THEN 'see note. Twice.' ELSE 'no arrow here' END AS note, k < 2 AS annotation FROM (SELECT *, event_id % 3 AS k FROM events)")
def p21_comment_routing(spark, sf_dir):
    k = F.col("event_id") % 3
    said = F.concat(F.lit("[4.1(a)] "), F.when(k == 0, F.concat("event_type", F.lit(" -> see note. Twice."))).when(k == 1, F.concat("event_type", F.lit(" → see note. Twice."))).otherwise("no arrow here"))
    parts = X.comment_parts(said)
    return table(spark, sf_dir, "events").select("event_id", parts["anchor"].alias("anchor"), parts["note"].alias("note"), X.is_annotation(said).alias("annotation"))


@query(r"""SELECT conv_id, turn, md5(array_to_string(ws[3:7], ' ')) AS inside, md5(array_to_string(ws[1:4], ' ')) AS made_up FROM (SELECT conv_id, turn, list_filter(string_split_regex(trim(text), '[ \t\n\r]+'), lambda w: w <> '') AS ws FROM conversations) WHERE len(ws) >= 9""")
def p22_grounded_anchor(spark, sf_dir):
    words = F.filter(F.split(F.trim("text"), r"[ \t\n\r]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "conversations").withColumn("ws", words).filter("size(ws) >= 9")
    inside = F.array_join(F.slice("ws", 3, 5), " ")
    made_up = F.array_join(F.slice("ws", 1, 4), " ")
    unlike = F.concat_ws(" ", made_up, F.lit("qq zz xx ww vv uu"))
    return rows.select("conv_id", "turn", F.md5(X.grounded_anchor(inside, F.col("text"))).alias("inside"), F.md5(X.grounded_anchor(unlike, F.lit("another text"))).alias("made_up"))


@query("""SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(l, lambda p, i: [lpad(CAST(1000 - length(p) AS VARCHAR), 4, '0'), lpad(CAST(i AS VARCHAR), 4, '0'), p])), lambda x: x[3])[1:4], '#') AS parts FROM (
  SELECT p_partkey, list_filter([p_name, p_brand, p_type, 'a', p_name || ' ' || p_type], lambda p: length(p) >= 6) AS l FROM part)""")
def p24_fragments(spark, sf_dir):
    text = F.concat("p_name", F.lit("; "), "p_brand", F.lit("\n"), "p_type", F.lit(" | a ;"), "p_name", F.lit(" "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.candidate_fragments(text), "#").alias("parts"))


# Arithmetic and totals


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice) AS BIGINT) / l_linenumber AS value FROM lineitem")
def d02_value_of(spark, sf_dir):
    said = F.concat(F.lit("= ("), F.format_number("l_quantity", 0), F.lit(" x £"), F.floor("l_extendedprice"), F.lit(") / "), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", arithmetic.value_of(said).alias("value"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS DOUBLE) END, CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 3 AS DOUBLE) END, CAST(greatest(p_size, 12) AS DOUBLE)) AS marks FROM part")
def a03_max_marks(spark, sf_dir):
    available = F.concat(F.lit("up to "), "p_size", F.lit(" marks of 12"))
    return table(spark, sf_dir, "part").select("p_partkey", finalize.max_marks((F.col("p_size") % 5).cast("double"), (F.col("p_size") % 3).cast("double"), available).alias("marks"))


@query("SELECT l_orderkey, floor(sum(l_quantity) / 8 * 2 + 0.5) / 2 AS half_up, round_even(sum(l_quantity) / 8 / 0.5, 0) * 0.5 AS half_even, round_even(sum(l_quantity) / 8 / 0.25, 0) * 0.25 AS quarter FROM lineitem GROUP BY l_orderkey")
def a02_rounding(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") / 8).alias("s"))
    return s.select("l_orderkey", X.half_up(F.col("s")).alias("half_up"), X.half(F.col("s")).alias("half_even"), X.quarter(F.col("s")).alias("quarter"))
