"""One query for each row guard, each the library's guard over all judged rows of the marking view, with its rule as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import criteria as C
from ..operators import row_guards as G
from .marking_view import VIEW, judged, scripts
from .queries import _NUMBERS_SQL, _STOP_SQL, _VARIANTS_SQL, _norm_sql, query

KEY = ["submission_id", "item_pos"]


def prepared(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return G.prepare(rows, scripts(rows))


def marks(df):
    return df.select(*KEY, "marks_awarded")


def zero_sql(condition: str) -> str:
    return f"{VIEW} SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND coalesce({condition}, false) THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM r"


def set_sql(marks: str) -> str:
    return f"{VIEW} SELECT submission_id, item_pos, {marks} AS marks_awarded FROM r"


def any_sql(values: str, name: str, condition: str) -> str:
    return f"(len(list_filter({values}, lambda {name}: {condition})) > 0)"


def variants_sql(value: str) -> str:
    """Spellings of a figure; ``value`` is a number, floored."""
    return f"list_transform([CAST(floor(abs({value})) AS BIGINT)], lambda v: {_VARIANTS_SQL})[1]"


def in_text_sql(value: str, text: str) -> str:
    """Whether the figure stands in the text as a number of its own."""
    small = f"regexp_matches({text}, '(?i)(^|[^0-9.,])' || s || ' ?(m|mn|million)\\b')"
    plain = f"regexp_matches({text}, '(?i)(^|[^0-9.,])' || replace(s, '.', '\\.') || '($|[^0-9])')"
    return any_sql(variants_sql(value), "s", f"CASE WHEN regexp_matches(s, '^[0-9]{{1,2}}$') THEN {small} ELSE {plain} END")


def words_sql(text: str, pattern: str = "[a-z]{4,}") -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


SAID = "array_to_string(evidence, ' ')"
MARKED = "marks_awarded"


@query(set_sql("round_even(greatest(least(marks_awarded, max_possible), 0.0) / 0.25, 0) * 0.25"))
def f05_clamp(spark, sf_dir):
    return marks(G.clamp(prepared(spark, sf_dir)))


@query(zero_sql("len(evidence) = 0"))
def f06_missing_evidence(spark, sf_dir):
    return marks(G.missing_evidence(prepared(spark, sf_dir)))


_SEARCHABLE = "(length(e) >= 12 OR (regexp_matches(e, '[0-9]') AND length(e) >= 4) OR (regexp_matches(e, '[/%]') AND length(e) >= 3) OR (len(list_filter(string_split(e, ' '), lambda w: w <> '')) <= 3 AND len(list_filter(string_split(e, ' '), lambda w: length(w) >= 7)) > 0))"


def _runs_sql(n: int, most: int) -> str:
    ws = "list_filter(string_split(e, ' '), lambda w: length(w) >= 3)"
    return f"len(list_filter(list_transform(range(1, least({most}, greatest(len({ws}) - {n - 1}, 0)) + 1), lambda i: array_to_string(({ws})[i:i + {n - 1}], ' ')), lambda g: contains(tn, g))) > 0"


_PRESENT = f"(contains(tn, e) OR {_runs_sql(10, 8)} OR {_runs_sql(5, 6)})"
_EVIDENCE_NORM = f"list_transform(evidence, lambda x: {_norm_sql('x')})"


def _norm_view(condition: str) -> str:
    return f"""{VIEW}, t AS (SELECT *, {_norm_sql('text')} AS tn, {_norm_sql('reference')} AS rn, {_EVIDENCE_NORM} AS en FROM r)
SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND coalesce({condition}, false) THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM t"""


@query(_norm_view(f"NOT {any_sql('en', 'e', f'{_SEARCHABLE} AND {_PRESENT}')}"))
def f07_evidence_presence(spark, sf_dir):
    return marks(G.evidence_presence(prepared(spark, sf_dir)))


_OWN = r"(NOT contains(rn, e) OR regexp_matches(e, '[0-9]{3}|[0-9]\.[0-9]{2}') OR len(list_filter(string_split(e, ' '), lambda w: length(w) >= 4)) < 2)"


@query(_norm_view(f"reference <> '' AND NOT {any_sql('en', 'e', _OWN)}"))
def f08_taint(spark, sf_dir):
    return marks(G.taint(prepared(spark, sf_dir)))


_INCOME = r"'(?i)\b(profit|contribution|revenue|income|earning)\b'"
_INCOME_SAID = r"'(?i)\b(profits?|contribution|revenue|income|earnings?|loss|oci|exchange|reserve|comprehensive|nci|eps)\b|p[&/]l|\bpl\b|\bfx\b'"


@query(zero_sql(f"category NOT IN ('journal', 'calculation', 'calc', 'narrative') AND max_possible <= 1 AND regexp_matches(criterion, {_INCOME}) AND NOT regexp_matches({SAID}, {_INCOME_SAID})"))
def f09_income_context(spark, sf_dir):
    return marks(G.income_context(prepared(spark, sf_dir)))


_GROUP_OF = "map {" + ", ".join(f"'{w}': {i}" for w, i in sorted({w: i for i, g in enumerate(C.SYNONYMS) for b in g for w in ([b] if b.endswith("s") else [b, b + "s"])}.items())) + "}"
_ALIGN_STOP = "[" + ", ".join(f"'{w}'" for w in C.ALIGNMENT_STOP) + "]"
#: Of (cn, jn): the words of both, those they share, and synonym groups of the others.
ALIGNED_STEPS = f"""a1 AS (SELECT *, list_distinct(list_filter({words_sql('cn')}, lambda w: NOT list_contains({_ALIGN_STOP}, w))) AS cw, list_distinct({words_sql('jn')}) AS ew FROM a0),
a2 AS (SELECT *, list_filter(cw, lambda w: list_contains(ew, w)) AS same FROM a1),
a3 AS (SELECT *, list_distinct(list_filter(list_transform(list_filter(cw, lambda w: NOT list_contains(same, w)), lambda w: {_GROUP_OF}[w]), lambda g: g IS NOT NULL)) AS cg, list_distinct(list_filter(list_transform(ew, lambda w: {_GROUP_OF}[w]), lambda g: g IS NOT NULL)) AS eg FROM a2),
a4 AS (SELECT *, len(same) + len(list_filter(cg, lambda g: list_contains(eg, g))) AS overlap FROM a3)"""
ALIGNED = rf"""(regexp_matches(cn, '\b[0-9]{{3,}}\b|[£$]|\bgbp\b|^(dr|cr) ') OR (length(cn) < 50 AND len(string_split(cn, ' ')) < 8) OR cn = '' OR (jn <> '' AND (len(cw) = 0 OR (len(ew) <= 1 AND regexp_matches(jn, '[0-9]{{3,}}'))
  OR (len(ew) BETWEEN 2 AND 3 AND regexp_matches(jn, '[0-9]{{3,}}') AND len(list_filter(list_transform(regexp_extract_all(cn, '[0-9][0-9,]*\.?[0-9]*'), lambda x: replace(x, ',', '')), lambda x: length(x) >= 3 AND contains(replace(replace(jn, ',', ''), ' ', ''), x))) > 0)
  OR overlap >= 2 OR (overlap >= 1 AND regexp_matches(jn, '[0-9]')) OR len(list_filter(same, lambda w: length(w) >= 7)) > 0)))"""


@query(f"{VIEW}, a0 AS (SELECT *, {_norm_sql('criterion')} AS cn, {_norm_sql(SAID)} AS jn FROM r), {ALIGNED_STEPS} SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND max_possible < 1 AND NOT regexp_matches(criterion, '[£$]') AND NOT {ALIGNED} THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM a4")
def f10_alignment(spark, sf_dir):
    return marks(G.alignment(prepared(spark, sf_dir)))


_NEGATION_STOP = "[" + ", ".join(f"'{w}'" for w in G.NEGATION_STOP) + "]"
_DENIED = rf"list_filter({words_sql('lower(criterion)')}, lambda w: NOT list_contains({_NEGATION_STOP}, w))[1:6]"


@query(zero_sql(rf"regexp_matches(lower(criterion), '\brequired\b|\bnecessary\b|\bmust\b') AND " + any_sql(_DENIED, "w", rf"regexp_matches(regexp_replace(lower({SAID}), '\bnos?\.?\s+of\b', 'number of', 'g'), '\b(?:no|not)\s+(?:\w+\s+){{0,2}}' || left(w, 7))")))
def f11_negation(spark, sf_dir):
    return marks(G.negation(prepared(spark, sf_dir)))


# Of the view's texts, only the evidence "= n x f" and the scripts' lines of that form are calculations; every row asks for the product of its own figures.
@query(f"""{VIEW}, calc AS (SELECT submission_id, list(p) AS made FROM raw WHERE said = 8 AND NOT withheld GROUP BY submission_id),
t AS (SELECT r.*, made, {_norm_sql('text')} AS tn, {_EVIDENCE_NORM} AS en FROM r LEFT JOIN calc USING (submission_id))
SELECT submission_id, item_pos, CASE WHEN (marks_awarded = 0 AND made IS NOT NULL AND len(list_filter(made, lambda x: abs(x - p) <= greatest(2, 1e-6 * p))) > 0)
  OR (marks_awarded < max_possible AND said = 8 AND {any_sql('en', 'e', f'{_SEARCHABLE} AND {_PRESENT}')}) THEN max_possible ELSE marks_awarded END AS marks_awarded FROM t""")
def f12_calculated(spark, sf_dir):
    from .function_queries import _with_numbers

    rows = prepared(spark, sf_dir).join(_with_numbers(spark, sf_dir), KEY)
    return marks(G.calculated(rows.withColumn("criterion", F.concat(F.lit("Worth GBP"), F.col("n") * F.col("f"), F.lit(" ("), "n", F.lit(" x GBP"), "f", F.lit(")")))))


@query(f"""{VIEW}, t AS (SELECT *, {_norm_sql('text')} AS tn, {_EVIDENCE_NORM} AS en FROM r)
SELECT submission_id, item_pos, CASE WHEN marks_awarded = 0 AND {any_sql('en', 'e', f'{_SEARCHABLE} AND {_PRESENT}')} THEN round_even(max_possible / 2 / 0.25, 0) * 0.25 ELSE marks_awarded END AS marks_awarded FROM t""")
def f14_partial_credit(spark, sf_dir):
    return marks(G.partial_credit(prepared(spark, sf_dir)))


_FIGURES = f"list_filter({_NUMBERS_SQL.format(c=chr(39).join(['regexp_replace(criterion, ', r'\b(?:19|20)[0-9]{2}\b', ', ', '', ', ', 'g', ')']))}, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 2)"
_RESULT_SPELLINGS = "CASE WHEN p % 1000000 = 0 THEN [CAST(p AS VARCHAR), CAST(p // 1000000 AS VARCHAR) || 'm', CAST(p // 1000000 AS VARCHAR) || 'million'] WHEN p % 1000 = 0 AND p >= 10000 THEN [CAST(p AS VARCHAR), CAST(p // 1000 AS VARCHAR) || 'k'] ELSE [CAST(p AS VARCHAR)] END"


@query(f"""{VIEW}, s AS (SELECT *, {SAID} AS sd, {_FIGURES} AS fs FROM r)
SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND marks_awarded >= max_possible AND len(fs) > 0 AND NOT ((regexp_matches(reason, '(?i)\\bown.?figure\\b|\\bof\\b') OR len(of_source_ids) > 0) AND NOT exact_match)
  AND len(list_filter(fs, lambda x: {in_text_sql('CAST(x AS DOUBLE)', 'sd')} OR contains(regexp_replace(sd, '[, ]', '', 'g'), x))) < len(fs)
  AND NOT (kind = 2 AND said = 8) AND NOT (kind = 2 AND {any_sql(_RESULT_SPELLINGS, 'v2', "contains(lower(regexp_replace(sd, '[, ]', '', 'g')), v2)")}) THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM s""")
def f15_strict_numbers(spark, sf_dir):
    return marks(G.strict_numbers(prepared(spark, sf_dir)))


_SALIENT = f"list_distinct(list_filter({_NUMBERS_SQL.format(c='criterion')}, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 2))"


@query(rf"""{VIEW}, s AS (SELECT *, lower({SAID}) AS sd, regexp_extract(lower(criterion), '^(dr|cr)\b', 1) AS side, {_SALIENT} AS fs FROM r),
z AS (SELECT *, CASE WHEN marks_awarded > 0 AND side <> '' AND NOT (CASE WHEN side = 'dr' THEN regexp_matches(sd, '\bdr\b|\bdebit') ELSE regexp_matches(sd, '\bcr\b|\bcredit') END) THEN 0.0 ELSE marks_awarded END AS m FROM s)
SELECT submission_id, item_pos, CASE WHEN side <> '' AND len(fs) > 0 AND m >= max_possible AND max_possible > 0.25 AND NOT {any_sql('fs', 'x', in_text_sql('CAST(x AS DOUBLE)', 'sd'))}
  THEN greatest(0.25, least(round_even(max_possible / 2 / 0.25, 0) * 0.25, max_possible - 0.25)) ELSE m END AS marks_awarded FROM z""")
def f16_journal_direction(spark, sf_dir):
    return marks(G.journal_direction(prepared(spark, sf_dir)))


_CRITERION_WORDS = f"list_filter(list_filter(regexp_extract_all(lower(criterion), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({_STOP_SQL}, w)), lambda w: NOT regexp_matches(w, '[0-9]'))"


@query(rf"""{VIEW}, s AS (SELECT *, regexp_extract(lower(criterion), '^(dr|cr)\b', 1) AS side, {_SALIENT} AS fs, {_CRITERION_WORDS} AS ws FROM r)
SELECT submission_id, item_pos, CASE WHEN side <> '' AND marks_awarded = 0 AND len(list_filter(string_split(lower(text), chr(10)), lambda line: regexp_matches(line, '\b' || side || '\b')
  AND {any_sql('fs', 'x', in_text_sql('CAST(x AS DOUBLE)', 'line'))} AND {any_sql('ws', 'w', 'contains(line, w)')})) > 0 THEN max_possible ELSE marks_awarded END AS marks_awarded FROM s""")
def f17_journal_line(spark, sf_dir):
    return marks(G.journal_line(prepared(spark, sf_dir)))


@query(f"{VIEW} SELECT submission_id, item_pos, marks_awarded > 0 AND marks_awarded < max_possible AND category IN ('calculation', 'calc', 'journal') AS is_of_mark FROM r")
def f18_own_figure_flag(spark, sf_dir):
    return G.own_figure_flag(prepared(spark, sf_dir)).select(*KEY, "is_of_mark")


@query(rf"""{VIEW}, e AS (SELECT submission_id, item_pos, e, i, row_number() OVER (PARTITION BY submission_id, item_pos, lower(regexp_replace(e, '[ \t|]+', '', 'g')) ORDER BY i) AS k
  FROM (SELECT submission_id, item_pos, unnest(evidence) AS e, unnest(range(1, len(evidence) + 1)) AS i FROM r)),
d AS (SELECT submission_id, item_pos, string_agg(e, ' / ' ORDER BY i) AS kept FROM e WHERE k = 1 GROUP BY 1, 2)
SELECT submission_id, item_pos, coalesce(kept, '') AS kept FROM r LEFT JOIN d USING (submission_id, item_pos)""")
def f19_distinct_evidence(spark, sf_dir):
    return G.distinct_evidence(prepared(spark, sf_dir)).select(*KEY, F.array_join("evidence", " / ").alias("kept"))


@query(f"{VIEW} SELECT submission_id, item_pos FROM r WHERE marks_awarded > 0 OR contains(reason, 'Marks given above/below')")
def f20_displayed(spark, sf_dir):
    return G.displayed(prepared(spark, sf_dir)).select(*KEY)
