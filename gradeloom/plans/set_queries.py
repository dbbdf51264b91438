"""One query for each set guard and its joins, each the library's operator over the marking view, with its rule as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import criteria as C
from ..operators import finalize, recovery
from ..operators import set_guards as S
from .guard_queries import KEY, SAID, any_sql, in_text_sql, marks, prepared, variants_sql, words_sql
from .marking_view import VIEW
from .queries import _norm_sql, query

_KEY_SQL = _norm_sql("replace(array_to_string(evidence, ' '), '|', ' ')")
_COMMON = "[" + ", ".join(f"'{w}'" for w in S.COMMON_WORDS) + "]"
_ROWS = ["12,500 | 16,500", "12,500 | 16,500 | 4,000", "12,500 | 16,500 | 4,000 | 9,000 | 7,250 | 31"]


def _tabled(df):
    """Evidence that repeats: rows of a table, each the start of the next, but for rows with a statement."""
    row = F.element_at(F.array(*map(F.lit, _ROWS)), (F.col("item_pos") % 3 + 1).cast("int"))
    return df.withColumn("evidence", F.when(F.col("criterion").rlike("[0-9]"), F.array(row)).otherwise(F.col("evidence")))


_TABLED_SQL = f"{VIEW}, r2 AS (SELECT * REPLACE (CASE WHEN regexp_matches(criterion, '[0-9]') THEN [(['{_ROWS[0]}', '{_ROWS[1]}', '{_ROWS[2]}'])[item_pos % 3 + 1]] ELSE evidence END AS evidence) FROM r)"
_HOMES_SQL = f"""{_TABLED_SQL}, k AS (SELECT *, {_KEY_SQL} AS key FROM r2),
live AS (SELECT DISTINCT submission_id, key FROM k WHERE marks_awarded > 0 AND length(key) >= {S.LEAST_KEY}),
par AS (SELECT submission_id, key, parent FROM (SELECT a.submission_id, a.key, b.key AS parent, row_number() OVER (PARTITION BY a.submission_id, a.key ORDER BY length(b.key), b.key DESC) AS n
  FROM live a JOIN live b ON a.submission_id = b.submission_id AND length(b.key) > length(a.key) AND length(b.key) <= {S.MOST_RATIO} * length(a.key) AND contains(b.key, a.key)) WHERE n = 1),
chase AS (SELECT submission_id, key, key AS top FROM live UNION ALL SELECT c.submission_id, c.key, p.parent FROM chase c JOIN par p ON p.submission_id = c.submission_id AND p.key = c.top),
home AS (SELECT submission_id, key, arg_max(top, length(top)) AS home FROM chase GROUP BY 1, 2)"""


@query(f"{_HOMES_SQL} SELECT submission_id, md5(key) AS key, md5(home) AS home FROM home")
def j07_duplicate_groups(spark, sf_dir):
    return S.duplicate_groups(_tabled(prepared(spark, sf_dir))).select("submission_id", F.md5("key").alias("key"), F.md5("home").alias("home"))


def _prose(c: str) -> str:
    return f"(CASE WHEN length(regexp_replace({c}, '[ \t\n\r]', '', 'g')) > 0 THEN length(regexp_replace({c}, '[^0-9]', '', 'g')) / length(regexp_replace({c}, '[ \t\n\r]', '', 'g')) ELSE 0 END <= 0.35)"


def _content(c: str) -> str:
    return f"list_filter(list_distinct({words_sql(f'lower({c})')}), lambda w: NOT list_contains({_COMMON}, w))"


_DUPLICATES_SQL = f"""{_HOMES_SQL},
h AS (SELECT k.*, home, strpos(lower(text), lower(trim(evidence[1]))) AS place FROM k LEFT JOIN home USING (submission_id, key)),
g AS (SELECT *, first_value(struct_pack(item_pos := item_pos, comp := of_component_of, head := column_header, cat := category, criterion := criterion, key := key, place := place)) OVER (PARTITION BY submission_id, home
  ORDER BY of_component_of IS NOT NULL DESC, max_possible DESC, marks_awarded DESC, item_pos) AS kp FROM h WHERE home IS NOT NULL AND marks_awarded > 0),
lost AS (SELECT submission_id, item_pos, kp FROM g WHERE kp.item_pos <> item_pos AND of_component_of IS NULL AND kp.comp IS NULL AND NOT coalesce(column_header <> kp.head, false) AND NOT {_prose('kp.key')} AND NOT {_prose('key')}
  AND (category = 'journal') = (kp.cat = 'journal') AND (key <> kp.key OR len(list_intersect({_content('criterion')}, {_content('kp.criterion')})) >= 2))"""


@query(f"""{_DUPLICATES_SQL} SELECT h.submission_id, h.item_pos, CASE WHEN l.item_pos IS NOT NULL THEN 0.0 ELSE marks_awarded END AS marks_awarded,
  CASE WHEN l.item_pos IS NULL THEN 0 WHEN h.place > 0 AND h.place = l.kp.place THEN 3 WHEN l.kp.place > coalesce(h.place, 0) THEN 2 ELSE 1 END AS side
FROM h LEFT JOIN lost l USING (submission_id, item_pos)""")
def g01_duplicates(spark, sf_dir):
    out = S.duplicates(_tabled(prepared(spark, sf_dir)))
    fired = F.exists("audit", lambda a: a["guard"] == "G1")
    side = F.when(~fired, 0).when(F.contains("reason", F.lit("Credited once")), 3).when(F.contains("reason", F.lit("given below,")), 2).otherwise(1)
    return out.select(*KEY, "marks_awarded", side.alias("side"))


_CITING_SQL = f"""{VIEW}, c AS (SELECT *, CASE WHEN item_pos > 0 AND item_pos % 2 = 1 THEN 0.0 ELSE marks_awarded END AS m, CASE WHEN item_pos > 0 AND item_pos % 2 = 1 THEN
    lag(criterion) OVER (PARTITION BY submission_id ORDER BY item_pos) END AS cited FROM r),
q AS (SELECT *, lower(trim(left(left(replace(cited, '''', ' '), 60), 40))) AS prefix FROM c WHERE length(left(replace(cited, '''', ' '), 60)) BETWEEN 5 AND 80),
sib AS (SELECT q.submission_id, q.item_pos, min(o.item_pos) AS sibling FROM q JOIN c o ON o.submission_id = q.submission_id AND starts_with(lower(replace(o.criterion, '''', ' ')), q.prefix) WHERE prefix <> '' GROUP BY 1, 2)"""


def _citing(spark, sf_dir):
    """Every second row has lost its marks to the row before it, whose criterion its reason cites."""
    from pyspark.sql import Window

    rows = prepared(spark, sf_dir)
    odd = F.col("item_pos") % 2 == 1
    before = F.lag("criterion").over(Window.partitionBy("submission_id").orderBy("item_pos"))
    why = F.concat(F.lit("Marks given above/below: Marks given above, credited for '"), F.left(F.translate(before, "'", " "), F.lit(60)), F.lit("'."))
    return rows.withColumns({"reason": F.when(odd, why).otherwise(""), "marks_awarded": F.when(odd, 0.0).otherwise(F.col("marks_awarded"))})


@query(f"{_CITING_SQL} SELECT submission_id, item_pos, sibling FROM sib")
def j10_cited_sibling(spark, sf_dir):
    return S.cited_sibling(_citing(spark, sf_dir)).select(*KEY, "sibling")


@query(f"""{_CITING_SQL} SELECT c.submission_id, c.item_pos, CASE WHEN s.sibling IS NOT NULL AND c.of_component_of IS NOT NULL AND o.of_component_of IS NOT NULL AND c.of_component_of <> o.of_component_of THEN c.max_possible ELSE c.m END AS marks_awarded
FROM c LEFT JOIN sib s USING (submission_id, item_pos) LEFT JOIN c o ON o.submission_id = c.submission_id AND o.item_pos = s.sibling""")
def g02_restore(spark, sf_dir):
    return marks(S.restore(_citing(spark, sf_dir)))


@query(f"""{VIEW} SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND fires THEN 0.0 ELSE marks_awarded END AS marks_awarded, marks_awarded > 0 AND fires AS blocked FROM (
  SELECT *, kind = 8 AND len(of_source_ids) = 0 AND len(evidence) > 0 AND NOT (contains(regexp_replace({SAID}, '[, \t]', '', 'g'), CAST(p AS VARCHAR)) OR {in_text_sql('p', SAID)}) AS fires FROM r)""")
def g03_parent_calculation(spark, sf_dir):
    return S.parent_calculation(prepared(spark, sf_dir)).select(*KEY, "marks_awarded", "blocked")


@query(f"""{VIEW} SELECT submission_id, unnest(of_source_ids) AS aggregate, item_pos FROM judged""")
def j11_consumers(spark, sf_dir):
    return recovery.consumers(prepared(spark, sf_dir)).select("submission_id", "aggregate", "item_pos")


_DEDUCTION = any_sql(variants_sql("expected_amount"), "s", f"regexp_matches({SAID}, '(?i)\\([£$€]? ?' || replace(s, '.', '\\.') || '(?:m|k)?\\)|\\b(?:less|deduct|minus)\\b[^0-9\n]{{0,40}}[£$€]?' || replace(s, '.', '\\.') || '($|[^0-9])')")


@query(f"{VIEW} SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND sign_sensitive AND expected_amount > 0 AND {_DEDUCTION} THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM r")
def g05_sign(spark, sf_dir):
    return marks(S.sign(prepared(spark, sf_dir)))


@query(f"{VIEW} SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND item_pos % 3 <> 0 AND ((column_header = 'NCI' AND item_pos % 2 = 0) OR (column_header = 'Total' AND item_pos % 2 = 1)) THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM r")
def g06_column(spark, sf_dir):
    """The figure stands under the total, under the other interest, or, in every third row, under both."""
    rows = prepared(spark, sf_dir)
    figure = F.col("expected_amount").cast("long")
    low = F.when((F.col("item_pos") % 2 == 1) | (F.col("item_pos") % 3 == 0), figure).otherwise(F.lit(77))
    high = F.when((F.col("item_pos") % 2 == 0) | (F.col("item_pos") % 3 == 0), figure).otherwise(F.lit(77))
    cells = F.concat(F.lit("Row | "), low, F.lit(" | 5 | "), high)
    table = rows.withColumns({"text": F.concat(F.lit("Item | Non-controlling interest | Retained earnings | Total equity\n"), "text"), "column": F.col("column_header"), "evidence": F.array(F.lit("no table here"), F.lit("Other | 1 | 2 | 3"), cells)})
    return marks(S.column(table))


_FOCUS_STOP = "[" + ", ".join(f"'{w}'" for w in C.FOCUS_STOP) + "]"
_WORDS3 = "list_transform(regexp_extract_all({c}, '[A-Za-z]{{3,}}'), lambda w: lower(w))"
_MEETS = "len(list_filter({heads}, lambda o: starts_with(o, left(t, 5)) OR starts_with(t, left(o, 5)))) > 0"


@query(f"""{VIEW}, b AS (SELECT submission_id, grp, item_pos, list_distinct(list_filter({_WORDS3.format(c='criterion_focus')}, lambda w: NOT list_contains({_FOCUS_STOP}, w))) AS said_w, {_WORDS3.format(c='criterion')} AS mine
  FROM (SELECT *, CASE WHEN item_pos % 2 = 0 THEN lag(criterion) OVER (PARTITION BY submission_id, grp ORDER BY item_pos) ELSE criterion END AS criterion_focus FROM r)),
p AS (SELECT a.submission_id, a.item_pos, o.item_pos AS rival, len(list_filter(a.said_w, lambda t: ({_MEETS.format(heads='a.mine')}) <> ({_MEETS.format(heads='o.mine')}))) AS n,
  len(list_filter(a.said_w, lambda t: NOT ({_MEETS.format(heads='a.mine')}) AND ({_MEETS.format(heads='o.mine')}))) AS other, len(list_filter(a.said_w, lambda t: {_MEETS.format(heads='o.mine')})) AS whole
  FROM b a JOIN b o ON a.submission_id = o.submission_id AND a.grp = o.grp AND a.item_pos <> o.item_pos WHERE len(a.said_w) >= 2),
f AS (SELECT submission_id, item_pos, max(CASE WHEN n > 0 THEN other / n END) AS share, max((whole, -rival)) AS x FROM p GROUP BY 1, 2)
SELECT submission_id, item_pos, CASE WHEN share >= 0.70 AND 1 - share <= 0.40 THEN -x[2] END AS focus_rival FROM r LEFT JOIN f USING (submission_id, item_pos)""")
def g07_focus(spark, sf_dir):
    """Every second row's judge speaks of the row before it in its group."""
    from pyspark.sql import Window

    before = F.lag("criterion").over(Window.partitionBy("submission_id", "group").orderBy("item_pos"))
    rows = prepared(spark, sf_dir).withColumn("criterion_focus", F.when(F.col("item_pos") % 2 == 0, before).otherwise(F.col("criterion")))
    return S.focus(rows).select(*KEY, "focus_rival")


_SECTION_SQL = rf"""{VIEW}, ln AS (SELECT submission_id, ls[i] AS line, i FROM (SELECT submission_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM script)),
nl AS (SELECT submission_id, regexp_replace(lower(line), '[ \t\n\r,;|]+', '', 'g') AS line, CAST(count(*) FILTER (WHERE regexp_matches(trim(line), '^---.*---$')) OVER (PARTITION BY submission_id ORDER BY i) AS INTEGER) AS section FROM ln),
keys AS (SELECT DISTINCT submission_id, item_pos, key FROM (SELECT submission_id, item_pos, regexp_replace(lower(unnest(evidence)), '[ \t\n\r,;|]+', '', 'g') AS key FROM r) WHERE length(key) >= 8),
hit AS (SELECT k.submission_id, item_pos, min(section) AS section FROM keys k JOIN nl ON nl.submission_id = k.submission_id AND contains(nl.line, k.key) GROUP BY 1, 2 HAVING count(DISTINCT section) = 1),
sec AS (SELECT r.*, hit.section FROM r LEFT JOIN hit USING (submission_id, item_pos))"""


@query(f"{_SECTION_SQL} SELECT submission_id, item_pos, section FROM sec")
def j06_locate(spark, sf_dir):
    return S.locate(prepared(spark, sf_dir)).select(*KEY, "section")


@query(f"""{_SECTION_SQL}, w AS (SELECT *, count(*) FILTER (WHERE marks_awarded > 0 AND section IS NOT NULL) OVER (PARTITION BY submission_id) AS n_all, count(*) FILTER (WHERE marks_awarded > 0 AND section IS NOT NULL) OVER (PARTITION BY submission_id, section) AS here FROM sec),
home AS (SELECT *, max(CASE WHEN 2 * here > n_all THEN section END) OVER (PARTITION BY submission_id) AS home FROM w)
SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND n_all >= 3 AND section IS NOT NULL AND section <> home THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM home""")
def g08_locality(spark, sf_dir):
    # One group for a script, so that scripts of seven rows have majorities.
    return marks(S.locality(S.locate(prepared(spark, sf_dir).withColumn("group", F.lit("g")))))


_ABSENT = r"(?i)\b(?:no\s+\w+.{0,40}?(?:present|shown|given|calculated|provided)|not\s+(?:present|shown|stated|provided|calculated|performed|attempted)|does\s+not\s+appear|never\s+(?:shown|stated|calculated)|absent\s+from)"


@query(f"{VIEW} SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND max_possible > 0 AND marks_awarded >= max_possible AND regexp_matches(reason, '{_ABSENT}') AND NOT contains(lower(reason), 'aggregate recovery') THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM r")
def g09_contradiction(spark, sf_dir):
    return marks(S.contradiction(prepared(spark, sf_dir)))


_SMALL = "CASE WHEN max_possible > 0 AND max_possible <= 0.5 AND position IS NOT NULL THEN {c} ELSE 0 END"


@query(f"""{VIEW}, w AS (SELECT *, sum({_SMALL.format(c='max_possible')}) OVER x - sum({_SMALL.format(c='max_possible')}) OVER y AS possible, sum({_SMALL.format(c='marks_awarded')}) OVER x - sum({_SMALL.format(c='marks_awarded')}) OVER y AS earned FROM r
  WINDOW x AS (PARTITION BY submission_id ORDER BY position RANGE BETWEEN 18 PRECEDING AND 18 FOLLOWING), y AS (PARTITION BY submission_id, position))
SELECT submission_id, item_pos, CASE WHEN marks_awarded > 0 AND position IS NOT NULL AND NOT regexp_matches(criterion, '[0-9]') AND max_possible BETWEEN 1 AND 2 AND possible >= 0.75 * max_possible AND earned < 0.8 * possible THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM w""")
def g10_broad_gating(spark, sf_dir):
    return marks(S.broad_gating(prepared(spark, sf_dir)))


@query(f"""{VIEW}, c AS (SELECT submission_id, item_pos, marks_awarded, coalesce(position, 1000000) AS position, {_norm_sql('CASE WHEN item_pos % 3 = 0 THEN every ELSE criterion END')} AS norm
  FROM (SELECT *, string_agg(criterion, '; ' ORDER BY item_pos) OVER (PARTITION BY submission_id ORDER BY item_pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM r)),
l AS (SELECT submission_id, list(struct_pack(item_pos := item_pos, norm := norm) ORDER BY position, item_pos) AS items FROM c WHERE marks_awarded > 0 AND norm <> '' GROUP BY submission_id),
step AS (SELECT submission_id, items, 0 AS i, CAST([] AS INTEGER[]) AS gone FROM l
  UNION ALL SELECT submission_id, items, i + 1, CASE WHEN length(items[i + 1].norm) >= 40 AND len(list_filter(items, lambda y: y.item_pos <> items[i + 1].item_pos AND NOT list_contains(gone, y.item_pos) AND contains(items[i + 1].norm, y.norm) AND length(y.norm) < 0.85 * length(items[i + 1].norm))) >= 2
    THEN list_append(gone, items[i + 1].item_pos) ELSE gone END FROM step WHERE i < len(items)),
last AS (SELECT submission_id, gone FROM step WHERE i = len(items))
SELECT c.submission_id, c.item_pos, CASE WHEN marks_awarded > 0 AND coalesce(list_contains(gone, c.item_pos), false) THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM c LEFT JOIN last USING (submission_id)""")
def g11_superset(spark, sf_dir):
    from pyspark.sql import Window

    rows = prepared(spark, sf_dir)
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "criterion")).over(Window.partitionBy("submission_id"))), lambda x: x["criterion"]), "; ")
    return marks(S.superset(rows.withColumn("every", every).withColumn("criterion", F.when(F.col("item_pos") % 3 == 0, F.col("every")).otherwise(F.col("criterion")))))


@query(f"""{VIEW}, k AS (SELECT *, list_distinct(list_filter(list_transform(evidence, lambda x: {_norm_sql('x')}), lambda e: length(e) >= 20)) AS ks FROM r),
o AS (SELECT submission_id, list({{'item_pos': item_pos, 'ks': ks}} ORDER BY marks_awarded DESC, item_pos) AS items FROM k WHERE marks_awarded > 0 GROUP BY submission_id),
step AS (SELECT submission_id, items, 0 AS i, CAST([] AS VARCHAR[]) AS claimed, CAST([] AS INTEGER[]) AS gone FROM o
  UNION ALL SELECT submission_id, items, i + 1, list_concat(claimed, CASE WHEN met > 0 THEN (items[i + 1].ks)[1:met - 1] ELSE items[i + 1].ks END), CASE WHEN met > 0 THEN list_append(gone, items[i + 1].item_pos) ELSE gone END
  FROM (SELECT *, coalesce(list_position(list_transform(items[i + 1].ks, lambda k: list_contains(claimed, k)), true), 0) AS met FROM step WHERE i < len(items))),
last AS (SELECT submission_id, gone FROM step WHERE i = len(items))
SELECT r.submission_id, r.item_pos, CASE WHEN marks_awarded > 0 AND coalesce(list_contains(gone, r.item_pos), false) THEN 0.0 ELSE marks_awarded END AS marks_awarded FROM r LEFT JOIN last USING (submission_id)""")
def g12_reuse(spark, sf_dir):
    return marks(S.reuse(prepared(spark, sf_dir)))


@query(f"""{VIEW} SELECT submission_id, item_pos, row_number() OVER (PARTITION BY submission_id ORDER BY coalesce(position, 1000000), item_pos) AS rubric_rank FROM r""")
def w03_rubric_order(spark, sf_dir):
    return finalize.rubric_order(prepared(spark, sf_dir)).select(*KEY, F.col("rubric_rank").cast("long").alias("rubric_rank"))


_FOLD = r"regexp_replace({c}, '[ \t\n\r,;|]+', '', 'g')"
_RECOVERY_SQL = rf"""{VIEW},
z AS (SELECT * REPLACE (CASE WHEN item_pos % 2 = 0 AND of_component_of IS NOT NULL THEN 0.0 ELSE marks_awarded END AS marks_awarded) FROM r),
ln AS (SELECT submission_id, ls[i] AS line, i FROM (SELECT submission_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM script)),
sn AS (SELECT *, regexp_matches(line, '^[ \t]*-{{3,}}.*-{{3,}}[ \t]*$') AS head, count(*) FILTER (WHERE regexp_matches(line, '^[ \t]*-{{3,}}.*-{{3,}}[ \t]*$')) OVER (PARTITION BY submission_id ORDER BY i) AS sec FROM ln),
bodies AS (SELECT submission_id, sec, string_agg(line, chr(10) ORDER BY i) AS body FROM sn WHERE NOT head GROUP BY 1, 2),
made AS (SELECT submission_id, of_component_of AS agg, list_sort(list_distinct(list(CAST(of_produces AS BIGINT)))) AS figures FROM z WHERE of_component_of IS NOT NULL GROUP BY 1, 2),
says AS (SELECT submission_id, of_component_of AS agg, unnest(evidence) AS e FROM z WHERE of_component_of IS NOT NULL AND marks_awarded > 0
  UNION ALL SELECT submission_id, agg, unnest(evidence) FROM (SELECT submission_id, unnest(of_source_ids) AS agg, evidence FROM z WHERE marks_awarded > 0)),
places AS (SELECT s.submission_id, s.agg, s.e, min(sec) AS sec FROM (SELECT DISTINCT * FROM says) s JOIN bodies b ON b.submission_id = s.submission_id AND length({_FOLD.format(c='s.e')}) >= 8 AND contains(lower({_FOLD.format(c='b.body')}), lower({_FOLD.format(c='s.e')})) GROUP BY 1, 2, 3 HAVING count(DISTINCT sec) = 1),
scope AS (SELECT submission_id, agg, min(sec) AS sec FROM places GROUP BY 1, 2 HAVING count(DISTINCT sec) = 1),
taken AS (SELECT m.submission_id, m.agg, list({_FOLD.format(c='e')}) AS lines FROM made m JOIN (SELECT submission_id, coalesce(of_component_of, '') AS agg, unnest(evidence) AS e FROM z WHERE marks_awarded > 0) p ON p.submission_id = m.submission_id AND p.agg <> m.agg GROUP BY 1, 2),
subs AS (SELECT m.submission_id, m.agg, body, coalesce(t.lines, CAST([] AS VARCHAR[])) AS taken, unnest(list_transform(range(1, CAST(pow(2, len(figures)) AS BIGINT)), lambda b: list_filter(figures, lambda x, i: (b >> (i - 1)) & 1 = 1))) AS s
  FROM made m JOIN scope USING (submission_id, agg) JOIN bodies USING (submission_id, sec) LEFT JOIN taken t USING (submission_id, agg)),
shown AS (SELECT submission_id, agg, s, taken, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda line: line <> '' AND NOT regexp_matches(line, '(?i)^\s*(?:debit|credit|dr\b|cr\b)\b') AND {in_text_sql('list_sum(s)', 'line')})[1] AS line FROM subs),
found AS (SELECT submission_id, agg, s FROM shown WHERE line IS NOT NULL AND (len(s) > 1 OR NOT list_contains(taken, {_FOLD.format(c='line')}))),
tried AS (SELECT submission_id, agg FROM found GROUP BY 1, 2 HAVING count(*) FILTER (WHERE len(s) > 1) > 0 OR count(*) FILTER (WHERE len(s) = 1) > 1),
own AS (SELECT z.submission_id, z.item_pos, bool_or(len(s) = 1) AS alone, max(struct_pack(n := len(s), total := list_sum(s), members := s)) AS best FROM z JOIN tried ON tried.submission_id = z.submission_id AND tried.agg = z.of_component_of JOIN found ON found.submission_id = z.submission_id AND found.agg = z.of_component_of AND list_contains(s, CAST(z.of_produces AS BIGINT)) GROUP BY 1, 2),
due AS (SELECT z.*, coalesce(alone, false) AS alone, best, CASE WHEN marks_awarded = 0 AND max_possible > 0 AND own.item_pos IS NOT NULL AND NOT contains(lower(reason), 'marks given above/below') THEN CASE WHEN alone THEN max_possible ELSE least(0.25, max_possible) END ELSE 0.0 END AS due
  FROM z LEFT JOIN own USING (submission_id, item_pos)),
got AS (SELECT *, CASE WHEN of_component_of IS NOT NULL AND due > 0 THEN greatest(0.0, least(due, 1.5 - coalesce(sum(due) OVER (PARTITION BY submission_id, of_component_of ORDER BY alone DESC, item_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0.0 END AS got FROM due)"""


def _recovery_rows(spark, sf_dir):
    """Every second row of an aggregate has no marks yet."""
    rows = prepared(spark, sf_dir)
    return rows.withColumn("marks_awarded", F.when((F.col("item_pos") % 2 == 0) & F.col("of_component_of").isNotNull(), 0.0).otherwise(F.col("marks_awarded")))


@query(f"{_RECOVERY_SQL} SELECT submission_id, item_pos, marks_awarded + got AS marks_awarded, got > 0 AS recovered, CASE WHEN got > 0 THEN array_to_string(best.members, ',') END AS subset FROM got")
def g04_recovery(spark, sf_dir):
    rows = _recovery_rows(spark, sf_dir)
    out = recovery.recover(rows, rows.select("submission_id", "text").dropDuplicates(["submission_id"]))
    return out.select(*KEY, "marks_awarded", "recovered", F.array_join(F.col("subset").cast("array<string>"), ",").alias("subset"))


@query(f"""{_RECOVERY_SQL}, m AS (SELECT submission_id, item_pos, marks_awarded + got AS marks, max_possible, of_component_of, CASE WHEN got > 0 AND len(best.members) > 1 THEN array_to_string(best.members, ',') END AS k FROM got),
mk AS (SELECT *, k IS NOT NULL AND count(*) OVER x >= 2 AND count(*) FILTER (WHERE marks > 0) OVER x >= 2 AS joined FROM m WINDOW x AS (PARTITION BY submission_id, of_component_of, k))
SELECT submission_id, min(item_pos) AS item_pos, sum(marks) AS marks_awarded, sum(max_possible) AS max_possible, count(*) AS parts FROM mk WHERE joined GROUP BY submission_id, of_component_of, k
UNION ALL SELECT submission_id, item_pos, marks, max_possible, 0 FROM mk WHERE NOT joined""")
def a10_merge_components(spark, sf_dir):
    rows = _recovery_rows(spark, sf_dir)
    out = recovery.merge_components(recovery.recover(rows, rows.select("submission_id", "text").dropDuplicates(["submission_id"])))
    return out.select(*KEY, "marks_awarded", "max_possible", F.coalesce(F.size("components"), F.lit(0)).cast("long").alias("parts"))
