"""Queries of the remaining marking operators: sources, rubrics, resolution, totals, holistic marking, layout, restatements, judges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import finalize, holistic, judge, resolve, restatements, rubric
from ..sources import tables
from .function_queries import _stem_sql
from .guard_queries import KEY, in_text_sql, prepared
from .marking_view import VIEW, judged, scripts
from .queries import _SENTENCES_SQL, _STOP_SQL, _norm_sql, query, table


def text(c):
    return F.col(c).cast("string")


# Sources and parsing


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_answer_id, CASE WHEN p_partkey % 6 = 0 THEN 'Untitled' ELSE p_name END AS question_title, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size % 4 AS VARCHAR) WHEN p_size % 3 <> 0 THEN CAST(p_size % 3 AS VARCHAR) ELSE '?' END AS total_marks, p_type AS description FROM part")
def s01_question_list(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 6 == 0, F.when(F.col("p_partkey") % 12 == 0, " ")).otherwise(F.col("p_name"))
    return tables.question_list(p.select(text("p_partkey").alias("model_answer_id"), title.alias("question_title"), (F.col("p_size") % 4).alias("max_marks"), (F.col("p_size") % 3).alias("total_marks"), F.col("p_type").alias("description")))


@query("SELECT o_orderkey AS id, c_name AS student, o_orderpriority AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def s02_lookup(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumn("extra", F.lit("unused"))
    found = tables.lookup(tables.pruned(customers, ["c_custkey", "c_name", "no such column"]), "c_custkey", orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority"))
    return found.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("student"), F.col("o_orderpriority").alias("title"))


@query("SELECT l_orderkey AS submission_id, l_suppkey AS grade_id, l_partkey AS model_answer_id, s_name AS grade, p_name AS model FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey")
def s04_load(spark, sf_dir):
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("submission_id"), F.col("l_suppkey").alias("grade_id"), F.col("l_partkey").alias("model_answer_id")).distinct()
    students = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission_id"))
    grades = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grade_id"), F.col("s_name").alias("grade"))
    models = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_answer_id"), F.col("p_name").alias("model"))
    return tables.load(jobs, students, models, grades).select("submission_id", "grade_id", "model_answer_id", "grade", "model")


@query("SELECT event_id % 2 = 0 AND value > 50 AS good, count(*) AS n FROM events GROUP BY 1")
def s07_quarantine(spark, sf_dir):
    good, bad = tables.quarantine(table(spark, sf_dir, "events"), (F.col("event_id") % 2 == 0) & F.when(F.col("value").isNotNull(), F.col("value") > 50))
    return good.agg(F.count("*").alias("n")).select(F.lit(True).alias("good"), "n").union(bad.agg(F.count("*").alias("n")).select(F.lit(False).alias("good"), "n")).filter("n > 0")


@query("SELECT event_id, event_type AS question, event_id % 5 AS pages, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x' || user_id END AS student_name FROM events WHERE event_id % 4 <> 0")
def s17_validated(spark, sf_dir):
    doc = F.to_json(F.struct(F.col("event_type").alias("question"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("x"), "user_id")).alias("student_name"), F.lit(1).alias("odd"), F.array(F.struct(F.lit("1").alias("question_number"), F.lit("a").alias("answer"))).alias("sub_parts"), F.sequence(F.lit(1), F.lit(5)).alias("pages")))
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, doc).otherwise("{broken").alias("value"))
    good, _ = tables.parsed(lines)
    return good.select("event_id", "question", (F.size("pages") - 5 + F.col("event_id") % 5).alias("pages"), "student_name")


_LABELS = ["a)", "4.2", "B.", "(c)", "5", "intro"]


@query(f"""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations),
l AS (SELECT conv_id, pos, ([{', '.join("'" + x + "'" for x in _LABELS)}])[CAST((conv_id + pos) % 6 + 1 AS INTEGER)] AS label FROM p),
n AS (SELECT *, last_value(CASE WHEN regexp_matches(label, '^[0-9]') THEN label END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos) AS held FROM l)
SELECT conv_id, CAST(pos AS INTEGER) AS pos, CASE WHEN label IN ('a)', 'B.', '(c)') THEN coalesce(held, '4.1') || '(' || regexp_extract(label, '[A-Za-z]') || ')' ELSE label END AS full_label FROM n""")
def p12_letter_labels(spark, sf_dir):
    return tables.letter_labels(_parts(spark, sf_dir), "4").select(F.col("submission_id").alias("conv_id"), "pos", "full_label")


def _parts(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("submission_id"), pos.alias("pos"), F.col("text").alias("answer"))
    return c.withColumn("label", F.element_at(F.array(*map(F.lit, _LABELS)), ((F.col("submission_id") + F.col("pos")) % 6 + 1).cast("int")))


_PARTS_SQL = f"""WITH p AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations),
l AS (SELECT conv_id, pos, text, ([{', '.join("'" + x + "'" for x in _LABELS)}])[CAST((conv_id + pos) % 6 + 1 AS INTEGER)] AS label FROM p),
q AS (SELECT *, last_value(CASE WHEN regexp_matches(label, '[0-9]') THEN regexp_extract(label, '([0-9]+)', 1) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos) AS q FROM l)"""


@query(_PARTS_SQL + " SELECT conv_id, md5(string_agg('--- ' || label || ' ---' || chr(10) || text, chr(10) ORDER BY pos)) AS digest FROM l GROUP BY conv_id")
def p13_flat_text(spark, sf_dir):
    return tables.flat_text(_parts(spark, sf_dir)).select(F.col("submission_id").alias("conv_id"), F.md5("text").alias("digest"))


@query(_PARTS_SQL + " SELECT conv_id, CAST(pos AS INTEGER) AS pos FROM q WHERE coalesce(q, '4') = '4'")
def p13_question_block(spark, sf_dir):
    return tables.question_block(_parts(spark, sf_dir), "4").select(F.col("submission_id").alias("conv_id"), "pos")


@query("SELECT event_id, 0 AS item_pos, event_type AS criterion, CAST(event_id % 9 AS DOUBLE) AS marks_awarded, 'one / two ' || (event_id % 9) AS evidence FROM events WHERE event_id % 5 <> 0")
def p17_judged(spark, sf_dir):
    e = F.col("event_id")
    row = F.struct(F.col("event_type").alias("criterion"), (e % 9).alias("marks_awarded"), F.concat(F.lit("one;two "), e % 9).alias("evidence"))
    grades = F.array(F.struct(F.lit("1").alias("question_number"), F.array(row).alias("breakdown")))
    doc = F.to_json(F.struct(F.when(e % 3 == 0, F.to_json(grades)).otherwise(None).alias("grades"))).alias("x")
    plain = F.to_json(F.struct(grades.alias("grades")))
    said = F.when(e % 5 == 0, "I can not say.").when(e % 3 == 0, doc).otherwise(F.concat(F.lit("```json\n"), plain, F.lit("\n``` ok")))
    return tables.judged(table(spark, sf_dir, "events").select(e.alias("submission_id"), said.alias("response"))).select(F.col("submission_id").alias("event_id"), "item_pos", "criterion", "marks_awarded", F.array_join("evidence", " / ").alias("evidence"))


# Rubrics: every brand's parts are the criteria of one model answer, half of them under a section


def _documents(spark, sf_dir):
    """(model_answer_id, doc): answers with criteria, some with sub-criteria, under a section with a cap."""
    p = table(spark, sf_dir, "part")
    sub = F.array(F.struct(F.concat(F.lit("part "), "p_type", F.lit(" 12")).alias("description"), F.lit(0.5).alias("marks")), F.struct(F.lit("hr").alias("description"), F.lit(1.0).alias("marks")))
    item = F.struct(
        F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, F.lit(" tutorial note for ")).otherwise(" stated as "), F.col("p_partkey") % 50).alias("description"), F.when(F.col("p_partkey") % 5 == 0, "3 1/2").when(F.col("p_partkey") % 5 == 1, "6").otherwise("0.5").alias("marks"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("C"), "p_partkey")).alias("criterion_id"), F.when(F.col("p_partkey") % 4 == 0, sub).alias("sub_criteria"),
    )
    own = F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item"), "p_size")))
    g = p.groupBy("p_brand").agg(own.alias("rows"))
    criteria = lambda odd: F.transform(F.filter("rows", lambda r: r["p_partkey"] % 2 == odd), lambda r: r["item"])
    leaf = F.struct(F.lit("1.1").alias("question_number"), F.lit("text").alias("answer"), F.lit(3).alias("marks"), criteria(1).alias("marking_criteria"))
    answer = F.struct(F.lit("1").alias("question_number"), F.lit(4).alias("subsection_max"), criteria(0).alias("marking_criteria"), F.array(leaf).alias("sub_answers"))
    return g.select(F.col("p_brand").alias("model_answer_id"), F.to_json(F.struct(F.array(answer).alias("answers"))).alias("doc"))


_CRITERIA_SQL = """WITH c AS (SELECT p_brand, p_partkey, p_partkey % 2 AS sub, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' tutorial note for ' ELSE ' stated as ' END || (p_partkey % 50) AS own, CASE p_partkey % 5 WHEN 0 THEN 3.5::DOUBLE WHEN 1 THEN 6.0::DOUBLE ELSE 0.5::DOUBLE END AS m,
  CASE WHEN p_partkey % 3 <> 0 THEN 'C' || p_partkey END AS criterion_id, p_partkey % 4 = 0 AS parent, p_type FROM part),
micro AS (SELECT p_brand, bool_or(m < 5 OR parent) AS micro FROM c GROUP BY p_brand),
k AS (SELECT c.*, row_number() OVER (PARTITION BY p_brand ORDER BY sub, p_partkey) AS pos, CASE WHEN parent THEN own || ' - part ' || p_type || ' 12' ELSE own END AS description, CASE WHEN parent THEN 0.5::DOUBLE ELSE m END AS marks FROM c JOIN micro USING (p_brand) WHERE NOT (m >= 5 AND micro))"""


@query(_CRITERIA_SQL + " SELECT p_brand AS model_answer_id, pos, CASE sub WHEN 0 THEN '1' ELSE '1.1' END AS question_number, criterion_id, description, marks FROM k")
def p04_criteria(spark, sf_dir):
    return rubric.criteria(_documents(spark, sf_dir)).select("model_answer_id", F.col("pos").cast("long").alias("pos"), "question_number", "criterion_id", "description", "marks")


def _each_documents(spark, sf_dir):
    """A document for each part: an answer of question 1 and one of question 2 with a line of figures worth half a mark each, and own-figure definitions."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat("p_name", F.lit(" 12; hr; "), "p_type", F.lit(" 13;"), "p_brand", F.lit(" 14"))).when(k == 1, F.concat(F.lit("80,000 48,000 "), "p_size", F.lit(",453 1,920"))).otherwise(F.concat("p_name", F.lit(" in all 7")))
    item = F.struct(line.alias("description"), F.concat(F.lit("1/2 mk each max "), F.col("p_size") % 2 + 1).alias("marks"))
    of = lambda v: F.create_map(F.lit("OF1"), F.struct(v.alias("value"), F.lit("GBP").alias("unit")), F.concat(F.lit("X"), "p_size"), F.struct(F.lit(7).alias("value"), F.lit("m").alias("unit")))
    answer = lambda n, text, v: F.struct(F.lit(n).alias("question_number"), text.alias("answer"), F.array(item).alias("marking_criteria"), of(v).alias("of_definitions"))
    return p.select(F.col("p_partkey").cast("string").alias("model_answer_id"), F.to_json(F.struct(F.lit("Audit").alias("question_title"), F.array(answer("1", F.col("p_name"), F.col("p_size")), answer("Question 2", F.col("p_type"), F.col("p_size") + 1)).alias("answers"))).alias("doc"))


_EACH_SQL = """WITH d AS (SELECT p_partkey, p_size % 2 + 1 AS most, CASE p_partkey % 3 WHEN 0 THEN [p_name || ' 12', p_type || ' 13', p_brand || ' 14'] WHEN 1 THEN ['80,000', '48,000', p_size || ',453', '1,920'] ELSE [p_name || ' in all 7'] END AS ps FROM part),
e AS (SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 2 THEN ps ELSE ps[1:2 * most] END) AS description, CASE WHEN p_partkey % 3 = 2 THEN CAST(most AS DOUBLE) ELSE 0.5::DOUBLE END AS marks FROM d)"""


@query(_EACH_SQL + " SELECT CAST(p_partkey AS VARCHAR) AS model_answer_id, q AS question_number, description, marks FROM e, (SELECT unnest(['1', 'Question 2']) AS q)")
def p05_each_parts(spark, sf_dir):
    return rubric.criteria(_each_documents(spark, sf_dir)).select("model_answer_id", "question_number", "description", "marks")


@query(_EACH_SQL + " SELECT CAST(p_partkey AS VARCHAR) AS model_answer_id, 'Question 2' AS question_number, description, marks FROM e")
def p04_one_question(spark, sf_dir):
    return rubric.criteria(_each_documents(spark, sf_dir), "2").select("model_answer_id", "question_number", "description", "marks")


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_answer_id, p_name || chr(10) || chr(10) || p_type AS answer FROM part")
def p04_answer_texts(spark, sf_dir):
    return rubric.answer_texts(_each_documents(spark, sf_dir))


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_answer_id, 'OF1' AS of_id, CAST(p_size + 1 AS DOUBLE) AS value, 'GBP' AS unit FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'X' || p_size, 7.0, 'm' FROM part")
def a12_of_definitions(spark, sf_dir):
    return rubric.of_definitions(_each_documents(spark, sf_dir)).drop("label")


@query("SELECT DISTINCT p_brand AS model_answer_id, 5.0::DOUBLE AS max_marks FROM part")
def p08_paper_marks(spark, sf_dir):
    paper = spark.createDataFrame([(" 1.1", "3 to 5"), ("9", "8")], "sub_question string, marks string")
    return rubric.leaves(_documents(spark, sf_dir), paper).select("model_answer_id", "max_marks")


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_answer_id, p_partkey % 4 = 0 AS holistic FROM part")
def p04_holistic(spark, sf_dir):
    doc = F.when(F.col("p_partkey") % 4 == 0, '{"answers": [{"answer": "x"}]}').otherwise('{"answers": [{"marking_criteria": [{"description": "Cost of sales 12", "marks": 1}]}]}')
    return rubric.holistic(table(spark, sf_dir, "part").select(text("p_partkey").alias("model_answer_id"), doc.alias("doc")))


@query(_CRITERIA_SQL + f", n AS (SELECT *, {_norm_sql('own')} AS key FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, key ORDER BY p_partkey) AS r, max(m) OVER (PARTITION BY p_brand, key) AS most FROM (SELECT *, 'x' AS z FROM n)) SELECT p_brand AS model_answer_id, p_partkey AS pos, most AS marks FROM r WHERE r = 1")
def a08_deduplicate(spark, sf_dir):
    return rubric.deduplicate(_flat(spark, sf_dir)).select("model_answer_id", "pos", "marks")


def _flat(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("model_answer_id"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, F.lit(" tutorial note for ")).otherwise(" stated as "), F.col("p_partkey") % 50).alias("description"),
        F.when(F.col("p_partkey") % 5 == 0, 3.5).when(F.col("p_partkey") % 5 == 1, 6.0).otherwise(0.5).alias("marks"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("C"), "p_partkey")).alias("criterion_id"), F.lit("").alias("category"),
    )


@query(_CRITERIA_SQL + " SELECT p_brand AS model_answer_id, p_partkey AS pos FROM c WHERE criterion_id IS NOT NULL OR NOT contains(own, 'tutorial note')")
def f04_drop_commentary(spark, sf_dir):
    return rubric.drop_commentary(_flat(spark, sf_dir)).select("model_answer_id", "pos")


_TOK4 = f"list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({_STOP_SQL}, w)))"
_HEADED = "CASE p_partkey % 6 WHEN 0 THEN 'Prepare the ' || p_type || ' ' || p_name WHEN 1 THEN p_type ELSE p_name || ' ' || p_type || ' costs 12' END"


@query(rf"""WITH d AS (SELECT p_brand, p_partkey AS pos, {_HEADED} AS description, CASE p_partkey % 6 WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS marks, CASE WHEN p_partkey % 13 = 0 THEN 'section_header' WHEN p_partkey % 17 = 0 THEN 'narrative' ELSE '' END AS category FROM part),
e AS (SELECT *, regexp_matches(description, '(?i)^(?:calculate|prepare|determine|explain|discuss|describe|evaluate|advise|state)\b') AS led, len(string_split_regex(trim(description), '\s+')) AS nw, marks > 0 AND marks <= 1 AS small, {_TOK4} AS ws FROM d),
f AS (SELECT *, category NOT IN ('calculation', 'narrative', 'journal') AND ((marks >= 2 AND (length(description) >= 70 OR led)) OR (marks >= 1 AND nw <= 5 AND NOT regexp_matches(description, '[0-9]|(?i)^(?:dr|cr)\b'))) AS broad,
  count(*) FILTER (WHERE small) OVER x - CAST(small AS INTEGER) AS n_near, coalesce(sum(CASE WHEN small THEN marks ELSE 0 END) OVER x, 0) - CASE WHEN small THEN marks ELSE 0 END AS s_near FROM e WINDOW x AS (PARTITION BY p_brand ORDER BY pos ROWS BETWEEN 18 PRECEDING AND 18 FOLLOWING)),
l AS (SELECT a.p_brand, a.pos, count(*) AS n_like, sum(b.marks) AS s_like FROM f a JOIN f b ON a.p_brand = b.p_brand AND a.pos <> b.pos AND len(list_intersect(a.ws, b.ws)) >= 2 AND (b.marks <= 1 OR length(b.description) < 70) WHERE a.broad GROUP BY 1, 2)
SELECT f.p_brand AS model_answer_id, f.pos FROM f LEFT JOIN l USING (p_brand, pos) WHERE category <> 'section_header' AND NOT (broad AND ((led AND marks >= 2 AND n_near >= 4 AND s_near >= 0.75 * marks) OR (coalesce(n_like, 0) >= CASE WHEN led THEN 1 ELSE 3 END AND coalesce(s_like, 0) >= 0.5 * marks)))""")
def f03_drop_headings(spark, sf_dir):
    k = F.col("p_partkey") % 6
    words = F.when(k == 0, F.concat(F.lit("Prepare the "), "p_type", F.lit(" "), "p_name")).when(k == 1, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" "), "p_type", F.lit(" costs 12")))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model_answer_id"), F.col("p_partkey").alias("pos"), words.alias("description"), F.when(k == 0, 2.5).when(k == 1, 1.5).otherwise(0.5).alias("marks"),
        F.when(F.col("p_partkey") % 13 == 0, "section_header").when(F.col("p_partkey") % 17 == 0, "narrative").otherwise("").alias("category"),
    )
    return rubric.drop_headings(rows).select("model_answer_id", "pos")


@query("SELECT DISTINCT p_brand AS model_answer_id, '1.1' AS sub_question, 3.0::DOUBLE AS max_marks, 4.0::DOUBLE AS section_cap FROM part")
def p08_leaves(spark, sf_dir):
    return rubric.leaves(_documents(spark, sf_dir)).select("model_answer_id", "sub_question", "max_marks", "section_cap")


# Resolution: judged rows name the view's criteria by id, in full, cut short, or with another end

def _rubric_rows(spark, sf_dir):
    """Every script's own criteria as its rubric, and judged rows that name them in four ways."""
    rows = judged(spark, sf_dir)
    rubric_rows = rows.select(F.col("submission_id").cast("string").alias("model_answer_id"), F.col("item_pos").alias("pos"), "criterion_id", F.col("criterion").alias("description"), F.col("max_possible").alias("marks"), "category")
    k = F.col("item_pos") % 4
    said = F.when(k == 2, F.left("criterion", F.lit(30))).when(k == 3, F.concat(F.left("criterion", F.lit(45)), F.lit(" but otherwise"))).otherwise(F.upper("criterion"))
    items = rows.select("submission_id", "item_pos", F.col("submission_id").cast("string").alias("model_answer_id"), F.when(k == 0, F.lower("criterion_id")).alias("criterion_id"), said.alias("criterion"))
    return items, rubric_rows


@query(f"""{VIEW}, c AS (SELECT submission_id, item_pos AS position, upper(criterion_id) AS id, {_norm_sql('criterion')} AS cn FROM judged),
i AS (SELECT submission_id, item_pos, CASE WHEN item_pos % 4 = 0 THEN upper(criterion_id) END AS id, {_norm_sql("CASE item_pos % 4 WHEN 2 THEN left(criterion, 30) WHEN 3 THEN left(criterion, 45) || ' but otherwise' ELSE upper(criterion) END")} AS jn FROM judged),
t0 AS (SELECT i.submission_id, i.item_pos, c.position, 0 AS tier FROM i JOIN c USING (submission_id) WHERE i.id = c.id),
t1 AS (SELECT i.submission_id, i.item_pos, min(c.position) AS position, 1 AS tier FROM i JOIN c USING (submission_id) WHERE i.jn = c.cn AND NOT EXISTS (SELECT 1 FROM t0 WHERE t0.submission_id = i.submission_id AND t0.item_pos = i.item_pos) GROUP BY 1, 2),
lo AS (SELECT i.submission_id, i.item_pos, c.position, CASE WHEN length(jn) >= 20 AND length(cn) >= 20 AND (starts_with(jn, cn) OR starts_with(cn, jn)) THEN 2 WHEN length(jn) >= 40 AND length(cn) >= 40 AND left(jn, 40) = left(cn, 40) THEN 3 END AS tier, abs(length(jn) - length(cn)) AS gap FROM i JOIN c USING (submission_id)
  WHERE length(jn) >= 20 AND left(jn, 20) = left(cn, 20) AND NOT EXISTS (SELECT 1 FROM t0 WHERE t0.submission_id = i.submission_id AND t0.item_pos = i.item_pos) AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.submission_id = i.submission_id AND t1.item_pos = i.item_pos)),
op AS (SELECT submission_id, item_pos, min(tier) AS tier, list(position ORDER BY gap, position) AS options FROM (SELECT *, min(tier) OVER (PARTITION BY submission_id, item_pos) AS best FROM lo WHERE tier IS NOT NULL) WHERE tier = best GROUP BY 1, 2),
every AS (SELECT submission_id, list({{'item_pos': item_pos, 'tier': tier, 'options': options}} ORDER BY item_pos) AS items FROM (SELECT submission_id, item_pos, tier, [position] AS options FROM t0 UNION ALL SELECT submission_id, item_pos, tier, [position] FROM t1 UNION ALL SELECT submission_id, item_pos, tier, options FROM op) GROUP BY submission_id),
fold AS (SELECT submission_id, items, 0 AS i, CAST([] AS INTEGER[]) AS got FROM every
  UNION ALL SELECT submission_id, items, i + 1, list_append(got, CASE WHEN items[i + 1].tier < 2 THEN items[i + 1].options[1] ELSE coalesce(list_filter(items[i + 1].options, lambda o: NOT list_contains(got, o))[1], items[i + 1].options[1]) END) FROM fold WHERE i < len(items))
SELECT submission_id, unnest(list_transform(items, lambda x: x.item_pos)) AS item_pos, unnest(got) AS position, unnest(list_transform(items, lambda x: x.tier)) AS tier FROM fold WHERE i = len(items)""")
def j01_resolve(spark, sf_dir):
    items, rubric_rows = _rubric_rows(spark, sf_dir)
    return resolve.resolve(items, rubric_rows).select(*KEY, "position", "tier")


@query(f"""{VIEW}, c AS (SELECT DISTINCT kind, {_norm_sql('criterion')} AS cn, f FROM judged), i AS (SELECT DISTINCT {_norm_sql("left(criterion, 30)")} AS jn FROM judged),
m AS (SELECT jn, cn, CASE WHEN jn = cn THEN 1 WHEN starts_with(cn, jn) OR starts_with(jn, cn) THEN 2 ELSE 3 END AS tier, abs(length(jn) - length(cn)) AS gap FROM i JOIN c ON length(jn) >= 20 AND length(cn) >= 20 AND left(jn, 20) = left(cn, 20) AND (starts_with(cn, jn) OR starts_with(jn, cn) OR (length(jn) >= 40 AND length(cn) >= 40 AND left(jn, 40) = left(cn, 40))))
SELECT jn AS item, cn AS criterion, tier FROM (SELECT *, row_number() OVER (PARTITION BY jn ORDER BY tier, gap, cn) AS rk FROM m) WHERE rk = 1""")
def j02_prefix_resolution(spark, sf_dir):
    rows = judged(spark, sf_dir)
    items = rows.select(X.evidence_norm(F.left("criterion", F.lit(30))).alias("item_norm")).distinct()
    known = rows.select(X.evidence_norm(F.col("criterion")).alias("criterion_norm")).distinct().withColumn("position", F.col("criterion_norm"))
    return resolve.resolve_text(items, known, ["item_norm"]).select(F.col("item_norm").alias("item"), F.col("criterion_norm").alias("criterion"), "tier")


# Totals and the report

_PLACED = "SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY coalesce(position, 1000000), item_pos) AS rk FROM r"


@query(f"{VIEW} SELECT submission_id, least(floor(sum(marks_awarded) * 2 + 0.5) / 2, 4.0) AS total_marks_awarded, 4.0::DOUBLE AS total_max_possible FROM r GROUP BY submission_id")
def a02_totals(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    return finalize.totals(rows, rows.select("submission_id").distinct().withColumn("max_marks", F.lit(4.0)))


def _incomplete(spark, sf_dir):
    """Judged rows without every third; their criteria are the whole view's, one of nine a heading; one more stands in a merged row."""
    rows = prepared(spark, sf_dir).withColumn("position", F.col("item_pos"))
    parts = F.when(F.col("item_pos") == 0, F.array(F.struct(F.lit(0).alias("item_pos"), F.lit("Cash").alias("criterion_description")))).alias("components")
    given = rows.filter("item_pos % 3 <> 2").withColumn("components", parts)
    criteria = rows.select(F.col("submission_id").cast("string").alias("model_answer_id"), F.col("item_pos").alias("pos"), "criterion_id", F.col("criterion").alias("description"), F.col("max_possible").alias("marks"), F.when(F.col("item_pos") % 9 == 8, "section_header").otherwise(F.col("category")).alias("category"))
    submissions = rows.select("submission_id", F.col("submission_id").cast("string").alias("model_answer_id")).distinct()
    return finalize.complete(given, submissions, criteria)


_COMPLETE_SQL = f"""{VIEW}, kept AS (SELECT submission_id, item_pos, item_pos AS position, marks_awarded, max_possible, false AS missing FROM r WHERE item_pos % 3 <> 2),
gone AS (SELECT submission_id, item_pos AS position, max_possible, row_number() OVER (PARTITION BY submission_id ORDER BY item_pos) AS rk FROM r WHERE item_pos % 3 = 2 AND item_pos % 9 <> 8 AND criterion <> 'Cash'),
full_rows AS (SELECT * FROM kept UNION ALL SELECT g.submission_id, CAST((SELECT max(item_pos) FROM kept k WHERE k.submission_id = g.submission_id) + rk AS INTEGER), position, 0.0, max_possible, true FROM gone g)"""


@query(f"{_COMPLETE_SQL} SELECT submission_id, item_pos, position, marks_awarded, max_possible, missing FROM full_rows")
def j05_complete(spark, sf_dir):
    return _incomplete(spark, sf_dir).select(*KEY, "position", "marks_awarded", "max_possible", F.startswith("reason", F.lit("NOT ASSESSED")).alias("missing"))


@query(f"{_COMPLETE_SQL} SELECT submission_id, count(*) AS rows, count(*) FILTER (WHERE missing) AS not_assessed, coalesce(sum(max_possible) FILTER (WHERE missing), 0) AS lost, count(*) FILTER (WHERE marks_awarded > 0) / greatest(count(*), 1) AS placed_rate FROM full_rows GROUP BY submission_id")
def a13_summary(spark, sf_dir):
    return finalize.summary(_incomplete(spark, sf_dir))


def _marks_sql(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x}), '[.]?0+$', '')"


@query(f"""{VIEW}, p AS ({_PLACED}), g AS (SELECT submission_id, floor(sum(marks_awarded) * 2 + 0.5) / 2 AS total, sum(max_possible) AS most FROM r GROUP BY submission_id)
SELECT submission_id, 0 AS place, 'TOTAL' AS criterion, '' AS student_text, {_marks_sql('total')} AS marks_awarded, {_marks_sql('most')} AS max_possible, 'student ' || submission_id AS student, '' AS reason FROM g
UNION ALL SELECT submission_id, CAST(rk AS INTEGER), criterion, coalesce(array_to_string(evidence, chr(10)), ''), {_marks_sql('marks_awarded')}, {_marks_sql('max_possible')}, 'student ' || submission_id, reason FROM p""")
def a01_report(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    grades = finalize.totals(rows).withColumn("student", F.concat(F.lit("student "), "submission_id")).withColumn("question", F.lit("1"))
    return finalize.report(rows, grades).select("submission_id", F.col("_order").alias("place"), "criterion", "student_text", "marks_awarded", "max_possible", "student", "reason")


# Holistic marking: rows are leaves, groups are sections

_LEAVES = "SELECT submission_id, item_pos, grp AS section, least(marks_awarded, max_possible) AS m, max_possible, evidence, reason, criterion_id FROM r"


@query(f"""{VIEW}, l AS ({_LEAVES}), e AS (SELECT submission_id, section, unnest(evidence) AS x, item_pos, unnest(range(1, len(evidence) + 1)) AS i FROM l),
d AS (SELECT submission_id, section, string_agg(x, ' / ' ORDER BY p, i) AS evidence FROM (SELECT submission_id, section, x, min(item_pos) AS p, arg_min(i, (item_pos, i)) AS i FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT submission_id, section, min(item_pos) AS item_pos, round_even(least(sum(m), 1.5) / 0.5, 0) * 0.5 AS marks_awarded, coalesce(string_agg(reason, '; ' ORDER BY item_pos) FILTER (WHERE reason <> ''), '') AS reason, arg_min(criterion_id, item_pos) AS student_label FROM l GROUP BY 1, 2)
SELECT submission_id, s.section AS sub_question, item_pos, marks_awarded, 1.5::DOUBLE AS max_possible, coalesce(d.evidence, '') AS evidence, reason, student_label FROM s LEFT JOIN d USING (submission_id, section)""")
def a05_sections(spark, sf_dir):
    return holistic.sections(_leaves(spark, sf_dir)).select("submission_id", "sub_question", "item_pos", "marks_awarded", "max_possible", F.array_join("evidence", " / ").alias("evidence"), "reason", "student_label")


def _leaves(spark, sf_dir):
    return prepared(spark, sf_dir).select(
        "submission_id", "item_pos", F.col("criterion_id").alias("sub_question"), F.col("group").alias("parent_section"), F.lit(1.5).alias("section_cap"), F.col("max_possible").alias("max_marks"),
        F.least("marks_awarded", "max_possible").alias("marks_awarded"), "evidence", "reason", F.col("criterion_id").alias("student_label"),
    )


@query(f"{VIEW}, l AS ({_LEAVES}), s AS (SELECT submission_id, round_even(least(sum(m), 1.5) / 0.5, 0) * 0.5 AS m FROM l GROUP BY submission_id, section) SELECT submission_id, round_even(least(sum(m), 2.0) / 0.5, 0) * 0.5 AS score FROM s GROUP BY submission_id")
def a06_audited_score(spark, sf_dir):
    s = holistic.sections(_leaves(spark, sf_dir))
    return holistic.audited_score(s, s.select("submission_id").distinct().withColumn("cap", F.lit(2.0)))


@query(f"{VIEW}, l AS ({_LEAVES}) SELECT submission_id, section, sum(m) AS section_marks, sum(m) >= 0.75 * 1.5 AS trusted FROM l GROUP BY 1, 2")
def a07_trusted_sections(spark, sf_dir):
    return holistic.trusted_sections(_leaves(spark, sf_dir)).select("submission_id", F.col("parent_section").alias("section"), "section_marks", "trusted")


_PHRASES = ["the control of assets passes to the parent", "short one", "risk moves with every single new contract", "of the and to"]
_KEPT = {0: "control of assets passes to the", 2: "risk moves with every single new"}


@query(f"""{VIEW}, p AS (SELECT submission_id, item_pos, j, CASE (item_pos + j) % 4 WHEN 0 THEN '{_KEPT[0]}' WHEN 2 THEN '{_KEPT[2]}' END AS phrase, greatest(round_even((item_pos % 3 + 0.5) / 0.5, 0), 1) AS n, max_possible FROM (SELECT *, unnest([0, 1, 2]) AS j FROM r)),
t AS (SELECT submission_id, item_pos, phrase, max_possible, k, row_number() OVER (PARTITION BY submission_id, item_pos ORDER BY j, k) AS tick FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS k FROM p WHERE phrase IS NOT NULL))
SELECT submission_id, item_pos, CAST(tick AS INTEGER) AS tick, 0.5::DOUBLE AS marks, CASE WHEN k = 1 THEN phrase END AS key_phrase FROM t WHERE tick * 0.5 <= round_even(max_possible / 0.5, 0) * 0.5""")
def p20_ticks(spark, sf_dir):
    points = prepared(spark, sf_dir).select("submission_id", "item_pos", F.col("max_possible").alias("leaf_max"), F.explode(F.array(*map(F.lit, range(3)))).alias("point_pos"))
    said = F.element_at(F.array(*map(F.lit, _PHRASES)), ((F.col("item_pos") + F.col("point_pos")) % 4 + 1).cast("int"))
    return holistic.ticks(points.withColumns({"text": said, "marks": F.col("item_pos") % 3 + 0.5})).select(*KEY, "tick", "marks", "key_phrase")


_KEYWORD = f"CASE WHEN regexp_matches(k, '[ /-]') THEN contains(low, k) OR (len(list_filter(regexp_extract_all(k, '[a-z]+'), lambda w: length(w) >= 4)) > 0 AND len(list_filter(list_filter(regexp_extract_all(k, '[a-z]+'), lambda w: length(w) >= 4), lambda w: {_stem_sql('w', 'said_w')})) >= greatest(1, (len(list_filter(regexp_extract_all(k, '[a-z]+'), lambda w: length(w) >= 4)) + 1) // 2)) ELSE length(k) >= 3 AND {_stem_sql('k', 'said_w')} END"


@query(f"""{VIEW}, s AS (SELECT submission_id, lower(ss[i]) AS low, regexp_extract_all(lower(ss[i]), '[a-z]+') AS said_w, i - 1 AS sentence_pos FROM (SELECT submission_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT submission_id, {_SENTENCES_SQL.format(c='text')} AS ss FROM script))),
k AS (SELECT submission_id, item_pos, CASE WHEN item_pos % 4 = 3 THEN list_transform(list_filter(regexp_extract_all(criterion, '\\w+'), lambda w: length(w) > 4)[1:6], lambda w: lower(w)) ELSE list_prepend(lower(regexp_extract(criterion, '^\\w+ \\w+')), regexp_extract_all(lower(criterion), '[a-z]{{4,}}')) END AS ks FROM judged),
x AS (SELECT k.submission_id, item_pos, sentence_pos, len(list_filter(ks, lambda k: k <> '' AND {_KEYWORD})) / len(ks) AS score FROM k JOIN s USING (submission_id) WHERE len(ks) > 0)
SELECT submission_id, item_pos, score, CAST(sentence_pos AS INTEGER) AS sentence_pos FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, item_pos ORDER BY score DESC, sentence_pos) AS rk FROM x WHERE score > 0 AND score >= 0.34) WHERE rk = 1""")
def j12_best_sentences(spark, sf_dir):
    """The keywords are a criterion's first two words and its words; every fourth row has none."""
    rows = judged(spark, sf_dir)
    said = F.concat(F.array(F.regexp_extract("criterion", r"^\w+ \w+", 0)), F.regexp_extract_all(F.lower("criterion"), F.lit("[a-z]{4,}"), F.lit(0)))
    wanted = rows.select("submission_id", F.col("item_pos").alias("criterion_pos"), F.when(F.col("item_pos") % 4 != 3, said).otherwise(F.array().cast("array<string>")).alias("keywords"), F.col("criterion").alias("description"))
    return holistic.best_sentences(scripts(rows), wanted).select("submission_id", F.col("criterion_pos").alias("item_pos"), "score", "sentence_pos")


_USED = "coalesce(list_sum(list_transform(list_filter(done, lambda d: d.{c} = x.{c}), lambda d: d.added)), 0)"


@query(f"""{VIEW}, x AS (SELECT *, f % 7 / 7.0 AS score, item_pos % 3 AS sentence, item_pos // 2 AS leaf, item_pos % 2 AS existing, n % 3 / 2.0 AS section_marks FROM r),
w AS (SELECT *, CASE WHEN score >= CASE WHEN existing > 0 THEN 0.34 ELSE 0.55 END AND section_marks < 0.75 * 2 THEN greatest(CAST(round(max_possible * 2) AS INTEGER) - existing, 0) ELSE 0 END AS want, CAST(ceil((2 - section_marks) * 2) AS INTEGER) AS section_room FROM x),
every AS (SELECT submission_id, list({{'item_pos': item_pos, 'sentence': sentence, 'leaf': leaf, 'grp': grp, 'want': want, 'section_room': section_room}} ORDER BY item_pos) AS items FROM w GROUP BY submission_id),
fold AS (SELECT submission_id, items, 0 AS i, CAST([] AS STRUCT(sentence INTEGER, leaf INTEGER, grp VARCHAR, added INTEGER)[]) AS done FROM every
  UNION ALL SELECT submission_id, items, i + 1, list_append(done, {{'sentence': x.sentence, 'leaf': x.leaf, 'grp': x.grp, 'added': CAST(greatest(least(x.want, 4 - {_USED.format(c='sentence')}, 3 - {_USED.format(c='leaf')}, x.section_room - {_USED.format(c='grp')}), 0) AS INTEGER)}}) FROM (SELECT *, items[i + 1] AS x FROM fold WHERE i < len(items)))
SELECT submission_id, unnest(list_transform(items, lambda y: y.item_pos)) AS item_pos, CAST(unnest(list_transform(done, lambda d: d.added)) AS BIGINT) AS added FROM fold WHERE i = len(items)""")
def g14_coverage_audit(spark, sf_dir):
    from .function_queries import _with_numbers

    rows = prepared(spark, sf_dir).join(_with_numbers(spark, sf_dir), KEY)
    pos = F.col("item_pos")
    rows = rows.select(
        "submission_id", F.col("group").alias("section"), F.lit(2.0).alias("section_cap"), (F.col("n") % 3 / 2.0).alias("section_marks"), F.floor(pos / 2).alias("leaf"), F.lit(1.5).alias("leaf_max"), F.lit(0).alias("leaf_ticks"),
        pos.alias("criterion_pos"), F.col("max_possible").alias("marks"), (pos % 2).alias("existing"), (F.col("f") % 7 / 7.0).alias("score"), (pos % 3).alias("sentence_pos"),
    )
    return holistic.coverage_audit(rows).select("submission_id", F.col("criterion_pos").cast("int").alias("item_pos"), F.col("added").cast("long").alias("added"))


# Restatements and judges


@query(f"""{VIEW}, ln AS (SELECT submission_id, i - 1 AS line_no, {_norm_sql('ls[i]')} AS norm FROM (SELECT submission_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM script)),
l AS (SELECT * FROM ln WHERE norm <> ''), e AS (SELECT DISTINCT submission_id, {_norm_sql('e')} AS norm FROM (SELECT submission_id, unnest(CASE WHEN item_pos % 2 = 0 THEN evidence ELSE [left(criterion, 9)] END) AS e FROM r) WHERE {_norm_sql('e')} <> ''),
eq AS (SELECT l.submission_id, line_no, norm FROM l JOIN e USING (submission_id, norm)), rest AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.submission_id = e.submission_id AND eq.norm = e.norm)),
part AS (SELECT submission_id, line_no FROM (SELECT l.submission_id, line_no, row_number() OVER (PARTITION BY l.submission_id, rest.norm ORDER BY length(l.norm) DESC, line_no) AS rk FROM rest JOIN l ON l.submission_id = rest.submission_id AND (contains(l.norm, rest.norm) OR contains(rest.norm, l.norm))) WHERE rk = 1)
SELECT submission_id, CAST(line_no AS INTEGER) AS line_no FROM l WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.submission_id = l.submission_id AND eq.line_no = l.line_no) AND NOT EXISTS (SELECT 1 FROM part p WHERE p.submission_id = l.submission_id AND p.line_no = l.line_no)""")
def p25_unmarked_lines(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    paid = rows.select("submission_id", F.explode(F.when(F.col("item_pos") % 2 == 0, F.col("evidence")).otherwise(F.array(F.left("criterion", F.lit(9))))).alias("evidence"))
    return restatements.unmarked_lines(rows.select("submission_id", "text").dropDuplicates(["submission_id"]), paid).select("submission_id", "line_no")


@query(f"""{VIEW}, ln AS (SELECT DISTINCT submission_id, unnest(string_split(text, chr(10))) AS line FROM script), u AS (SELECT DISTINCT submission_id, {_norm_sql('e')} AS norm FROM (SELECT submission_id, unnest(evidence) AS e FROM r WHERE item_pos % 3 = 0)),
f AS (SELECT l.submission_id, l.line, strpos(s.text, l.line) AS place, {_norm_sql('l.line')} AS norm FROM ln l JOIN script s USING (submission_id) WHERE trim(l.line) <> ''),
n AS (SELECT submission_id, norm, min((place, line)) AS x FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.submission_id = f.submission_id AND u.norm = f.norm) GROUP BY 1, 2)
SELECT submission_id, count(*) AS notes FROM (SELECT submission_id, row_number() OVER (PARTITION BY submission_id ORDER BY x) AS rk FROM n) WHERE rk <= 4 GROUP BY submission_id""")
def j19_accept_restatements(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    script = rows.select("submission_id", "text").dropDuplicates(["submission_id"])
    flagged = script.select("submission_id", F.lit("C1").alias("criterion_id"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    out = restatements.accept_restatements(flagged, script, rows.filter("item_pos % 3 = 0"))
    return out.groupBy("submission_id").agg(F.count("*").alias("notes"))


_WORDS4 = f"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace({{c}}, '[0-9]', ' ', 'g')), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({_STOP_SQL}, w)))"
_NUMBERS3 = "list_distinct(list_filter(list_transform(regexp_extract_all({c}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 3))"


@query(f"""{VIEW}, l AS (SELECT submission_id, line, unnest({_NUMBERS3.format(c='line')}) AS k, {_WORDS4.format(c='line')} AS ws FROM (SELECT DISTINCT submission_id, unnest(string_split(text, chr(10))) AS line FROM script)),
c AS (SELECT submission_id, criterion_id, unnest({_NUMBERS3.format(c='criterion')}) AS k, {_WORDS4.format(c='criterion')} AS ss FROM r)
SELECT DISTINCT submission_id, criterion_id, line FROM l JOIN c USING (submission_id, k) WHERE len(ws) = 0 OR len(list_intersect(ws, ss)) > 0""")
def d06_flag_restatements(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    lines = rows.select("submission_id", "text").dropDuplicates(["submission_id"]).select("submission_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    return restatements.flag_restatements(lines, rows.select("submission_id", "criterion_id", F.col("criterion").alias("evidence")))


@query(f"{VIEW} SELECT submission_id, item_pos, CASE WHEN item_pos % 2 = 0 THEN 0.25 ELSE max_possible END AS marks_awarded FROM r")
def d01_in_turn(spark, sf_dir):
    """The first judge answers every second pair, and the others without marks; the second one gives all of them."""
    rows = prepared(spark, sf_dir)
    pairs = rows.select("submission_id", "text", F.col("item_pos").alias("pos"), "criterion_id", F.col("criterion").alias("description"), F.col("max_possible").alias("marks"), "category", "exact_match")
    answer = lambda marks: lambda p: p.select("submission_id", F.col("pos").alias("item_pos"), "criterion_id", marks.cast("double").alias("marks_awarded"))
    return judge.in_turn(pairs, [answer(F.when(F.col("pos") % 2 == 0, 0.25)), answer(F.col("marks"))]).select(*KEY, "marks_awarded")


_FOUR = f"list_distinct(list_filter(regexp_extract_all(lower({{c}}), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({_STOP_SQL}, w)))"


@query(f"""{VIEW}, p AS (SELECT submission_id, item_pos, exact_match, max_possible, {_FOUR.format(c='criterion')} AS wanted, list_distinct(list_filter(list_transform(regexp_extract_all(criterion, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 2)) AS fs FROM r),
ln AS (SELECT submission_id, line, row_number() OVER (PARTITION BY submission_id ORDER BY i) - 1 AS i, list_filter(regexp_extract_all(lower(line), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({_STOP_SQL}, w)) AS ws FROM (SELECT submission_id, ls[i] AS line, i FROM (SELECT submission_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM script)) WHERE trim(line) <> ''),
x AS (SELECT p.submission_id, item_pos, exact_match, max_possible, i, fs, len(wanted) AS nw, len(list_filter(wanted, lambda w: len(list_filter(ws, lambda s: starts_with(s, left(w, 5)))) > 0)) AS hits, len(list_filter(fs, lambda v2: {in_text_sql('CAST(v2 AS DOUBLE)', 'line')})) AS stated FROM p JOIN ln USING (submission_id)),
b AS (SELECT *, (hits + stated) / greatest(nw + len(fs), 1) AS score, row_number() OVER (PARTITION BY submission_id, item_pos ORDER BY (hits + stated) / greatest(nw + len(fs), 1) DESC, i) AS rk FROM x)
SELECT submission_id, item_pos, CASE WHEN (exact_match AND stated < len(fs)) OR score < 0.3 THEN 0.0 WHEN score >= 0.6 THEN max_possible ELSE round_even(max_possible / 2 / 0.25, 0) * 0.25 END AS marks_awarded FROM b WHERE rk = 1""")
def d01_offline_judge(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    pairs = rows.select("submission_id", "text", F.col("item_pos").alias("pos"), "criterion_id", F.col("criterion").alias("description"), F.col("max_possible").alias("marks"), "category", "exact_match")
    return judge.offline(pairs).select(*KEY, "marks_awarded")


@query(f"{VIEW} SELECT submission_id, item_pos FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, CASE WHEN item_pos % 2 = 0 THEN grp ELSE criterion END ORDER BY marks_awarded DESC, item_pos) AS rk FROM r) WHERE rk = 1")
def d01_once_each(spark, sf_dir):
    rows = prepared(spark, sf_dir).withColumn("criterion_id", F.when(F.col("item_pos") % 2 == 0, F.col("group")))
    return judge.once_each(rows).select(*KEY)


@query(f"""{VIEW}, x AS (SELECT submission_id, kind AS leaf, item_pos % 4 AS sentence_pos, f % 9 / 8.0 AS score, max_possible AS marks FROM r), b AS (SELECT submission_id, leaf, sum(marks) AS m FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, sentence_pos ORDER BY score DESC, leaf, marks DESC) AS rk FROM x) WHERE rk = 1 AND score > 0 GROUP BY 1, 2),
o AS (SELECT submission_id, leaf, leaf % 3 AS section, round_even(least(m, 1.0) / 0.5, 0) * 0.5 AS m FROM b)
SELECT submission_id, leaf, greatest(0.0, least(m, 1.5 - coalesce(sum(m) OVER (PARTITION BY submission_id, section ORDER BY leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS marks_awarded FROM o""")
def d03_sentence_leaves(spark, sf_dir):
    from .function_queries import _with_numbers
    from .marking_view import CRITERIA

    leaves = table(spark, sf_dir, "part").select((F.col("p_partkey") % len(CRITERIA)).alias("leaf")).distinct()
    caps = leaves.select("leaf", F.lit(1.0).alias("max_marks"), (F.col("leaf") % 3).alias("section"), F.lit(1.5).alias("section_cap"))
    rows = prepared(spark, sf_dir).join(_with_numbers(spark, sf_dir), KEY).join(_kinds(spark, sf_dir), KEY)
    scored = rows.select("submission_id", "leaf", (F.col("item_pos") % 4).alias("sentence_pos"), (F.col("f") % 9 / 8.0).alias("score"), F.col("max_possible").alias("marks"))
    return judge.sentence_leaves(scored, caps).select("submission_id", "leaf", "marks_awarded")


def _kinds(spark, sf_dir):
    from .marking_view import CRITERIA, ORDER

    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("submission_id"), rank.alias("item_pos"), (F.col("l_partkey") % len(CRITERIA)).alias("leaf"))
