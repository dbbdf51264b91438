"""Queries of the layout operators over the words of all scripts of the marking view, set on a grid, with their rules as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import criteria as C
from ..operators import geometry, layout
from .guard_queries import KEY, prepared
from .marking_view import VIEW, judged, scripts
from .queries import _STOP_SQL, query, table

PER_PAGE, WIDTH = 4, 600.0


def words(spark, sf_dir):
    """Four lines a page, fourteen points apart; words sixty points apart and fifty wide."""
    s = scripts(judged(spark, sf_dir))
    lines = s.select("submission_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    w = lines.select("submission_id", "line", F.posexplode(F.split("t", " ")).alias("word", "text")).filter("text <> ''")
    x0, y0 = 20.0 + 60 * F.col("word"), 20.0 + 14 * (F.col("line") % PER_PAGE)
    return w.select("submission_id", (F.floor(F.col("line") / PER_PAGE) + 1).cast("int").alias("page"), F.lit(0).alias("block"), "line", "word", x0.alias("x0"), y0.alias("y0"), (x0 + 50).alias("x1"), (y0 + 10).alias("y1"), "text")


WORDS = f"""{VIEW}, w0 AS (SELECT submission_id, CAST(i - 1 AS INTEGER) AS line, string_split(ls[i], ' ') AS ws FROM (SELECT submission_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM script)),
w1 AS (SELECT submission_id, line, unnest(ws) AS text, CAST(unnest(range(0, len(ws))) AS INTEGER) AS word FROM w0),
words AS (SELECT submission_id, CAST(line // {PER_PAGE} + 1 AS INTEGER) AS page, line, word, 20.0::DOUBLE + 60 * word AS x0, 20.0::DOUBLE + 14 * (line % {PER_PAGE}) AS y0, 70.0::DOUBLE + 60 * word AS x1, 30.0::DOUBLE + 14 * (line % {PER_PAGE}) AS y1, text FROM w1 WHERE text <> ''),
lines AS (SELECT submission_id, page, line, string_agg(text, ' ' ORDER BY word) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY 1, 2, 3),
rects AS (SELECT submission_id, line AS rect_id, page, x0, y0, x1, y1 FROM words WHERE word = 0)"""


def rects(spark, sf_dir):
    """The first word of each line."""
    w = words(spark, sf_dir)
    return w, w.filter("word = 0").select("submission_id", F.col("line").alias("rect_id"), "page", *geometry.BOX)


@query(f"{WORDS} SELECT submission_id, page, line, text, x0, y0, x1, y1 FROM lines")
def s10_lines(spark, sf_dir):
    return layout.lines(words(spark, sf_dir)).select("submission_id", "page", "line", "text", *geometry.BOX)


@query(f"{WORDS}, t AS (SELECT DISTINCT submission_id, page, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP_SQL}, w))) AS t FROM lines) SELECT l.submission_id, l.page, coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM t WHERE t.submission_id = l.submission_id AND t.page = l.page), '') AS tokens FROM (SELECT DISTINCT submission_id, page FROM lines) l")
def a12_page_tokens(spark, sf_dir):
    return geometry.page_tokens(layout.lines(words(spark, sf_dir))).select("submission_id", "page", F.array_join("tokens", " ").alias("tokens"))


_TOK = f"list_distinct(list_filter(regexp_extract_all(lower({{c}}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP_SQL}, w)))"
_EVIDENCE = "e AS (SELECT submission_id, item_pos AS evidence_id, evidence[1] AS evidence FROM r WHERE len(evidence) > 0)"


def evidence(spark, sf_dir):
    return prepared(spark, sf_dir).filter("size(evidence) > 0").select("submission_id", F.col("item_pos").alias("evidence_id"), F.get("evidence", 0).alias("evidence"))


_RANKED = f"""{_EVIDENCE}, pt AS (SELECT submission_id, page, list_distinct(flatten(list({_TOK.format(c='text')}))) AS on_page FROM lines GROUP BY 1, 2),
pr AS (SELECT e.submission_id, evidence_id, page, len(list_distinct(list_filter({_TOK.format(c='evidence')}, lambda w: list_contains(on_page, w)))) AS shared FROM e JOIN pt USING (submission_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY submission_id, evidence_id ORDER BY shared DESC, page) AS page_rank FROM pr)"""


@query(f"{WORDS}, {_RANKED} SELECT submission_id, evidence_id, page, shared, page_rank FROM ranked")
def w04_rank_pages(spark, sf_dir):
    out = layout.rank_pages(layout.lines(words(spark, sf_dir)), evidence(spark, sf_dir))
    return out.select("submission_id", "evidence_id", "page", F.col("shared").cast("long").alias("shared"), F.col("page_rank").cast("long").alias("page_rank"))


@query(f"{WORDS} SELECT r.submission_id, rect_id, r.page, l.x1 AS line_x1, l.y0 AS line_y0, l.text AS line_text FROM rects r JOIN lines l ON l.submission_id = r.submission_id AND l.line = r.rect_id")
def l05_line_of(spark, sf_dir):
    w, r = rects(spark, sf_dir)
    return geometry.line_of(r, layout.lines(w)).select(*geometry.RECT, "line_x1", "line_y0", "line_text")


@query(f"{WORDS} SELECT r.submission_id, rect_id, r.page, min(w.x0) AS row_x0, max(w.x1) AS row_x1, min(w.y0) AS row_y0, max(w.y1) AS row_y1 FROM rects r JOIN words w ON w.submission_id = r.submission_id AND w.page = r.page AND abs((w.y0 + w.y1 - r.y0 - r.y1) / 2) <= 14 GROUP BY 1, 2, 3")
def l05_row_of(spark, sf_dir):
    w, r = rects(spark, sf_dir)
    return geometry.row_of(r, w, 14.0).select(*geometry.RECT, "row_x0", "row_x1", "row_y0", "row_y1")


@query(f"{WORDS} SELECT * FROM (SELECT r.submission_id, rect_id, r.page, l.line AS z, l.text AS next_text, l.y0 AS next_y0, row_number() OVER (PARTITION BY r.submission_id, rect_id, r.page ORDER BY l.y0, l.x0) AS rk FROM rects r JOIN lines l ON l.submission_id = r.submission_id AND l.page = r.page AND l.y0 > r.y1 + 1 AND l.y0 <= r.y1 + 30 AND regexp_matches(l.text, '[1-9]')) WHERE rk = 1".replace("SELECT * FROM (SELECT r.sub", "SELECT submission_id, rect_id, page, next_text, next_y0 FROM (SELECT r.sub"))
def l05_next_value_line(spark, sf_dir):
    w, r = rects(spark, sf_dir)
    return geometry.next_value_line(r, layout.lines(w), 30.0).select(*geometry.RECT, "next_text", "next_y0")


@query(f"{WORDS} SELECT submission_id, rect_id, page, value_text, value_x0 FROM (SELECT r.submission_id, rect_id, r.page, w.text AS value_text, w.x0 AS value_x0, row_number() OVER (PARTITION BY r.submission_id, rect_id ORDER BY w.x0 DESC) AS rk FROM rects r JOIN words w ON w.submission_id = r.submission_id AND w.line = r.rect_id AND regexp_matches(w.text, '[0-9£$%]')) WHERE rk = 1")
def l05_last_figure(spark, sf_dir):
    w, r = rects(spark, sf_dir)
    return geometry.last_figure(r, w).select(*geometry.RECT, "value_text", "value_x0")


_VALUE = r"(regexp_matches(replace(w.text, ',', ''), '^[(]*-?[0-9]+(?:\.[0-9]+)?[)]*$') AND length(regexp_replace(w.text, '[^0-9]', '', 'g')) >= 2 AND regexp_matches(w.text, '[1-9]'))"


@query(rf"""{WORDS}, v AS (SELECT DISTINCT submission_id, line FROM words w WHERE {_VALUE}),
h AS (SELECT l.submission_id, l.line, lower(l.text) AS t, v.line IS NULL AS bare FROM lines l LEFT JOIN v USING (submission_id, line)),
g AS (SELECT *, regexp_matches(t, ':$') OR regexp_matches(t, '{C.HEADING_PHRASES}') OR (NOT regexp_matches(t, '[0-9]') AND len(string_split(t, ' ')) <= 12 AND regexp_matches(t, '{C.HEADING_KEYWORDS}'))
  OR (((len(string_split(t, ' ')) <= 3 AND length(t) <= 24) OR len(list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '^[a-z]{{1,3}}[0-9]{{1,3}}$'))) > 0) AND bare) AS heading FROM h),
nx AS (SELECT r.submission_id, rect_id, min(l.y0) AS y0 FROM rects r JOIN g ON g.submission_id = r.submission_id AND g.line = r.rect_id AND heading JOIN lines l ON l.submission_id = r.submission_id AND l.page = r.page AND l.y0 > r.y1 + 1 AND regexp_matches(l.text, '[1-9]') GROUP BY 1, 2)
SELECT r.submission_id, r.rect_id, r.page, coalesce(nx.y0, r.y0) AS y0, nx.y0 IS NOT NULL AS moved FROM rects r LEFT JOIN nx USING (submission_id, rect_id)""")
def l05_off_headings(spark, sf_dir):
    w, r = rects(spark, sf_dir)
    return geometry.off_headings(r, layout.lines(w), w).select(*geometry.RECT, "y0", "moved")


@query(f"""{WORDS}, h AS (SELECT submission_id, page, row_number() OVER (PARTITION BY submission_id, page ORDER BY line) AS hit, y0, length(text) AS covered FROM lines),
g AS (SELECT submission_id, page, hit, 0 AS grp, 1 AS n, CAST(covered AS DOUBLE) AS c FROM h WHERE hit = 1
  UNION ALL SELECT h.submission_id, h.page, h.hit, CASE WHEN c < 36 AND n < 3 THEN grp ELSE grp + 1 END, CASE WHEN c < 36 AND n < 3 THEN n + 1 ELSE 1 END, CASE WHEN c < 36 AND n < 3 THEN c + 1 + covered ELSE covered END FROM g JOIN h ON h.submission_id = g.submission_id AND h.page = g.page AND h.hit = g.hit + 1)
SELECT submission_id, page, hit, CAST(grp AS BIGINT) AS grp FROM g""")
def l04_wrapped_hits(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("submission_id", "page").orderBy("line")
    hits = layout.lines(words(spark, sf_dir)).select("submission_id", "page", F.lit(0).alias("rect_id"), F.row_number().over(order).cast("long").alias("hit"), "y0", F.length("text").alias("covered"), F.lit(40).alias("wanted"))
    return geometry.wrapped_hits(hits, 0.9, 3).select("submission_id", "page", "hit", F.col("group").alias("grp"))


def _valued(spark, sf_dir):
    """Each line's rectangle with its text as evidence and the line's last figure as number."""
    w, r = rects(spark, sf_dir)
    on = geometry.line_of(r, layout.lines(w))
    number = F.element_at(F.regexp_extract_all("line_text", F.lit("[0-9]+"), F.lit(0)), -1)
    return w, on.filter(F.col("line_text").rlike("[0-9]")).select(*geometry.RECT, *geometry.BOX, F.col("line_text").alias("evidence"), number.alias("number"))


_VALUED = rf"""vr AS (SELECT r.*, l.text AS evidence, regexp_extract_all(l.text, '[0-9]+')[-1] AS number FROM rects r JOIN lines l ON l.submission_id = r.submission_id AND l.line = r.rect_id WHERE regexp_matches(l.text, '[0-9]')),
tk AS (SELECT vr.*, list_distinct(regexp_extract_all(evidence, '[-−(]?[0-9][0-9,]*(?:\.[0-9]+)?')) AS ts FROM vr), tl AS (SELECT submission_id, rect_id, unnest(ts) AS t FROM tk)"""


@query(rf"""{WORDS}, {_VALUED}, m AS (SELECT vr.submission_id, vr.rect_id, vr.page, w.x0, w.x1, row_number() OVER (PARTITION BY vr.submission_id, vr.rect_id ORDER BY length(t) DESC, regexp_replace(t, '^[-−(]', ''), w.x0) AS rk
  FROM vr JOIN tl USING (submission_id, rect_id) JOIN words w ON w.submission_id = vr.submission_id AND w.line = vr.rect_id AND contains(w.text, regexp_replace(t, '^[-−(]', '')))
SELECT submission_id, rect_id, page, x0, x1 FROM m WHERE rk = 1""")
def l06_narrowed(spark, sf_dir):
    w, r = _valued(spark, sf_dir)
    return geometry.narrowed(r, w).select(*geometry.RECT, "x0", "x1")


@query(f"{WORDS}, {_VALUED} SELECT vr.submission_id, vr.rect_id, vr.page, max(w.x0) AS x0 FROM vr JOIN words w ON w.submission_id = vr.submission_id AND w.line = vr.rect_id AND contains(w.text, vr.number) GROUP BY 1, 2, 3")
def l11_figure_in(spark, sf_dir):
    w, r = _valued(spark, sf_dir)
    return geometry.figure_in(r, w).select(*geometry.RECT, "x0")


@query(rf"""{WORDS}, c AS (SELECT l.submission_id, (line // 5) AS rect_id, line, page, y0, x0, text, ([ 'Dr receivables and cr cash', 'Aggregate of the 1,250 items', 'Reserves of 5000 or 12,500'])[CAST((line // 5) % 3 + 1 AS INTEGER)] AS c FROM lines l),
s AS (SELECT *, CAST((regexp_matches(lower(c), '^\s*(?:dr|cr|debit|credit)\b|journal') AND ((regexp_matches(lower(c), 'dr |debit ') AND regexp_matches(text, '(?i)^\s*(?:dr|debit)\b')) OR (regexp_matches(lower(c), ' cr |credit ') AND regexp_matches(text, '(?i)^\s*(?:cr|credit)\b')))) AS INTEGER) AS side,
  CAST((regexp_matches(lower(c), '\b(?:aggregate)\b') AND regexp_matches(text, '(?i)^\s*(?:total|gain on disposal|loss on disposal)\b')) AS INTEGER) AS total,
  CAST(len(list_filter(list_transform(regexp_extract_all(c, '[0-9]{{1,3}}(?:,[0-9]{{3}})+|\b[0-9]{{4,}}\b'), lambda x: replace(x, ',', '')), lambda x: contains(regexp_replace(text, '[,\s]+', '', 'g'), x))) > 0 AS INTEGER) AS figure,
  CASE WHEN regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]') THEN 3 WHEN regexp_matches(text, '[0-9]') THEN 2 WHEN regexp_matches(text, '[A-Za-z]') THEN 1 ELSE 0 END AS tier FROM c)
SELECT submission_id, rect_id, line FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, rect_id ORDER BY side DESC, total DESC, figure DESC, line % 2, tier DESC, length(text) DESC, page, y0, x0) AS rk FROM s) WHERE rk = 1""")
def w05_best_for_score(spark, sf_dir):
    own = F.floor(F.col("line") / 5).cast("int")
    said = F.element_at(F.array(F.lit("Dr receivables and cr cash"), F.lit("Aggregate of the 1,250 items"), F.lit("Reserves of 5000 or 12,500")), (own % 3 + 1).cast("int"))
    c = layout.lines(words(spark, sf_dir)).select("submission_id", own.alias("rect_id"), "page", "line", *geometry.BOX, "text", said.alias("criterion"), (F.col("line") % 2).alias("place"))
    return geometry.best_for_score(c).select("submission_id", "rect_id", "line")


_SCORE6 = r"length(regexp_replace(g, '[^,£$%×]', '', 'g')) + len(list_filter(string_split(g, ' '), lambda w: regexp_matches(w, '^(?:[0-9]|FV|NCI|OCI)|[0-9].*[0-9]'))) + len(list_filter(string_split(g, ' '), lambda w: regexp_matches(w, '^[A-Z]') AND length(w) > 2))"


@query(rf"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1))) AS i FROM d)), s AS (SELECT doc_id, g, i, {_SCORE6} AS score FROM g),
b AS (SELECT doc_id, g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rk FROM s WHERE score > 0) WHERE rk = 1)
SELECT d.doc_id, CASE WHEN len(ws) >= 2 THEN coalesce(b.g, array_to_string(ws[1:6], ' ')) END AS chunk FROM d LEFT JOIN b USING (doc_id)""")
def w06_telling_chunk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", A.telling_chunk(F.col("text")).alias("chunk"))


_NUMBER = r"(?i)\b[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*[mk])?\b|\b[0-9]+\s*/\s*[0-9]+\b"


@query(rf"""{VIEW}, t AS (SELECT submission_id, item_pos, criterion, CASE WHEN len(regexp_extract_all(split_part(criterion, '=', 1), '{_NUMBER}')) > 0 THEN regexp_extract_all(split_part(criterion, '=', 1), '{_NUMBER}') ELSE regexp_extract_all(criterion, '{_NUMBER}') END AS ns FROM r)
SELECT submission_id, item_pos, (list_transform(list_reverse_sort(list_transform(list_filter(ns, lambda x: CAST(x AS DOUBLE) >= 1), lambda x: [CAST(x AS DOUBLE), CAST(length(x) AS DOUBLE)])), lambda y: CAST(CAST(y[1] AS BIGINT) AS VARCHAR)))[1] AS number FROM t""")
def w06_result_number(spark, sf_dir):
    return prepared(spark, sf_dir).select(*KEY, A.result_number(F.col("criterion")).alias("number"))


@query(r"""SELECT conv_id, turn, md5(array_to_string(ws[greatest(1, 4 - 3):greatest(1, 4 - 3) + 3], ' ')) AS grown FROM (SELECT conv_id, turn, list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '') AS ws FROM conversations) WHERE len(ws) >= 8
  AND regexp_replace(lower(ws[4]), '[^a-z0-9_]+', '', 'g') NOT IN (regexp_replace(lower(ws[1]), '[^a-z0-9_]+', '', 'g'), regexp_replace(lower(ws[2]), '[^a-z0-9_]+', '', 'g'), regexp_replace(lower(ws[3]), '[^a-z0-9_]+', '', 'g'))""")
def d04_grown_phrase(spark, sf_dir):
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^A-Za-z0-9_]+", ""))
    rows = table(spark, sf_dir, "conversations").withColumn("ws", F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).filter("size(ws) >= 8")
    rows = rows.filter(~F.array_contains(F.transform(F.slice("ws", 1, 3), bare), bare(F.get("ws", 3))))
    return rows.select("conv_id", "turn", F.md5(A.grown_phrase(F.get("ws", 3), F.col("text"))).alias("grown"))


@query(rf"""{WORDS}, {_RANKED}, a AS (SELECT *, list_filter(string_split_regex(trim(evidence), '\s+'), lambda w: w <> '') AS ws FROM e),
f AS (SELECT a.submission_id, evidence_id, l.page, l.y0, l.x0, l.text, contains(lower(l.text), lower(evidence)) AS whole, page_rank FROM a JOIN lines l USING (submission_id) JOIN ranked USING (submission_id, evidence_id) WHERE ranked.page = l.page)
SELECT submission_id, evidence_id, page, y0 FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, evidence_id ORDER BY page_rank, page, y0, x0) AS rk FROM f WHERE whole) WHERE rk = 1""")
def l03_resolve_exact(spark, sf_dir):
    """The tiers below the first are compared with a brute-force version in the tests."""
    out = geometry.resolve_anchors(evidence(spark, sf_dir), layout.lines(words(spark, sf_dir)))
    return out.filter("tier = 1").select("submission_id", "evidence_id", "page", "y0")


@query(f"{WORDS} SELECT r.submission_id, rect_id, r.page, greatest(l.x0, 10.0) AS from_x, least(l.x1, {WIDTH - 50}) AS to_x, l.y1 + 2 AS y FROM rects r JOIN lines l ON l.submission_id = r.submission_id AND l.line = r.rect_id")
def l08_underlines(spark, sf_dir):
    w, r = rects(spark, sf_dir)
    return geometry.underlines(r, layout.lines(w), w, WIDTH)


@query(f"""{WORDS}, t AS (SELECT *, unnest(range(1, rect_id % 3 + 1)) AS tick, rect_id % 3 AS n FROM rects), s AS (SELECT *, (x0 + x1) / 2 - (n * 5 + (n - 1) * 1) / 2.0 + (tick - 1) * 6 AS x, y0 - 1 AS b FROM t)
SELECT submission_id, rect_id, page, CAST(tick AS INTEGER) AS tick, 1 AS stroke, x AS from_x, b - 1 AS from_y, x + 1 AS to_x, b + 2 AS to_y FROM s UNION ALL SELECT submission_id, rect_id, page, CAST(tick AS INTEGER), 2, x + 1, b + 2, x + 5, b - 4 FROM s""")
def l08_tick_marks(spark, sf_dir):
    _, r = rects(spark, sf_dir)
    return geometry.tick_marks(r.withColumn("n", F.col("rect_id") % 3))


@query(f"{WORDS} SELECT submission_id, rect_id, page, x0, x1, y0 + 5 AS y, least(x1 + 6, {WIDTH - 80}) AS label_x, y1 - 1 AS label_y, 'Not required' AS label FROM rects")
def l08_not_required(spark, sf_dir):
    _, r = rects(spark, sf_dir)
    return geometry.not_required(r, WIDTH)


@query(f"""{WORDS}, f AS (SELECT submission_id, page, x0, y0, y1, starts_with(lower(text), 'profit') AS hit, y1 > 0.8 * max(y1) OVER (PARTITION BY submission_id, page) AS low, count(*) OVER (PARTITION BY submission_id, page ORDER BY y0 RANGE BETWEEN 1 FOLLOWING AND 80 FOLLOWING) AS below FROM lines),
m AS (SELECT submission_id, page, x0, y0, row_number() OVER (PARTITION BY submission_id ORDER BY page, y0) AS rk FROM f WHERE hit AND (low OR below > 0))
SELECT s.submission_id, coalesce(m.page, s.page) AS page, coalesce(m.x0 - 40, 30.0) AS x, coalesce(m.y0 + 2, 30.0) AS y, m.page IS NOT NULL AS at_heading FROM (SELECT submission_id, min(page) AS page FROM lines GROUP BY 1) s LEFT JOIN m ON m.submission_id = s.submission_id AND rk = 1""")
def l09_main_score(spark, sf_dir):
    return geometry.main_score_place(layout.lines(words(spark, sf_dir)), "7", "Profit")


@query(f"""{WORDS}, fw AS (SELECT * FROM words WHERE regexp_matches(text, '[0-9]')), m AS (SELECT r.submission_id, rect_id, r.page, f.text AS value, f.x0 AS vx0, f.y0 AS vy0, CASE WHEN f.line = r.rect_id AND f.x0 >= r.x0 THEN 0 WHEN f.y0 >= r.y1 - 1 AND f.y0 - r.y1 <= 18 THEN 1 END AS level FROM rects r JOIN fw f ON f.submission_id = r.submission_id AND f.page = r.page),
b AS (SELECT *, min(level) OVER x AS best FROM m WHERE level IS NOT NULL WINDOW x AS (PARTITION BY submission_id, rect_id)), k AS (SELECT *, min(floor(vy0 / 2)) OVER (PARTITION BY submission_id, rect_id) AS first FROM b WHERE level = best)
SELECT submission_id, rect_id AS label_id, page, value, vx0 FROM k WHERE level = 0 OR floor(vy0 / 2) = first""")
def j16_value_rows(spark, sf_dir):
    w, r = rects(spark, sf_dir)
    return layout.value_rows(r.withColumnRenamed("rect_id", "label_id"), w).select("submission_id", "label_id", "page", "value", "vx0")


_HEADS = "hd AS (SELECT submission_id, page, CASE WHEN word % 2 = 0 THEN 'even' ELSE 'odd' END AS col, x0 AS hx0, x1 AS hx1, y1 AS hy1 FROM words WHERE line % 4 = 0)"


@query(f"""{WORDS}, {_HEADS}, tg AS (SELECT submission_id, line AS target_id, page, y0, CASE WHEN line % 3 = 0 THEN 'even' ELSE 'odd' END AS col FROM lines),
ab AS (SELECT * FROM (SELECT t.submission_id, target_id, t.page, t.y0, t.col, hx0, hx1, row_number() OVER (PARTITION BY t.submission_id, target_id ORDER BY h.page DESC, hy1 DESC, hx0) AS rk FROM tg t JOIN hd h ON h.submission_id = t.submission_id AND h.col = t.col AND (h.page < t.page OR (h.page = t.page AND hy1 <= t.y0 + 1))) WHERE rk = 1),
vs AS (SELECT a.*, w.x0 AS vx0, w.text AS value, w.x0 >= hx0 - 3 AS under, CASE WHEN w.x0 >= hx0 - 3 THEN abs(w.x0 - hx0) ELSE abs((w.x0 + w.x1) / 2 - (hx0 + hx1) / 2) END AS dist FROM ab a JOIN words w ON w.submission_id = a.submission_id AND w.page = a.page AND abs(w.y0 - a.y0) <= 2 AND regexp_matches(w.text, '[0-9]'))
SELECT submission_id, target_id, value, vx0 FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, target_id ORDER BY under DESC, dist, vx0) AS k FROM vs) WHERE k = 1""")
def j15_column_values(spark, sf_dir):
    w = words(spark, sf_dir)
    column = F.when(F.col("word") % 2 == 0, "even").otherwise("odd").alias("column")
    heads = w.filter("line % 4 = 0").select("submission_id", "page", column, *geometry.BOX)
    targets = layout.lines(w).select("submission_id", F.col("line").alias("target_id"), "page", "y0", "y1", F.when(F.col("line") % 3 == 0, "even").otherwise("odd").alias("column"))
    return layout.column_values(targets, w, heads).select("submission_id", "target_id", "value", "vx0")


@query(f"""{WORDS}, n AS (SELECT submission_id, text AS figure, page, x0, y0 FROM words WHERE regexp_matches(text, '[0-9]')),
s AS (SELECT n.submission_id, n.figure, n.page, n.x0, n.y0, count(DISTINCT CASE WHEN abs(w.y0 - n.y0) <= 6 AND lower(regexp_replace(w.text, '[^A-Za-z0-9]', '', 'g')) IN ('receivables', 'profit', 'less', 'cost') THEN lower(regexp_replace(w.text, '[^A-Za-z0-9]', '', 'g')) END) AS shared FROM n LEFT JOIN words w ON w.submission_id = n.submission_id AND w.page = n.page GROUP BY 1, 2, 3, 4, 5)
SELECT submission_id, figure AS number_id, page, x0, y0, shared FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, figure ORDER BY shared DESC, page, y0, x0) AS rk FROM s) WHERE rk = 1""")
def j17_number_context(spark, sf_dir):
    w = words(spark, sf_dir)
    numbers = w.filter(F.col("text").rlike("[0-9]")).select("submission_id", F.col("text").alias("number_id"), F.array(*map(F.lit, ("receivables", "profit", "less", "cost"))).alias("context"), "page", *geometry.BOX)
    return layout.number_context(numbers, w).select("submission_id", "number_id", "page", "x0", "y0", "shared")


@query(rf"""{WORDS}, h AS (SELECT submission_id, regexp_extract(trim(text), '^([0-9]+(?:\.[0-9]+)?)', 1) AS question, min((page, y0)) AS place FROM lines WHERE regexp_matches(trim(text), '^[0-9]') GROUP BY 1, 2)
SELECT submission_id, question, place[1] AS page, place[2] AS y_min, nx[1] AS next_page, nx[2] AS next_y FROM (SELECT *, lead(place) OVER (PARTITION BY submission_id ORDER BY place) AS nx FROM h WHERE question <> '')""")
def f23_question_bounds(spark, sf_dir):
    lines = layout.lines(words(spark, sf_dir))
    from ..functions import text as X

    asked = lines.select("submission_id", X.title_number(F.col("text")).alias("question")).filter("question <> ''").distinct()
    return layout.question_bounds(lines, asked)


@query(rf"""{WORDS}, f AS (SELECT l.submission_id, line % 5 AS item_pos, line, text, ([ 'Dr Receivables', 'Cr Revenue', 'Cash'])[CAST(line % 5 % 3 + 1 AS INTEGER)] AS c FROM lines l),
s AS (SELECT *, regexp_extract(lower(c), '^(dr|cr)\b', 1) AS side FROM f), k AS (SELECT *, side = '' OR NOT (CASE WHEN side = 'dr' THEN regexp_matches(lower(text), '\bcr\b') ELSE regexp_matches(lower(text), '\bdr\b') END OR regexp_matches(text, '[0-9] ?[x×*/+] ?[0-9(£]|=')) AS ok FROM s)
SELECT submission_id, item_pos, line FROM (SELECT *, bool_or(ok) OVER (PARTITION BY submission_id, item_pos) AS any_ok FROM k) WHERE ok OR NOT any_ok""")
def f24_belonging(spark, sf_dir):
    own = F.col("line") % 5
    said = F.element_at(F.array(F.lit("Dr Receivables"), F.lit("Cr Revenue"), F.lit("Cash")), (own % 3 + 1).cast("int"))
    return layout.belonging(layout.lines(words(spark, sf_dir)).select("submission_id", own.alias("item_pos"), "line", "text", said.alias("criterion"))).select("submission_id", "item_pos", "line")


@query(f"""{VIEW}, l AS (SELECT submission_id, ls[i] AS t, i - 1 AS line FROM (SELECT submission_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM script)), p AS (SELECT *, regexp_extract_all(t, '\\s*\\S+') AS ps FROM l),
w AS (SELECT submission_id, line, i - 1 AS word, trim(ps[i]) AS text, list_sum(list_transform(ps[1:i], lambda x: length(x))) - length(trim(ps[i])) AS place FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p))
SELECT submission_id, CAST(line AS INTEGER) AS line, CAST(word AS INTEGER) AS word, text, CAST(place * 6.0 AS DOUBLE) AS x0, CAST(line * 14.0 AS DOUBLE) AS y0, CAST((place + length(text)) * 6.0 AS DOUBLE) AS x1 FROM w""")
def s09_text_words(spark, sf_dir):
    pages = scripts(judged(spark, sf_dir)).select("submission_id", F.lit(1).alias("page"), "text")
    return geometry.text_words(pages).select("submission_id", "line", "word", "text", "x0", "y0", "x1")
