"""The second half of the queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .queries import MARKS_SQL, _marks, query, table


@query(r"""
SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[ \t\n\r]', '', 'g')) AS solid,
  CASE WHEN length(regexp_replace(text, '[ \t\n\r]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(regexp_replace(text, '[ \t\n\r]', '', 'g')) ELSE 0.0 END <= 0.35 AS is_prose FROM documents
""")
def q25_prose_density(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(F.regexp_replace("text", "[^0-9]", "")).cast("long").alias("digits"), F.length(F.regexp_replace("text", r"[ \t\n\r]", "")).cast("long").alias("solid"), X.is_prose(F.col("text")).alias("is_prose"))


@query("""
WITH v AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_quantity AS BIGINT)))) AS vs, max(CAST(l_quantity AS BIGINT)) + min(CAST(l_quantity AS BIGINT)) AS target FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, target, vs, CASE WHEN len(vs) > 12 THEN vs ELSE list_transform(range(1, CAST(pow(2, least(len(vs), 12)) AS BIGINT)), lambda m: list_sum(list_transform(range(0, len(vs)), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN vs[i + 1] ELSE 0 END))) END AS sums FROM v)
SELECT l_orderkey, len(vs) AS n, CAST(target AS BIGINT) AS target, len(list_filter(sums, lambda x: x = target)) AS subsets FROM s
""")
def q27_subset_sums(spark, sf_dir):
    from ..operators.recovery import subset_sums

    q = F.col("l_quantity").cast("long")
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(q)).alias("vs"), (F.max(q) + F.min(q)).alias("target"))
    hits = F.filter(subset_sums(F.col("vs")), lambda x: x == F.col("target"))
    return v.select("l_orderkey", F.size("vs").cast("long").alias("n"), "target", F.size(hits).cast("long").alias("subsets"))


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, sum({MARKS_SQL}) AS marks FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(marks) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT l_orderkey, l_linenumber, marks, greatest(0.0, least(marks, 1.5 - before)) AS awarded FROM b
""")
def q28_running_cap(spark, sf_dir):
    from ..operators.recovery import running_cap

    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(_marks()).alias("marks"))
    return running_cap(p, ["l_orderkey"], ["l_linenumber"], "marks", 1.5).select("l_orderkey", "l_linenumber", "marks", "awarded")


_MESSAGES = [("error", "Error 429: insufficient_quota"), ("view", "Connection timed out"), ("click", "401 invalid_api_key"), ("signup", "no such file"), ("purchase", "mongo server said no")]


@query(f"""
WITH m AS (SELECT event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _MESSAGES)} END || ' ' || props AS msg, lower(CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _MESSAGES)} END || ' ' || props) AS low FROM events)
SELECT event_id, CASE WHEN contains(low, 'insufficient_quota') OR (contains(low, '429') AND contains(low, 'quota')) THEN 'quota' WHEN regexp_matches(low, '429|rate_limit|rate limit') THEN 'rate'
  WHEN regexp_matches(low, '401|invalid_api_key|authentication') THEN 'auth' WHEN regexp_matches(low, 'timeout|timed out|connection|network|ssl') THEN 'network'
  WHEN regexp_matches(low, 'no pages rendered|no such file|filenotfounderror') THEN 'file' WHEN contains(low, 'mongo') THEN 'database' ELSE 'unexpected' END AS kind FROM m
""")
def q31_error_classify(spark, sf_dir):
    said = F.create_map(*(F.lit(x) for pair in _MESSAGES for x in pair))
    return table(spark, sf_dir, "events").select("event_id", X.error_class(F.concat_ws(" ", said[F.col("event_type")], "props")).alias("kind"))


@query(r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark)
SELECT item_id, i AS at, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
""")
def q36_ngrams(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("ws"))
    return w.select("item_id", F.posexplode(X.ngrams(F.col("ws"), 5)).alias("i", "gram")).select("item_id", (F.col("i") + 1).cast("long").alias("at"), "gram")


@query(r"""
SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
  '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS t FROM pages)
""")
def q40_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(r"""
SELECT event_id, regexp_extract(CASE event_id % 4 WHEN 0 THEN 'Question ' || (event_id % 9) || '.' || (event_id % 5) || ': x' WHEN 1 THEN (event_id % 13) || '. Title' WHEN 2 THEN 'Q.' || (event_id % 7) || ' Audit' ELSE event_type END,
  '(?i)^(?:question *|q\.? *)?([0-9]+(?:\.[0-9]+)?)', 1) AS number FROM events
""")
def q41_title_number(spark, sf_dir):
    e = F.col("event_id")
    title = F.when(e % 4 == 0, F.concat(F.lit("Question "), e % 9, F.lit("."), e % 5, F.lit(": x"))).when(e % 4 == 1, F.concat(e % 13, F.lit(". Title"))).when(e % 4 == 2, F.concat(F.lit("Q."), e % 7, F.lit(" Audit"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.title_number(title).alias("number"))


@query(r"""
SELECT event_id, list_transform(string_split(a, ','), lambda x: CAST(x AS INTEGER))[1] AS first_page, len(string_split(a, ',')) + (event_id % 3) AS n_pages FROM (SELECT event_id, (event_id % 9 + 1) || ',' || (event_id % 4 + 1) AS a FROM events)
""")
def q42_page_list(spark, sf_dir):
    e = F.col("event_id")
    pages = X.page_list(F.concat_ws(",", e % 9 + 1, F.concat_ws("-", e % 4 + 1, e % 4 + 1 + e % 3), F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", F.get(pages, 0).alias("first_page"), F.size(pages).cast("long").alias("n_pages"))
