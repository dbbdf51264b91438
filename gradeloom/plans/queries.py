"""Queries over the driver's tables, one for each operator, with the SQL whose rows they return.

Tables stand in for the marking domain: ``lineitem`` rows are judged rows of the script ``l_orderkey``
(``l_linenumber`` is the rubric position), ``documents`` are scripts, ``benchmark`` the model
passages, ``conversations`` ordered sub-parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Marks of a judged row: discount times quantity, at most 1, in quarters.
def _marks() -> Column:
    return X.quarter(F.least(F.col("l_quantity") * F.col("l_discount"), F.lit(1.0)))


MARKS_SQL = "round_even(least(l_quantity * l_discount, 1.0) / 0.25, 0) * 0.25"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {MARKS_SQL} AS marks FROM lineitem")
def q01_quantise_clamp(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _marks().alias("marks"))


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, {MARKS_SQL} AS marks FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, grouping(l_linenumber) AS is_total, sum(marks) AS s FROM d GROUP BY GROUPING SETS ((l_orderkey), (l_orderkey, l_linenumber)))
SELECT l_orderkey, CASE WHEN is_total = 1 THEN 'TOTAL' ELSE 'line ' || l_linenumber END AS item,
  CASE WHEN is_total = 1 THEN least(floor(s * 2 + 0.5) / 2, 7.0) ELSE s END AS marks FROM g
""")
def q02_report_total_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _marks().alias("marks"))
    sets = rows.groupingSets([["l_orderkey"], ["l_orderkey", "l_linenumber"]], "l_orderkey", "l_linenumber").agg(F.grouping("l_linenumber").alias("is_total"), F.sum("marks").alias("s"))
    total = F.col("is_total") == 1
    return sets.select("l_orderkey", F.when(total, "TOTAL").otherwise(F.concat(F.lit("line "), F.col("l_linenumber"))).alias("item"), F.when(total, F.least(X.half_up(F.col("s")), F.lit(7.0))).otherwise(F.col("s")).alias("marks"))


def _norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(translate({c}, '{X.NBSP}{X.TIMES}{X.EN_DASH}', ' x-')), '[^a-z0-9%/().,\- ]', ' ', 'g'), ' +', ' ', 'g'))"


def _runs(words: Column, n: int) -> Column:
    return F.array_distinct(F.transform(X.ngrams(words, n), lambda g: F.xxhash64(g)))


#: Most short texts whose runs (16 bytes each) are sent to all executors.
BROADCAST_TEXTS = 500_000


def contained(long: DataFrame, short: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (long_id, short_id, both texts) whose ``short_norm`` is part of ``long_norm``.

    They meet by ``by`` and one run of four whole words: words at the ends of the short text may be glued to
    others in the long one, so the run comes from its middle. Only ids travel with the runs; texts join the
    pairs that met. Short texts of under six words have no such run and are compared directly in their block.
    """
    words = F.split("short_norm", " ")
    middle = X.let(words, lambda w: F.when(F.size(w) >= 6, F.xxhash64(F.array_join(F.slice(w, F.floor(F.size(w) / 2).cast("int") - 1, 4), " "))))
    keyed = short.select(*by, "short_id", middle.alias("run"))
    # A query set of this size goes to the rows, so that the runs of the long texts stay where they are.
    keyed = keyed.filter("run is not null")
    keyed = F.broadcast(keyed) if short.count() <= BROADCAST_TEXTS else keyed
    runs = long.select(*by, "long_id", F.explode(_runs(F.split("long_norm", " "), 4)).alias("run"))
    met = runs.join(keyed, [*by, "run"]).select("long_id", "short_id").distinct()
    met = met.join(long.drop(*by), "long_id").join(short.drop(*by), "short_id").filter(F.contains("long_norm", "short_norm"))
    bare = short.filter(F.size(words) < 6)
    rest = long.join(bare, by).filter(F.contains("long_norm", "short_norm")) if by else long.join(bare, F.contains("long_norm", "short_norm"))
    columns = ["long_id", "short_id", "long_norm", "short_norm"]
    return met.select(columns).union(rest.select(columns))


@query(f"""
WITH d AS (SELECT doc_id, {_norm_sql('text')} AS t FROM documents), b AS (SELECT item_id, {_norm_sql('text')} AS t FROM benchmark)
SELECT doc_id, item_id, strpos(d.t, b.t) AS at FROM d JOIN b ON contains(d.t, b.t) WHERE length(b.t) >= 12
""")
def q09_evidence_presence(spark, sf_dir):
    long = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("long_id"), X.evidence_norm(F.col("text")).alias("long_norm"))
    short = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("short_id"), X.evidence_norm(F.col("text")).alias("short_norm")).filter("length(short_norm) >= 12")
    return contained(long, short, []).select(F.col("long_id").alias("doc_id"), F.col("short_id").alias("item_id"), F.expr("instr(long_norm, short_norm)").cast("long").alias("at"))


_SENTENCES_SQL = r"list_filter(list_transform(string_split_regex(regexp_replace({c}, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')"


@query(f"""
WITH s AS (SELECT doc_id, {_SENTENCES_SQL.format(c='text')} AS ss FROM documents)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(ss, lambda s: length(s))), 0) AS BIGINT) AS longest FROM s
""")
def q12_sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("ss"))
    return s.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("ss", F.length)), F.lit(0)).cast("long").alias("longest"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TOKENS_SQL = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) >= {n} AND NOT list_contains(" + _STOP_SQL + ", w))"


@query(f"""
WITH d AS (SELECT doc_id, unnest(list_distinct({_TOKENS_SQL.format(c='text', n=7)})) AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct({_TOKENS_SQL.format(c='text', n=7)})) AS w FROM benchmark),
c AS (SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (w) GROUP BY 1, 2)
SELECT item_id, doc_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS r FROM c) WHERE r = 1
""")
def q13_tokens_overlap(spark, sf_dir):
    def words(name, key):
        return table(spark, sf_dir, name).select(key, F.explode(F.array_distinct(X.tokens(F.col("text"), 7))).alias("w"))

    c = words("benchmark", "item_id").join(words("documents", "doc_id"), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    best = c.groupBy("item_id").agg(F.max(F.struct("shared", (-F.col("doc_id")).alias("d"))).alias("x"))
    return best.select("item_id", (-F.col("x.d")).alias("doc_id"), "x.shared")


def _short_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '[.]$', '')"


_VARIANTS_SQL = (
    "list_distinct(list_concat([CAST(v AS VARCHAR), format('{:,}', v)], CASE WHEN v > 0 AND v < 10000000 THEN [CAST(v * 1000 AS VARCHAR), format('{:,}', v * 1000), format('{:,}', v * 1000) || '.00', CAST(v * 1000 AS VARCHAR) || '.00', "
    + _short_sql("v / 1000.0") + ", " + _short_sql("v / 1000.0") + " || 'm'] ELSE [] END, CASE WHEN v >= 1000 AND v % 1000 = 0 THEN [CAST(v // 1000 AS VARCHAR), format('{:,}', v // 1000), CAST(v // 1000 AS VARCHAR) || 'm'] ELSE [] END))"
)


@query(f"""
SELECT p_partkey, len(vs) AS n_variants, array_to_string(list_sort(vs), '|') AS variants FROM (
  SELECT p_partkey, {_VARIANTS_SQL} AS vs FROM (SELECT p_partkey, CAST(p_size * 250 AS BIGINT) AS v FROM part))
""")
def q14_value_variants(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", X.value_variants(F.col("p_size") * 250).alias("vs"))
    return v.select("p_partkey", F.size("vs").cast("long").alias("n_variants"), F.array_join(F.array_sort("vs"), "|").alias("variants"))


_NUMBERS_SQL = r"list_transform(regexp_extract_all({c}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda n: replace(n, ',', ''))"


@query(f"""
SELECT doc_id, n AS number, count(*) AS times FROM (SELECT doc_id, unnest({_NUMBERS_SQL.format(c='text')}) AS n FROM documents) WHERE length(regexp_replace(n, '[^0-9]', '', 'g')) >= 2 GROUP BY doc_id, n
""")
def q16_numbers_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]")).select("doc_id", F.explode(X.numbers(F.col("text"))).alias("number"))
    return d.filter(F.length(F.regexp_replace("number", "[^0-9]", "")) >= 2).groupBy("doc_id", "number").agg(F.count("*").alias("times"))


@query(r"""
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), ' {3,}', '  ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS t FROM documents)
""")
def q18_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))
