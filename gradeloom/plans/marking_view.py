"""Judged rows and scripts derived from the driver's tables, in Spark and as SQL, for the queries of the marking operators.

Every row of ``lineitem`` is a judged row of the script ``l_orderkey``. Its part says which criterion it
is about and its supplier what evidence was given; both texts hold a figure of the part. A script's text is
the evidence of its rows, some of it withheld, under a header for each three rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
REFERENCE = "Background: the company won new contracts in two regions. Explain the results."
#: Texts with {f}, {n} and {p}: the part's figure, a small number, and their product.
CRITERIA = [
    "Profit for the year {f}", "Revenue growth is explained by new contracts which the company won in two regions during spring", "Goodwill on acquisition ({n} x GBP{f})",
    "Dr Receivables {f}", "Cr Revenue {f}", "An external audit is required before the company can be listed on the exchange", "Depreciation charge for the building {f}",
    "Exchange movement on the loan is recognised in profit for the period ended in May", "Share of reserves '{n} x {f} = {p}'", "Cash",
    "Directors must consider the going concern basis and disclose material uncertainty", "Impairment of goodwill is charged against reserves of the group",
    "Contribution per unit {f}", "Investment in associate accounted with the equity method at year end", "Net assets at acquisition GBP{f}", "Opening balance and movement for the year",
]
CATEGORIES = {2: "calculation", 3: "journal", 4: "journal", 8: "calculation", **dict.fromkeys((1, 5, 7, 10, 11, 13), "narrative")}
EVIDENCE = [
    [], None, ["Profit for the year is {f} in total"], ["{f}"], ["No external audit is required here"], ["new contracts in two regions explain the growth of revenue"], ["({f})", "less {f} of cost"],
    ["Dr receivables {f}", "dr  receivables | {f}"], ["= {n} x {f}"], ["abc"], ["forex loss on the loan went to income"], ["The company won new contracts in two regions."],
    ["Total assets | {f}", "total assets|{f}", "Cash"], ["Credit revenue", "equity method for the associate"],
]
REASONS = ["", "Own figure of the student.", "The working is not shown anywhere.", "Full credit.", "Stated in line two."]


#: Rows of ``lineitem`` that one task gets. Words, lines and pairs of a script are up to some dozen for each row and stay in its task.
TASK_ROWS = 20_000


def _spoken(text: Column) -> Column:
    for mark in "fnp":
        text = F.replace(text, F.lit("{" + mark + "}"), F.col(mark).cast("string"))
    return text


def _pick(key: Column, values: list, kind: str) -> Column:
    """The value at ``key``: a literal array, as a branch for each value makes methods that Java never compiles."""
    each = [F.lit(None) if v is None else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values]
    return F.get(F.array(*(v.cast(kind) for v in each)), key)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows with the columns of all guards; (submission_id, item_pos) is unique.

    Scripts are spread over as many tasks as the table needs, so a task's share does not grow with it; what is derived by script
    is not shuffled again, as joins that have the script among their keys take tables that are spread by scripts as they are.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = li.repartition(li.count() // TASK_ROWS + 1, "l_orderkey")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    b = li.select("*", rank.alias("item_pos"), ((F.col("l_partkey") % 40 + 1) * 125).alias("f"), (F.col("l_suppkey") % 9 + 2).alias("n")).withColumn("p", F.col("n") * F.col("f"))
    group = F.element_at(F.array(F.lit("MM"), F.lit("SOC"), F.lit("NY")), (F.col("l_partkey") % 3 + 1).cast("int"))
    most = F.when(F.col("l_linenumber") % 3 == 0, 1.0).when(F.col("l_linenumber") % 3 == 1, 0.5).otherwise(2.0)
    b = b.withColumns({"group": group, "max_possible": most, "kind": F.col("l_partkey") % len(CRITERIA), "said": (F.col("l_suppkey") + F.col("l_linenumber")) % len(EVIDENCE)})
    q = F.col("l_quantity").cast("int") % 5
    marks = F.when(q == 0, 0.0).when(q == 1, F.col("max_possible")).when(q == 2, F.col("max_possible") / 2).when(q == 3, 0.625).otherwise(F.col("max_possible") + 1)
    evidence = F.transform(_pick(F.col("said"), EVIDENCE, "array<string>"), _spoken)
    component = F.when(F.col("l_partkey") % 5 == 0, F.concat("group", F.lit(".OF"), F.col("l_partkey") % 2))
    none = F.array().cast("array<string>")
    return b.select(
        F.col("l_orderkey").alias("submission_id"), "item_pos", F.concat("group", F.lpad((F.col("item_pos") + 1).cast("string"), 2, "0")).alias("criterion_id"), _spoken(_pick(F.col("kind"), CRITERIA, "string")).alias("criterion"),
        F.coalesce(_pick(F.col("kind"), [CATEGORIES.get(i, "") for i in range(len(CRITERIA))], "string"), F.lit("")).alias("category"), (F.col("l_returnflag") == "R").alias("exact_match"),
        marks.alias("marks_awarded"), "max_possible", _pick(F.col("l_suppkey") % 5, REASONS, "string").alias("reason"), evidence.alias("evidence"),
        "group", F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") % 50).cast("int").alias("position"),
        F.when(F.col("l_partkey") % 4 == 1, "Total").when(F.col("l_partkey") % 4 == 2, "NCI").alias("column_header"),
        component.alias("of_component_of"), F.when(component.isNotNull(), F.col("f")).alias("of_produces"),
        F.when(F.col("l_partkey") % 7 == 0, F.array(F.concat("group", F.lit(".OF1")))).otherwise(none).alias("of_source_ids"),
        F.col("f").cast("double").alias("expected_amount"), (F.col("l_linestatus") == "O").alias("sign_sensitive"), F.lit(False).alias("blocked"), (F.col("l_suppkey") % 4 == 0).alias("withheld"),
    )


def scripts(rows: DataFrame) -> DataFrame:
    """The scripts of judged rows: submission_id, text, reference."""
    header = F.when(F.col("item_pos") % 3 == 0, F.concat(F.lit("--- Part "), F.col("item_pos"), F.lit(" ---\n"))).otherwise("")
    body = F.when(F.col("withheld"), "nothing to say").otherwise(F.coalesce(F.array_join("evidence", "\n"), F.lit("none")))
    pieces = F.array_sort(F.collect_list(F.struct("item_pos", F.concat(header, body).alias("piece"))))
    return rows.groupBy("submission_id").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "\n").alias("text")).withColumn("reference", F.lit(REFERENCE))


def _sql_text(text: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for mark in "fnp":
        out = f"replace({out}, '{{{mark}}}', CAST({mark} AS VARCHAR))" if "{" + mark + "}" in text else out
    return out


def _sql_pick(key: str, values: list, make) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {make(v)}" for i, v in enumerate(values)) + " END"


_EVIDENCE_SQL = _sql_pick("said", EVIDENCE, lambda v: "CAST(NULL AS VARCHAR[])" if v is None else "CAST([" + ", ".join(map(_sql_text, v)) + "] AS VARCHAR[])")
_GROUP_SQL = "(['MM', 'SOC', 'NY'])[CAST(l_partkey % 3 + 1 AS INTEGER)]"

#: Common table expressions: ``judged`` (with no null evidence) and ``script``, and ``r``, both joined.
VIEW = f"""WITH RECURSIVE li AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1 AS INTEGER) AS item_pos, (l_partkey % 40 + 1) * 125 AS f, l_suppkey % 9 + 2 AS n, (l_suppkey % 9 + 2) * (l_partkey % 40 + 1) * 125 AS p,
    {_GROUP_SQL} AS grp, CASE l_linenumber % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS max_possible, l_partkey % {len(CRITERIA)} AS kind, (l_suppkey + l_linenumber) % {len(EVIDENCE)} AS said FROM lineitem),
raw AS (
  SELECT l_orderkey AS submission_id, item_pos, grp || lpad(CAST(item_pos + 1 AS VARCHAR), 2, '0') AS criterion_id, {_sql_pick('kind', CRITERIA, _sql_text)} AS criterion,
    {_sql_pick('kind', [CATEGORIES.get(i, '') for i in range(len(CRITERIA))], _sql_text)} AS category, l_returnflag = 'R' AS exact_match,
    CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN max_possible WHEN 2 THEN max_possible / 2 WHEN 3 THEN 0.625::DOUBLE ELSE max_possible + 1 END AS marks_awarded, max_possible,
    {_sql_pick('l_suppkey % 5', REASONS, _sql_text)} AS reason, {_EVIDENCE_SQL} AS given, grp, CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_partkey % 50 AS INTEGER) END AS position,
    CASE l_partkey % 4 WHEN 1 THEN 'Total' WHEN 2 THEN 'NCI' END AS column_header, CASE WHEN l_partkey % 5 = 0 THEN grp || '.OF' || (l_partkey % 2) END AS of_component_of, CASE WHEN l_partkey % 5 = 0 THEN f END AS of_produces,
    CASE WHEN l_partkey % 7 = 0 THEN [grp || '.OF1'] ELSE CAST([] AS VARCHAR[]) END AS of_source_ids, CAST(f AS DOUBLE) AS expected_amount, l_linestatus = 'O' AS sign_sensitive, l_suppkey % 4 = 0 AS withheld, f, n, p, kind, said FROM li),
judged AS (SELECT *, coalesce(given, CAST([] AS VARCHAR[])) AS evidence FROM raw),
script AS (
  SELECT submission_id, string_agg(CASE WHEN item_pos % 3 = 0 THEN '--- Part ' || item_pos || ' ---' || chr(10) ELSE '' END || CASE WHEN withheld THEN 'nothing to say' ELSE coalesce(array_to_string(given, chr(10)), 'none') END, chr(10) ORDER BY item_pos) AS text FROM raw GROUP BY submission_id),
r AS (SELECT judged.*, text, '{REFERENCE}' AS reference FROM judged JOIN script USING (submission_id))
"""
