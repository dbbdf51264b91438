"""Holistic marking: points become half-mark ticks, leaves roll up to capped sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..functions import text as X

LEAST_WORDS, MOST_WORDS = 4, 6


def key_phrase(point: Column) -> Column:
    """Four to six words of a point: cut to six, stop words off both ends; null with fewer than four left."""
    words = F.filter(F.split(F.trim(point), r"\s+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^A-Za-z0-9]", ""))
    solid = lambda ws: F.transform(ws, lambda w: ~bare(w).isin(*X.STOP_WORDS))

    def trimmed(ws, marks):
        first = F.array_position(marks, True)
        last = F.size(ws) - F.array_position(F.reverse(marks), True) + 1
        return F.when(first > 0, F.slice(ws, first.cast("int"), F.least(F.greatest(last - first + 1, F.lit(0)), F.lit(MOST_WORDS)).cast("int"))).otherwise(F.array().cast("array<string>"))

    cut = lambda ws: X.let(solid(ws), lambda marks: trimmed(ws, marks))
    return X.let(words, lambda w: X.let(cut(w), lambda s: F.when(F.size(s) >= LEAST_WORDS, F.array_join(s, " "))))


def ticks(points: DataFrame) -> DataFrame:
    """P20: one row for each half mark of (submission_id, item_pos, leaf_max, text, marks): the phrase on the first tick of a point only.

    Marks go to halves, half to even, one tick at least; points without a phrase go; ticks beyond the leaf's maximum go.
    """
    n = F.greatest(F.bround(F.col("marks") / 0.5, 0), F.lit(1.0)).cast("int")
    # An outer explode: Spark would work the phrase out once more to filter what an inner one drops.
    made = X.let(key_phrase(F.col("text")), lambda phrase: F.when(phrase.isNotNull(), F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), phrase.alias("phrase")))))
    p = points.select("*", F.explode_outer(made).alias("x")).filter("x is not null").select("*", "x.k", "x.phrase").drop("x")
    order = Window.partitionBy("submission_id", "item_pos").orderBy("point_pos", "k")
    p = p.withColumn("tick", F.row_number().over(order)).filter(F.col("tick") * 0.5 <= X.half(F.col("leaf_max")))
    return p.select("submission_id", "item_pos", "tick", F.lit(0.5).alias("marks"), F.when(F.col("k") == 1, F.col("phrase")).alias("key_phrase"), "text")


def sections(leaves: DataFrame) -> DataFrame:
    """A5: leaves of a parent section (itself if none) summed, capped, in halves; evidence distinct in order, reasons joined, first label."""
    section = F.coalesce("parent_section", "sub_question")
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("item_pos", F.col(c).alias("x")))), lambda s: s["x"])
    g = leaves.withColumn("section", section).groupBy("submission_id", "section").agg(
        F.sum("marks_awarded").alias("sum"), F.sum("max_marks").alias("max"), F.max("section_cap").alias("cap"), F.array_distinct(F.flatten(order("evidence"))).alias("evidence"),
        F.array_join(F.filter(order("reason"), lambda r: r != ""), "; ").alias("reason"), F.min(F.struct("item_pos", "student_label"))["student_label"].alias("student_label"), F.min("item_pos").alias("item_pos"),
    )
    cap = F.coalesce("cap", "max")
    return g.select("submission_id", "item_pos", F.col("section").alias("sub_question"), X.half(F.least("sum", cap)).alias("marks_awarded"), cap.alias("max_possible"), "evidence", "reason", "student_label")


def audited_score(sections: DataFrame, caps: DataFrame) -> DataFrame:
    """Sum of the sections under the judge's own total, in halves, half to even."""
    return sections.groupBy("submission_id").agg(F.sum("marks_awarded").alias("s")).join(caps, "submission_id", "left").select("submission_id", X.half(F.least("s", F.coalesce("cap", "s"))).alias("score"))


def trusted_sections(leaves: DataFrame, trust: float = 0.75) -> DataFrame:
    """(submission_id, parent_section, section_marks, section_cap, trusted): whether the judge gave a capped section ``trust`` of its cap; leaves as in ``sections``."""
    own = leaves.filter("parent_section is not null and section_cap is not null").groupBy("submission_id", "parent_section").agg(F.sum("marks_awarded").alias("section_marks"), F.max("section_cap").alias("section_cap"))
    return own.withColumn("trusted", (F.col("section_cap") > 0) & (F.col("section_marks") >= trust * F.col("section_cap")))


def with_leaf(items: DataFrame, leaves: DataFrame) -> DataFrame:
    """Holistic items (submission_id, model_answer_id, sub_question, ...) with their leaf's section, cap and maximum; unknown leaves keep nulls."""
    meta = leaves.select("model_answer_id", "sub_question", F.col("max_marks").alias("leaf_max"), "section_cap", *(c for c in ("parent_section",) if c in leaves.columns))
    return items.join(meta, ["model_answer_id", "sub_question"], "left")


def best_sentences(scripts: DataFrame, criteria: DataFrame, least: float = 0.34) -> DataFrame:
    """For each criterion (submission_id, criterion_pos, keywords, description) the sentence of its script that supports it best.

    A sentence's score is the share of the keywords that it has (A15); without keywords the description's first six words of over four
    letters are asked for. Ties go to the earlier sentence; criteria whose best score is below ``least`` are not returned.
    """
    # What each side alone decides is worked out before they meet; a pair that shares no key and no phrase is dropped before it is scored.
    s = scripts.select("submission_id", F.posexplode_outer(X.sentences(F.col("text"))).alias("sentence_pos", "sentence")).filter("sentence is not null")
    s = s.withColumn("_low", F.lower("sentence")).withColumn("_said", C.said_keys(F.col("_low")))
    words = F.slice(F.filter(F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(r"\w+"), F.lit(0)), lambda w: F.length(w) > 4), 1, 6)
    asked = criteria.withColumn("keywords", F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(words)).filter("size(keywords) > 0")
    asked = asked.select("submission_id", "criterion_pos", F.size("keywords").alias("_n"), F.explode_outer(F.array(C.asked_keys(F.col("keywords")))).alias("_asked"))
    asked = asked.select("submission_id", "criterion_pos", "_n", "_asked", F.array_distinct(F.flatten(F.flatten("_asked.parts"))).alias("_keys"), F.filter("_asked.phrase", lambda p: p.isNotNull()).alias("_phrases"))
    # A script's sentences are few and are held; its criteria pass by them.
    met = asked.join(s.hint("shuffle_hash"), "submission_id").filter(F.arrays_overlap("_keys", "_said") | F.exists("_phrases", lambda p: F.contains("_low", p)))
    share = F.size(F.filter("_asked", lambda k: C.keywords_met(k, F.col("_low"), F.col("_said")))) / F.col("_n")
    # An outer explode: a filter would work the score out once more for each use.
    scored = met.select("submission_id", "criterion_pos", "sentence_pos", "sentence", F.explode_outer(F.array(share)).alias("score")).filter((F.col("score") > 0) & (F.col("score") >= least))
    best = scored.groupBy("submission_id", "criterion_pos").agg(F.max(F.struct("score", (-F.col("sentence_pos")).alias("p"), "sentence")).alias("x"))
    return best.select("submission_id", "criterion_pos", "x.score", (-F.col("x.p")).alias("sentence_pos"), "x.sentence")


def anchors(sentence: Column, keywords: Column) -> Column:
    """Runs of five, four and six words of a sentence, those around a keyword first, each as its distinct words: what a tick may stand on."""
    words = F.filter(F.split(F.lower(sentence), r"\s+"), lambda w: w != "")
    stems = F.filter(F.flatten(F.transform(keywords, lambda k: F.regexp_extract_all(F.lower(k), F.lit("[a-z]+"), F.lit(0)))), lambda w: F.length(w) >= 3)

    def runs(x: Column) -> Column:
        hits = F.transform(x["words"], lambda w: X.let(F.array(F.regexp_replace(w, "[^a-z]+", "")), lambda said: F.exists(x["stems"], lambda k: C.stem_match(k, said))))
        each = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x["words"]) - n + 1, F.lit(1))), lambda i: F.struct(F.array_contains(F.slice(hits, i, F.lit(n)), True).alias("near"), F.slice(x["words"], i, F.lit(n)).alias("run")))
        every = F.filter(F.concat(each(5), each(4), each(6)), lambda r: F.size(r["run"]) >= LEAST_WORDS)
        ranked = F.concat(F.filter(every, lambda r: r["near"]), F.filter(every, lambda r: ~r["near"]))
        return F.transform(ranked, lambda r: F.array_distinct(F.regexp_extract_all(F.array_join(r["run"], " "), F.lit(r"\w+"), F.lit(0))))

    return X.let(F.struct(words.alias("words"), stems.alias("stems")), runs)


def coverage_audit(rows: DataFrame, new: float = 0.55, more: float = 0.34, per_sentence: int = 4, trust: float = 0.75) -> DataFrame:
    """Ticks for criteria that a sentence clearly meets, under sentence, leaf and section caps at once.

    ``rows``: submission_id, section, section_cap, section_marks, leaf, leaf_max, leaf_ticks, criterion_pos, marks (of the
    criterion), existing (ticks), score and sentence_pos of its best sentence, and where present anchors (see ``anchors``). Sections the
    judge gave ``trust`` of the cap are left alone. Rows are taken in rubric order; each gets as many ticks as it lacks, as long as
    its sentence has under ``per_sentence``, its leaf and section have room, and there is an anchor that shares no word with those taken
    in its sentence. Returns ``rows`` with added ticks.
    """
    has = "anchors" in rows.columns
    wanted = F.greatest(F.round(F.col("marks") * 2).cast("int") - F.col("existing"), F.lit(0))
    fits = F.col("score") >= F.when(F.col("existing") > 0, more).otherwise(new)
    open_ = F.coalesce(F.col("section_marks") < trust * F.col("section_cap"), F.lit(True))
    room = lambda c: F.greatest(F.coalesce(c.cast("int"), F.lit(1_000_000)), F.lit(0))
    r = rows.withColumn("_want", F.when(fits & open_, wanted).otherwise(0))
    mine = F.struct(
        "criterion_pos", F.coalesce(F.col("sentence_pos").cast("long"), F.lit(-1)).alias("sentence"), F.col("leaf").cast("string").alias("leaf"), F.col("section").cast("string").alias("section"), F.col("_want").cast("int").alias("want"),
        room(F.floor(F.col("leaf_max") * 2) - F.col("leaf_ticks")).alias("leaf_room"), room(F.ceil((F.col("section_cap") - F.col("section_marks")) * 2)).alias("section_room"),
        (F.col("anchors") if has else F.array().cast("array<array<string>>")).alias("anchors"),
    )
    kind = "array<struct<criterion_pos:bigint,sentence:bigint,leaf:string,section:string,added:int,words:array<string>>>"

    def take(done: Column, x: Column) -> Column:
        used = lambda name: F.aggregate(F.filter(done, lambda d: d[name].eqNullSafe(x[name])), F.lit(0), lambda a, d: a + d["added"])
        least = F.greatest(F.least(x["want"], F.lit(per_sentence) - used("sentence"), x["leaf_room"] - used("leaf"), x["section_room"] - used("section")), F.lit(0))
        said = F.flatten(F.transform(F.filter(done, lambda d: d["sentence"] == x["sentence"]), lambda d: d["words"]))
        start = F.struct(F.lit(0).alias("n"), said.alias("said"), F.array().cast("array<string>").alias("own"))

        def tick(s: Column, a: Column) -> Column:
            free = (s["n"] < least) & ~F.coalesce(F.arrays_overlap(s["said"], a), F.lit(False))
            return F.when(free, F.struct((s["n"] + 1).alias("n"), F.concat(s["said"], a).alias("said"), F.concat(s["own"], a).alias("own"))).otherwise(s)

        got = F.aggregate(x["anchors"], start, tick)
        added, words = (got["n"], got["own"]) if has else (least, F.array().cast("array<string>"))
        one = F.struct(x["criterion_pos"].cast("bigint").alias("criterion_pos"), x["sentence"].alias("sentence"), x["leaf"].alias("leaf"), x["section"].alias("section"), added.alias("added"), words.alias("words"))
        return F.when(x["want"] > 0, F.concat(done, F.array(one))).otherwise(done)

    # Rows of one script only: tens, not a growing group.
    folded = r.groupBy("submission_id").agg(F.array_sort(F.collect_list(mine)).alias("_rows")).select("submission_id", F.explode(F.aggregate("_rows", F.array().cast(kind), take)).alias("x"))
    folded = folded.select("submission_id", F.col("x.criterion_pos").alias("criterion_pos"), F.col("x.added").alias("added"))
    out = r.drop("_want").withColumn("criterion_pos", F.col("criterion_pos").cast("bigint")).join(folded, ["submission_id", "criterion_pos"], "left")
    return out.withColumn("added", F.coalesce("added", F.lit(0)))
