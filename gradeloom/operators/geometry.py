"""Rectangles on pages: lines and rows around them, wrapped hits, figures in them, anchors to lines, marks to draw.

Tables of rectangles have submission_id, rect_id, page, x0, y0, x1, y1; ``words`` and ``lines`` are those of layout.
y grows downwards. What is drawn comes out as a table too: lines, labels and notes with their places. All joins
have the submission and the page as keys. Ties go up, then left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import criteria as C
from ..functions import text as X
from .layout import ROW_GAP, with_shared

BOX = ["x0", "y0", "x1", "y1"]
RECT = ["submission_id", "rect_id", "page"]
NEXT_LINE, NEXT_VALUE, WRAP_LINES, WRAP_SHARE = 140.0, 240.0, 4, 0.9
FUZZY, STRONG, SAME_FIGURE = 0.45, 0.30, 0.35


def _best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def _named(df: DataFrame, prefix: str, more: list[str] = ()) -> DataFrame:
    return df.select("submission_id", "page", *(F.col(c).alias(prefix + c) for c in (*BOX, *more)))


def _beside(rects: DataFrame, others: DataFrame, more: list[str] = ()) -> DataFrame:
    """Rectangles, each once, with the boxes of their page (``_near``, null without any), so that what is sought is not joined back."""
    pages = others.groupBy("submission_id", "page").agg(F.collect_list(F.struct(*BOX, *more)).alias("_near"))
    rest = [c for c in rects.columns if c not in RECT]
    return rects.join(pages, ["submission_id", "page"], "left").select(*RECT, *rest, "_near")


def _line_at() -> Column:
    """Of the lines ``_near`` a rectangle the one that overlaps it most, null where none does."""
    wide = lambda o: F.least("x1", o["x1"]) - F.greatest("x0", o["x0"])
    high = lambda o: F.least("y1", o["y1"]) - F.greatest("y0", o["y0"])
    met = F.filter("_near", lambda o: (wide(o) > 0) & (high(o) > 0))
    return F.array_min(F.transform(met, lambda o: F.struct((-wide(o) * high(o)).alias("area"), o["y0"].alias("y0"), o["x0"].alias("x0"), o["y1"].alias("y1"), o["x1"].alias("x1"), o["text"].alias("text"))))


def line_of(rects: DataFrame, lines: DataFrame) -> DataFrame:
    """Each rectangle with the line that overlaps it most (line_x0 ..., line_text); itself, without text, where none does."""
    out = _beside(rects, lines, ["text"]).withColumn("_best", _line_at()).drop("_near")
    return out.withColumns({"line_" + c: F.coalesce(F.col("_best")[c], F.col(c)) for c in BOX} | {"line_text": F.col("_best.text")}).drop("_best")


def row_of(rects: DataFrame, words: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """Each rectangle with the box of all words whose middle is at most ``gap`` off its own (row_x0 ...); itself without any."""
    on = F.filter("_near", lambda o: F.abs((o["y0"] + o["y1"] - F.col("y0") - F.col("y1")) / 2) <= gap)
    row = F.aggregate(on, F.struct(*(F.lit(None).cast("double").alias(c) for c in BOX)), lambda a, o: F.struct(F.least(a["x0"], o["x0"]).alias("x0"), F.least(a["y0"], o["y0"]).alias("y0"), F.greatest(a["x1"], o["x1"]).alias("x1"), F.greatest(a["y1"], o["y1"]).alias("y1")))
    out = _beside(rects, words).withColumn("_row", row).drop("_near")
    return out.withColumns({"row_" + c: F.coalesce(F.col("_row")[c], F.col(c)) for c in BOX}).drop("_row")


def next_value_line(rects: DataFrame, lines: DataFrame, down: float = NEXT_LINE) -> DataFrame:
    """The first line below a rectangle, ``down`` points at most, with a figure other than zero; rectangles without one are left out."""
    met = rects.join(_named(lines, "next_", ["text"]), ["submission_id", "page"]).filter((F.col("next_y0") > F.col("y1") + 1) & (F.col("next_y0") <= F.col("y1") + down) & F.col("next_text").rlike("[1-9]"))
    return _best(met, RECT, "next_y0", "next_x0")


def last_figure(rects: DataFrame, words: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """The right-most word of a rectangle's line that has a digit or a currency or percent sign."""
    met = rects.join(_named(words, "value_", ["text"]), ["submission_id", "page"]).filter((F.abs(F.col("value_y0") - F.col("y0")) <= gap) & F.col("value_text").rlike("[0-9£$%]"))
    return _best(met, RECT, F.desc("value_x0"), "value_y0")


def off_headings(rects: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """Rectangles that sit on a heading go to the next line with a figure (``NEXT_VALUE`` points at most); ``moved`` tells which.

    A heading announces something (see criteria.heading_like), or is a short label or a reference such as W1 on a row without values.
    """
    # A page's lines and values are one list each, by which its rectangles pass once.
    pages = lines.groupBy("submission_id", "page").agg(F.collect_list(F.struct(*BOX, "text", F.col("text").rlike("[1-9]").alias("figure"))).alias("_near"))
    values = words.filter(C.value_like(F.col("text"))).groupBy("submission_id", "page").agg(F.collect_list(F.struct("y0", "y1")).alias("_values"))
    on = rects.join(pages, ["submission_id", "page"], "left").join(values, ["submission_id", "page"], "left").withColumn("_best", _line_at())
    on = on.withColumns({"_" + c: F.coalesce(F.col("_best")[c], F.col(c)) for c in ("y0", "y1")} | {"_text": F.col("_best.text")})
    near = lambda v: (F.abs(v["y0"] - F.col("_y0")) <= ROW_GAP) | (F.abs(v["y1"] - F.col("_y1")) <= ROW_GAP)
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce("_text", F.lit("")), r"\s+", " ")))
    parts = F.filter(F.split(norm, " "), lambda w: w != "")
    short = (F.size(parts) <= 3) & (F.length(norm) <= 24)
    reference = norm.rlike("(?:^| )[a-z]{1,3}[0-9]{1,3}(?: |$)")
    bare = ~F.coalesce(F.exists("_values", near), F.lit(False))
    heading = F.coalesce(C.heading_like(F.col("_text")), F.lit(False)) | ((short | reference) & bare)
    below = F.filter("_near", lambda o: o["figure"] & (o["y0"] > F.col("_y1") + 1) & (o["y0"] <= F.col("_y1") + NEXT_VALUE))
    target = F.when(heading, F.array_min(F.transform(below, lambda o: F.struct(o["y0"].alias("y0"), o["x0"].alias("x0"), o["x1"].alias("x1"), o["y1"].alias("y1")))))
    out = on.withColumn("_next", target).withColumn("moved", F.col("_next").isNotNull())
    return out.select(*(F.coalesce(F.col("_next")[c], F.col(c)).alias(c) if c in BOX else c for c in rects.columns), "moved")


def wrapped_hits(hits: DataFrame, share: float = WRAP_SHARE, most: int = WRAP_LINES) -> DataFrame:
    """L4: the group of each hit of a phrase: a hit that covers too little of it takes in those that follow on lower lines.

    ``hits``: submission_id, rect_id (the phrase), page, hit (order on the page), y0, covered and wanted (characters). A
    group ends at ``share`` of the phrase, counting a space for each line end, or at ``most`` lines. Returns hit and ``group``.
    """
    mine = F.struct("hit", "y0", "covered", "wanted")
    each = hits.groupBy(*RECT).agg(F.array_sort(F.collect_list(mine)).alias("hits"))
    start = F.struct(F.lit(-1).cast("long").alias("group"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("double").alias("covered"), F.lit(0.0).alias("y"), F.array().cast("array<struct<hit:long,group:long>>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        goes_on = (s["group"] >= 0) & (s["covered"] < h["wanted"] * share) & (s["lines"] < most) & (h["y0"] > s["y"] + 1)
        group = F.when(goes_on, s["group"]).otherwise(s["group"] + 1)
        return F.struct(group.alias("group"), F.when(goes_on, s["lines"] + 1).otherwise(F.lit(1).cast("long")).alias("lines"), F.when(goes_on, s["covered"] + 1 + h["covered"]).otherwise(h["covered"].cast("double")).cast("double").alias("covered"), h["y0"].cast("double").alias("y"), F.concat(s["out"], F.array(F.struct(h["hit"].cast("long").alias("hit"), group.alias("group")))).alias("out"))

    return each.select(*RECT, F.explode(F.aggregate("hits", start, step, lambda s: s["out"])).alias("x")).select(*RECT, "x.hit", "x.group")


def narrowed(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Rectangles of lines (with ``evidence``) cut to the word that is the evidence's longest figure, where it stands on the line; the first of equals."""
    token = r"[-−(]?[0-9][0-9,]*(?:\.[0-9]+)?"
    tokens = F.array_distinct(F.regexp_extract_all("evidence", F.lit(token), F.lit(0)))
    asked = F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), F.regexp_replace(t, r"^[-−(]", "").alias("t"))))
    on = F.filter("_near", lambda o: (o["y0"] >= F.col("y0") - 2) & (o["y1"] <= F.col("y1") + 2))
    rank = lambda o: F.array_position(F.transform("_asked", lambda x: F.contains(o["text"], x["t"])), True)
    best = F.array_min(F.filter(F.transform("_on", lambda o: F.struct(rank(o).alias("rank"), o["y0"].alias("y0"), o["x0"].alias("x0"), o["x1"].alias("x1"), o["y1"].alias("y1"))), lambda b: b["rank"] > 0))
    return _moved(_beside(rects, words, ["text"]).withColumns({"_asked": asked, "_on": on}).withColumn("_best", best))


def _moved(found: DataFrame) -> DataFrame:
    """Rectangles at their ``_best`` box, if there is one."""
    return found.withColumns({c: F.coalesce(F.col("_best")[c], F.col(c)) for c in BOX}).select(*(c for c in found.columns if c not in ("_near", "_asked", "_on", "_best")))


def figure_in(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Rectangles (with ``number``) moved to the last word at or right of their left edge, within two points of them, that has the number."""
    on = F.filter("_near", lambda o: (o["x0"] >= F.col("x0")) & (o["y0"] >= F.col("y0") - 2) & (o["y1"] <= F.col("y1") + 2) & F.contains(o["text"], F.col("number")))
    best = F.array_max(F.transform(on, lambda o: F.struct(o["y0"].alias("y0"), o["x0"].alias("x0"), o["x1"].alias("x1"), o["y1"].alias("y1"))))
    return _moved(_beside(rects, words, ["text"]).withColumn("_best", best))


def best_for_score(candidates: DataFrame) -> DataFrame:
    """Of the rectangles of a criterion the one to put its score at.

    ``candidates``: RECT, place (order of the evidence), criterion, text (of the line), x0 ... A line that starts with the
    journal side the criterion names wins, then a total for a computed criterion, a figure of four digits that the criterion
    has, the earlier evidence, figures with words before figures before words, and the longer line.
    """
    c, line = F.lower("criterion"), F.coalesce("text", F.lit(""))
    journal = c.rlike(r"^\s*(?:dr|cr|debit|credit)\b|journal")
    side = journal & ((c.rlike(r"dr |debit ") & line.rlike(r"(?i)^\s*(?:dr|debit)\b")) | (c.rlike(r" cr |credit ") & line.rlike(r"(?i)^\s*(?:cr|credit)\b")))
    total = c.rlike(r"\b(?:computed|aggregate|gain\s+on\s+disposal|loss\s+on\s+disposal|final\s+figure|total\s+value|working\s+total)\b") & line.rlike(r"(?i)^\s*(?:total|gain on disposal|loss on disposal)\b")
    figures = F.transform(F.regexp_extract_all("criterion", F.lit(r"[0-9]{1,3}(?:,[0-9]{3})+|\b[0-9]{4,}\b"), F.lit(0)), lambda n: F.regexp_replace(n, ",", ""))
    digits = F.regexp_replace(line, r"[,\s]+", "")
    figure = F.exists(figures, lambda n: F.contains(digits, n))
    digit, alpha = line.rlike("[0-9]"), line.rlike("[A-Za-z]")
    tier = F.when(digit & alpha, 3).when(digit, 2).when(alpha, 1).otherwise(0)
    return _best(candidates, ["submission_id", "rect_id"], F.desc(side.cast("int")), F.desc(total.cast("int")), F.desc(F.coalesce(figure, F.lit(False)).cast("int")), "place", F.desc(tier), F.desc(F.length(line)), "page", "y0", "x0")


def page_tokens(lines: DataFrame) -> DataFrame:
    """The distinct tokens of each page, sorted."""
    return lines.groupBy("submission_id", "page").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(X.tokens(F.col("text")))))).alias("tokens"))


def resolve_anchors(anchors: DataFrame, lines: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """L3: the line each anchor (submission_id, evidence_id, evidence) is to be marked at.

    Tiers: the line has the anchor (1), its most telling words (2), the anchor with symbols made equal, headings excepted (3), or
    enough of its tokens (4): ``FUZZY`` of them, a stated result counting ``SAME_FIGURE``, at least two or one of six letters; failing
    that one token of seven letters on a line with a figure. Within a tier pages by shared tokens, then score, then place decide.
    ``bounds``: submission_id, page, y_min, y_max; lines outside are left out where a page has bounds.
    """
    if bounds is not None:
        lines = lines.join(bounds.select("submission_id", "page", "y_min", "y_max"), ["submission_id", "page"], "left").filter("(y_min is null or y0 >= y_min) and (y_max is null or y0 <= y_max)").drop("y_min", "y_max")
    asked = anchors.withColumns({"_chunk": A.telling_chunk(F.col("evidence")), "_norm": X.symbol_norm(F.col("evidence")), "_number": F.regexp_replace(A.result_number(F.col("evidence")), ",", "")})
    asked = asked.withColumn("_tokens", F.array_distinct(X.tokens(F.coalesce("_chunk", "evidence"))))
    pairs = asked.join(lines.withColumns({"_line": X.symbol_norm(F.col("text")), "_said": F.array_distinct(X.tokens(F.col("text")))}), "submission_id")
    shared = F.array_intersect("_tokens", "_said")
    figure = F.contains(F.regexp_replace(F.lower("text"), "[, ]", ""), F.col("_number"))
    fuzzy = F.size(shared) / F.greatest(F.size("_tokens"), F.lit(1)) + F.when(F.coalesce(figure, F.lit(False)), SAME_FIGURE).otherwise(0.0)
    enough = (F.size(shared) >= 2) | F.exists(shared, lambda w: F.length(w) >= 6)
    strong = F.exists(shared, lambda w: w.rlike("^[a-z]{7,}$")) & F.col("text").rlike("[0-9]")
    contains = lambda part: F.coalesce(F.contains(F.lower("text"), F.lower(part)), F.lit(False))
    tier = (
        F.when(contains(F.col("evidence")), 1).when(contains(F.col("_chunk")), 2)
        .when((F.length("_norm") >= 6) & F.contains("_line", F.col("_norm")) & ~C.heading_like(F.col("text")), 3)
        .when(enough & (fuzzy >= FUZZY), 4).when(strong, 5)
    )
    score = F.when(tier == 4, fuzzy).when(tier == 5, STRONG + 0.2 * F.size(shared) / F.greatest(F.size("_tokens"), F.lit(1))).otherwise(1.0)
    met = pairs.withColumn("tier", tier).filter("tier is not null").withColumn("score", score)
    met = with_shared(met, lines)
    return _best(met, ["submission_id", "evidence_id"], "tier", F.desc("score"), F.desc("_shared"), "page", "y0", "x0").select("submission_id", "evidence_id", "tier", "score", "page", *BOX, "text")


def underlines(rects: DataFrame, lines: DataFrame, words: DataFrame, page_width: float, phrase_only: bool = False) -> DataFrame:
    """The line under each rectangle: two points below its text line, as wide as the phrase or the whole row, inside the page's margins."""
    on = row_of(line_of(rects, lines), words)
    a, b = (F.col("x0") - 1, F.least(F.col("x1") + 1, F.lit(page_width - 10))) if phrase_only else (F.col("row_x0"), F.least(F.col("row_x1"), F.lit(page_width - 50)))
    return on.select(*RECT, F.greatest(a, F.lit(10.0)).alias("from_x"), b.alias("to_x"), (F.col("line_y1") + 2).alias("y"))


def tick_marks(rects: DataFrame) -> DataFrame:
    """For each of ``n`` ticks of a rectangle its two strokes (from_x, from_y, to_x, to_y), centred above it and scaled to its height."""
    scale = F.greatest(F.lit(0.4), F.least(F.lit(1.0), F.greatest(F.col("y1") - F.col("y0"), F.lit(6.0)) / 14.0))
    r = rects.filter("n > 0").withColumns({"_w": F.bround(7 * scale), "_g": F.bround(2 * scale), "_l": F.bround(2 * scale), "_d": F.bround(3 * scale), "_u": F.bround(5 * scale)})
    left = (F.col("x0") + F.col("x1")) / 2 - (F.col("n") * F.col("_w") + (F.col("n") - 1) * F.col("_g")) / 2
    r = r.withColumn("_left", left).withColumn("tick", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("_x", F.col("_left") + (F.col("tick") - 1) * (F.col("_w") + F.col("_g")))
    base, x = F.col("y0") - 1, F.col("_x")
    down = F.struct(F.lit(1).alias("stroke"), x.alias("from_x"), (base - 1).alias("from_y"), (x + F.col("_l")).alias("to_x"), (base + F.col("_d")).alias("to_y"))
    up = F.struct(F.lit(2).alias("stroke"), (x + F.col("_l")).alias("from_x"), (base + F.col("_d")).alias("from_y"), (x + F.col("_w")).alias("to_x"), (base - F.col("_u")).alias("to_y"))
    return r.select(*RECT, "tick", F.explode(F.array(down, up)).alias("s")).select(*RECT, "tick", "s.*")


def not_required(rects: DataFrame, page_width: float) -> DataFrame:
    """A line through each rectangle and the place of its "Not required" label right of it."""
    near = F.least(F.col("x1") + 6, F.lit(page_width - 80))
    label = F.when(near <= F.col("x1"), F.greatest(F.lit(page_width - 80), F.col("x1") + 4)).otherwise(near)
    return rects.select(*RECT, "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("y"), label.alias("label_x"), (F.col("y1") - 1).alias("label_y"), F.lit("Not required").alias("label"))


def main_score_place(lines: DataFrame, question: str, heading: str | None = None, left: float = 250.0, offset: tuple[float, float] = (40.0, 12.0)) -> DataFrame:
    """Where the total of each script goes: left of its question's heading, else the top left corner of its first page.

    A heading is a line near the left margin that starts with the script's own heading or a usual form of the question's
    number, with text in the 80 points below it or in the last fifth of the page.
    """
    # Usual forms of a question's heading.
    forms = [heading] if heading else []
    forms += [f"Question {question}", f"Q-{question.zfill(2)}", f"Q-{question}", f"Q.{question}", f"Q{question}", f"Answer {question}", f"Ans.{question}", f"Ans {question}"]
    # Each form's test by itself: an expression inside a lambda is worked out again for every element.
    rank = F.coalesce(*(F.when(F.startswith("_low", F.lit(f.lower())) & ~F.rlike(F.substr("_said", F.lit(len(f) + 1)), F.lit("^[0-9]")), n) for n, f in enumerate(forms, 1)))
    page = Window.partitionBy("submission_id", "page")
    below = page.orderBy("y0").rangeBetween(1, 80)
    at = lines.withColumn("_said", F.trim("text")).withColumn("_low", F.lower("_said"))
    at = at.select("submission_id", "page", "x0", "y0", rank.alias("_rank"), (F.col("y1") > 0.8 * F.max("y1").over(page)).alias("_low"), F.count("*").over(below).alias("_below"))
    hit = (F.col("_rank") > 0) & (F.col("x0") <= left) & (F.col("_low") | (F.col("_below") > 0))
    # The first page and the first heading in one pass over a script's lines.
    out = at.groupBy("submission_id").agg(F.min("page").alias("_first"), F.min(F.when(hit, F.struct("page", "_rank", "y0", "x0"))).alias("_at"))
    return out.select("submission_id", F.coalesce("_at.page", "_first").alias("page"), F.coalesce(F.col("_at.x0") - offset[0], F.lit(30.0)).alias("x"), F.coalesce(F.col("_at.y0") + offset[1] - 10, F.lit(30.0)).alias("y"), F.col("_at").isNotNull().alias("at_heading"))


def _hits(a, boxes) -> bool:
    left, top, right, bottom = a
    for b in boxes:
        if left < b[2] and b[0] < right and top < b[3] and b[1] < bottom:
            return True
    return False


def _score_places(labels: list[tuple], words: list[tuple], width: float, height: float, font: float) -> list[tuple[float, float]]:
    """Greedy placement on one page, labels (their boxes) in their order: (x, y) of each."""
    boxes = [w for w in words if w[4].strip()]
    # Words with a digit, which a label may go behind.
    figures = [w for w in boxes if any(c.isdigit() for c in w[4])]
    edge = min(max([b[2] for b in boxes], default=width - 70) + 8, width - 60)
    placed: list[tuple] = []
    shape = lambda x, y: (x, y - font - 1, x + 52, y + 3)
    spots = []
    for x0, y0, x1, y1 in labels:
        middle = (y0 + y1) / 2
        own = any(w[0] < x1 + 0.5 and x0 - 0.5 < w[2] and w[1] < y1 + 0.5 and y0 - 0.5 < w[3] for w in figures)
        right = None if own else max((w[2] for w in figures if abs((w[1] + w[3]) / 2 - middle) <= 4), default=None)
        x, y, above = x1 + 3, max(min(y1 - 2, height - 10), 10), max(y0 - font - 2, 10)
        if right is not None and right > x1 + 5:
            x, y = (right + 3, y) if right + 3 < width - 25 else (min(max(right - 25, 50), width - 70), above)
        elif x > width - 25:
            x, y = min(max(x1 - 30, 50), width - 70), above
        x = max(x, 50)
        # On the row first, near before far, then above, at the text's edge, and a little lower.
        spot = free = None
        for t in _tries(x, y, x0, above, edge, width):
            if not _hits(shape(*t), placed):
                if not _hits(shape(*t), boxes):
                    spot = t
                    break
                free = free or t
        if spot is None:
            lower = ((x, min(y + k * (font / 2 + 1), height - 10)) for k in (1, 2, 3))
            spot = free or next((t for t in lower if not _hits(shape(*t), placed)), (x, y))
        placed.append(shape(*spot))
        spots.append(spot)
    return spots


def _tries(x, y, x0, above, edge, width) -> Iterator[tuple[float, float]]:
    yield x, y
    for d in (14, 28, 42, 56):
        yield min(x + d, edge), y
    yield max(x0 - 40, 50), y
    yield x, above
    yield edge, y
    for d in (22, 56, 112, 168):
        if edge + d <= width - 52:
            yield edge + d, y


def _pages(batches: Iterator[pd.DataFrame], columns: list[str], size: int = 4096) -> Iterator[list[list[tuple]]]:
    """The rows of each page (first two columns), some thousand rows of pages together; rows come sorted by page."""
    done: list[list[tuple]] = []
    page: list[tuple] = []
    count = 0
    for batch in batches:
        for row in batch[columns].itertuples(index=False, name=None):
            if page and row[:2] != page[-1][:2]:
                done.append(page)
                count += len(page)
                page = []
                if count >= size:
                    yield done
                    done, count = [], 0
            page.append(row)
    if page:
        done.append(page)
    if done:
        yield done


def place_scores(labels: DataFrame, words: DataFrame, page_width: float, page_height: float, font: float = 9.0) -> DataFrame:
    """Where each score label of (RECT, order, label, x0 ...) goes, so that labels of a page touch neither each other nor, where there is room, its text.

    Behind a figure right of the rectangle, else right of the rectangle; near before far, above the row only if the row is full.
    One page's labels are placed one after the other, so a page is a task's smallest part.
    """
    kinds = dict(labels.dtypes)
    told = ["rect_id", "label"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch.column(c).to_pylist() for c in batch.schema.names if c not in ("submission_id", "page", *told)}
            spots = []
            for *label, x0, y0, x1, y1, said in zip(*(got[c] for c in BOX), *(got["w_" + c] for c in (*BOX, "text")), strict=True):
                words = [] if said is None else list(zip(x0, y0, x1, y1, [t or "" for t in said], strict=True))
                spots.append(_score_places(list(zip(*label, strict=True)), words, page_width, page_height, font))
            # Labels stay as Arrow's own; only boxes and texts of words are Python's.
            lists = {c: batch.column(c) for c in told}
            at = pc.list_parent_indices(lists["rect_id"])
            flat = [(float(x), float(y)) for page in spots for x, y in page]
            columns = [batch.column("submission_id").take(at), lists["rect_id"].flatten(), batch.column("page").take(at), lists["label"].flatten(), pa.array([x for x, _ in flat], pa.float64()), pa.array([y for _, y in flat], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["submission_id", "rect_id", "page", "label", "x", "y"])

    # A page's words and labels are one row each; where both come spread by scripts nothing is shuffled.
    mine = F.struct(F.col("order").cast("long").alias("order"), "rect_id", *BOX, F.col("label").cast("string").alias("label"))
    pages = labels.groupBy("submission_id", "page").agg(F.array_sort(F.collect_list(mine)).alias("_l"))
    known = words.groupBy("submission_id", "page").agg(F.collect_list(F.struct(*BOX, "text")).alias("_w"))
    rows = pages.join(known, ["submission_id", "page"], "left").select("submission_id", "page", *(F.col("_l")[c].alias(c) for c in (*told, *BOX)), *(F.col("_w")[c].alias("w_" + c) for c in (*BOX, "text")))
    return rows.mapInArrow(place, f"submission_id {kinds['submission_id']}, rect_id {kinds['rect_id']}, page {kinds['page']}, label string, x double, y double")


def place_notes(notes: DataFrame, page_width: float, page_height: float, gap: float = 14.0) -> DataFrame:
    """Where each comment's note icon goes: right of its line, or down the right margin where it has none, ``gap`` points apart.

    ``notes``: RECT, order, and x1, y0 of the anchor's line (null without one), y_min, y_max (bounds of the question, null without).
    """
    kinds = dict(notes.dtypes)
    columns = ["submission_id", "page", "rect_id", "x1", "y0", "y_min", "y_max"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages in _pages(batches, columns):
            out = []
            for rows in pages:
                used: list[float] = []
                for submission, page, rect, x1, y0, y_min, y_max in rows:
                    low = 0.0 if pd.isna(y_min) else y_min
                    high = page_height - 20 if pd.isna(y_max) else y_max
                    x = max(page_width - 24, 10) if pd.isna(y0) else max(min(x1 + 6, page_width - 20), 10)
                    first = max(120.0, page_height / 4, low + 10) if pd.isna(y0) else max(min(y0 - 1, page_height - 20), 20)
                    around = [first] + [first + s * k * 16 for k in range(1, 5) for s in (1, -1)]
                    fits = [min(max(y, 20), page_height - 20, max(high - 15, 20)) for y in around]
                    y = next((y for y in fits if all(abs(y - u) > gap for u in used)), fits[-1])
                    used.append(y)
                    out.append((submission, rect, page, float(x), float(y)))
            yield pd.DataFrame(out, columns=["submission_id", "rect_id", "page", "x", "y"])

    rows = notes.select("submission_id", "page", "rect_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y0", "y_min", "y_max")), F.col("order").alias("_order"))
    rows = rows.repartition("submission_id", "page").sortWithinPartitions("submission_id", "page", "_order", "rect_id")
    return rows.mapInPandas(place, f"submission_id {kinds['submission_id']}, rect_id {kinds['rect_id']}, page {kinds['page']}, x double, y double")


def extracted(pages: DataFrame, extractor, schema: str) -> DataFrame:
    """Pages through any extractor: a function from a pandas batch of them to rows of ``schema``; it must answer the same for the same page."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extractor(batch)

    return pages.mapInPandas(run, schema)


def text_words(pages: DataFrame, char: float = 6.0, line: float = 14.0) -> DataFrame:
    """S9/D8 without a parser: words of pages that are plain text (submission_id, page, text), on a grid of characters and lines."""
    lines = pages.select("submission_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "_line"))
    words = lines.withColumn("_words", F.regexp_extract_all("_line", F.lit(r"\s*\S+"), F.lit(0)))
    before = lambda i: F.aggregate(F.slice("_words", F.lit(1), i), F.lit(0), lambda a, w: a + F.length(w))
    placed = F.transform("_words", lambda w, i: F.struct(i.alias("word"), F.trim(w).alias("text"), (before(i) + F.length(w) - F.length(F.trim(w))).alias("at")))
    out = words.select("submission_id", "page", "line", F.explode(placed).alias("w"))
    x0 = F.col("w.at") * char
    return out.select("submission_id", "page", F.lit(0).alias("block"), "line", "w.word", x0.alias("x0"), (F.col("line") * line).alias("y0"), (x0 + F.length("w.text") * char).alias("x1"), (F.col("line") * line + line - 4).alias("y1"), "w.text")
