"""Chat formatting by quotation linking.

Lines of a message that start with one or more ``>`` are quoted; the number of marks is the level.
Neighbouring lines of one level make a passage, as do neighbouring lines that are not quoted, so a
passage reads the same however it was wrapped. Passages are normalised (marks and outer white space
off, white space single, lower case) and hashed in units: each line, each run of ``RUN`` words, and
the whole of a passage with fewer words. In its conversation a quoted unit points to the latest
earlier message that has the unit itself, not quoted; a quoted passage to the message that most of
its units point to (the latest of equals), whatever its level. A message answers the one that most
units of its least deeply quoted linked passages point to; deeper levels are that message's own quotes.

Messages become reply-ordered conversations: a message without a link starts a thread, a reply
belongs to the thread of the message it answers, and a thread's messages stand in the order of
their turns, which puts every message behind the one it answers. Quoted lines, and an attribution
line ("... wrote:") right above a quote, are taken out of the text; passages without an original
stay with the message as ``unlinked``.

Only units that some quote has are looked up, and only in conversations with quotes, so a line that
a large part of all messages opens with meets nobody unless it is quoted. Looking back is split by
``TURNS`` turns and the order of a thread by ranges of messages, so one conversation with a large
part of all messages is not gathered anywhere.

Defined results: null texts stay null and quote nothing; a quote without an original, and lines
without a letter or digit, link nothing; rows that repeat (conv_id, turn) are messages of their own
with the same links; null keys never link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)^.*(?:wrote|writes|schrieb|écrit|escribió)[^:]{0,80}:[ \t]*$"
#: Words of a unit; turns that look for a unit together.
RUN, TURNS = 5, 4096
KEY = ["conv_id", "turn"]


def _lines() -> Column:
    return F.transform(
        F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
            line.alias("line"),
            F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"[ \t ]+", " "))).alias("norm"),
        ),
    )


def _passages(lines: Column) -> Column:
    """(level, norms, lines) of the runs of neighbouring lines with one ``kind``, those of kind -1 left out."""
    n = F.size(lines)
    kind = lambda i: F.get(lines, i)["kind"]
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (kind(i) != kind(i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    parts = F.zip_with(starts, ends, lambda a, b: F.struct(kind(a).alias("level"), F.slice(lines, a + 1, b - a).alias("part")))
    named = F.transform(parts, lambda p: F.struct(p["level"].alias("level"), p["part"]["norm"].alias("norms"), p["part"]["line"].alias("lines")))
    return F.when(n > 0, F.filter(named, lambda p: p["level"] >= 0))


def _units(norms: Column) -> Column:
    """Hashes of a passage's lines, of its runs of words, and of the whole where it has fewer words."""
    says = lambda x: x.rlike(r"[\p{L}\p{N}]")
    words = F.filter(F.split(F.array_join(norms, " "), " "), lambda w: w != "")

    def runs(w: Column) -> Column:
        n = F.size(w) - RUN + 1
        run = lambda i: F.array_join(F.slice(w, i, F.lit(RUN)), " ")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), run)).otherwise(F.array(F.array_join(w, " ")))

    found = F.concat(norms, F.element_at(F.transform(F.array(words), runs), 1))
    return F.array_distinct(F.transform(F.filter(found, says), lambda x: F.xxhash64(x)))


def _earlier(asked: DataFrame, said: DataFrame) -> DataFrame:
    """Rows of ``asked`` (conv_id, unit, turn, ...) with ``to``, the latest earlier turn that says the unit.

    A running maximum inside each block of turns, and the maximum of all earlier blocks.
    """
    keys = ["conv_id", "unit"]
    block = F.floor(F.col("turn") / TURNS)
    both = said.select(*keys, "turn", F.col("turn").alias("origin")).unionByName(asked.select(*keys, "turn").distinct().withColumn("origin", F.lit(None).cast("long"))).withColumn("block", block)
    inside = Window.partitionBy(*keys, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*keys, "block").agg(F.max("origin").alias("last"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block", F.max("last").over(before).alias("carried"))
    found = both.withColumn("near", F.max("origin").over(inside)).filter("origin is null").join(blocks, [*keys, "block"])
    found = found.select(*keys, "turn", F.coalesce("near", "carried").alias("to")).filter("to is not null")
    return asked.join(found, [*keys, "turn"])


def link_quotations(messages: DataFrame) -> DataFrame:
    """Per row of (conv_id, turn, role, text): text without quotes, n_quoted, parent_turn, root_turn, depth, links, unlinked.

    ``links`` has (level, to, n) of each linked passage in the order of their levels, ``unlinked`` the
    lines of passages without an original.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = rows.withColumn("lines", _lines())
    size = F.size("lines")
    nxt = lambda i: F.get(F.col("lines"), i + 1)["level"]
    above = lambda x, i: (x["level"] == 0) & x["line"].rlike(ATTRIBUTION) & (i + 1 < size) & (F.coalesce(nxt(i), F.lit(0)) > 0)
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~above(x, i))
    clean = F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\n+|\n+$|(?<=\n\n)\n+", ""))
    quoted = F.size(F.filter("lines", lambda x: x["level"] > 0))
    plain = F.when(quoted > 0, clean).otherwise(F.col("text"))
    kinds = F.transform("lines", lambda x, i: F.struct(F.when((x["norm"] == "") | above(x, i), -1).otherwise(x["level"]).alias("kind"), x["norm"].alias("norm"), x["line"].alias("line")))
    parsed = parsed.select(*KEY, "role", F.when(F.col("text").isNotNull(), plain).alias("text"), F.greatest(quoted, F.lit(0)).cast("long").alias("n_quoted"), kinds.alias("kinds"))
    parsed = parsed.select(*KEY, "role", "text", "n_quoted", _passages(F.col("kinds")).alias("passages"))
    parsed = parsed.withColumn("passages", F.transform("passages", lambda p: F.struct(p["level"].alias("level"), F.xxhash64(p["level"], F.array_join(p["norms"], " ")).alias("id"), p["norms"].alias("norms"), p["lines"].alias("lines"))))

    asked = parsed.filter("n_quoted > 0 and conv_id is not null and turn is not null").select(*KEY, F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
    asked = asked.select(*KEY, "p.level", F.col("p.id").alias("passage"), F.explode(_units(F.col("p.norms"))).alias("unit")).distinct()
    asked = stored(asked, "asked")
    lost = lambda linked: F.transform(F.filter("passages", lambda p: (p["level"] > 0) & ~F.array_contains(linked, p["id"])), lambda p: F.array_join(p["lines"], "\n"))
    unlinked = lost(F.coalesce("found.passage", F.array().cast("array<long>")))
    if asked.head(1):
        said = parsed.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").filter("turn is not null")
        said = said.select(*KEY, F.explode(F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: _units(p["norms"])))).alias("unit"))
        said = said.join(asked.select("conv_id", "unit").distinct(), ["conv_id", "unit"], "left_semi").distinct()
        votes = stored(_earlier(asked, said).groupBy(*KEY, "level", "passage", "to").agg(F.count("*").alias("n")), "votes")
        answered = votes.groupBy(*KEY, "level", "to").agg(F.sum("n").alias("n")).groupBy(*KEY).agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "to"))["to"].alias("parent_turn"))
        passages = votes.groupBy(*KEY, "level", "passage").agg(F.max(F.struct("n", "to")).alias("x"))
        passages = passages.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("level", F.col("x.to").alias("to"), F.col("x.n").alias("n"), "passage"))).alias("found"))
        # Each message jumps to its ancestor's ancestor until all stand at their roots.
        table = state = stored(answered.select(*KEY, "parent_turn", F.col("parent_turn").alias("at"), F.lit(1).cast("long").alias("depth")), "threads")
        while True:
            up = state.select("conv_id", F.col("turn").alias("at"), F.col("at").alias("higher"), F.col("depth").alias("more"))
            new = stored(state.join(up, ["conv_id", "at"], "left").select(*KEY, "parent_turn", F.coalesce("higher", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "threads")
            drop_stored(table)
            table, state = new, new.drop("moved")
            if not new.filter("moved").head(1):
                break
        parsed = parsed.join(state.join(passages, KEY), KEY, "left")
    else:
        none = F.lit(None).cast("long")
        parsed = parsed.withColumns({"parent_turn": none, "at": none, "depth": none, "found": F.lit(None).cast("array<struct<level:int,to:long,n:long,passage:long>>")})
    links = F.coalesce(F.transform("found", lambda x: F.struct(x["level"].alias("level"), x["to"].alias("to"), x["n"].alias("n"))), F.array().cast("array<struct<level:int,to:long,n:long>>"))
    return parsed.select(
        *KEY, "role", "text", "n_quoted", "parent_turn", F.coalesce("at", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        links.alias("links"), F.coalesce(unlinked, F.array().cast("array<string>")).alias("unlinked"),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """The rows of ``link_quotations`` with ``position``, the place of each message in its thread, from 0.

    Messages are sorted in ranges; a message's place is its place in its range, behind the thread's
    messages in earlier ranges. Repeated rows take neighbouring places.
    """
    thread, order = ["conv_id", "root_turn"], ["turn", "role", "text"]
    ranged = linked.repartitionByRange(*thread, "turn", F.xxhash64("role", "text")).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    counts = ranged.groupBy(*thread, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*thread).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.struct(*thread).alias("thread"), "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range", *thread).orderBy(*order, "n_quoted", "unlinked")
    placed = ranged.withColumn("here", F.row_number().over(inside)).withColumn("thread", F.struct(*thread))
    joined = placed.join(counts.select(F.col("thread").alias("t"), F.col("range").alias("r"), "before"), F.col("thread").eqNullSafe(F.col("t")) & (F.col("range") == F.col("r")))
    return joined.select(*linked.columns, (F.col("before") + F.col("here") - 1).cast("long").alias("position"))


def build_conversations(ordered: DataFrame, messages_each: int = 64) -> DataFrame:
    """Threads as text: (conv_id, root_turn, part, n_messages, text), at most ``messages_each`` messages of (…, position) a part.

    A message reads "<|role|>", its text and its unlinked quotes; messages without either are left out of the text.
    """
    said = F.concat_ws("\n", F.when(F.size("unlinked") > 0, F.array_join("unlinked", "\n")), F.when(F.col("text") != "", F.col("text")))
    piece = F.when(said != "", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), said, F.lit("\n")))
    parts = ordered.withColumn("part", F.floor(F.col("position") / messages_each)).groupBy("conv_id", "root_turn", "part")
    parts = parts.agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("position", piece.alias("piece")))).alias("pieces"))
    return parts.select("conv_id", "root_turn", "part", "n_messages", F.array_join(F.transform("pieces", lambda x: F.coalesce(x["piece"], F.lit(""))), "").alias("text"))
