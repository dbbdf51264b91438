"""Spelling variants by a symmetric-delete join.

Words are counted over whole texts. Every frequent word emits keys of itself and of each of its distinct single
deletions: 64-bit hashes, so a word of L code points costs L keys and not L texts. Words that share a
key meet in an equi-join; two words at distance one share exactly one key, that of the shorter or that without the code
points in which they differ. Met pairs are verified on the words themselves. A key stands for one text, and only words that are
that text with one code point put in share it, so a key's words are bounded by the alphabet and the length, not by
the corpus. Near words are aggregated into a form, and forms are followed to their roots by pointer jumping; a form has at
least twice its word's count, so chains are short and have no cycles.

Defined results: null texts have no words; a null id counts as an empty one in the hash that spoils a run; every row
counts, also where ids or texts repeat; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_INVERSE, U64, drop_stored, lean, mix, powers, records, released, stored

RUN = re.compile("[A-Za-z\\u00C0-\\u00FF]+")
OUTSIDE = re.compile("[^A-Za-z\\u00C0-\\u00FF]")
SHORTEST, RAREST, SPOILED = 5, 3, 97
#: Distinct words a task counts before it hands its counts on, and code points of text that one step looks at.
COUNTED, STEP = 200_000, 1 << 19
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
KEYS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("whole", pa.bool_())])


def parts(text: str):
    """A long text in steps that end outside a run."""
    lo = 0
    while lo < len(text):
        cut = OUTSIDE.search(text, lo + STEP) if len(text) - lo > STEP else None
        hi = cut.end() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def runs(text: str) -> list[str]:
    """The runs of a text, A-Z lower-cased (of all bytes of UTF-8, those alone are)."""
    return RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _count(shortest: int, spoiled: int):
    def run(batches):
        total: Counter = Counter()

        def record():
            kept = {w: n for w, n in total.items() if n and len(w) >= shortest}
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], schema=COUNTS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in parts(text.as_py() or ""):
                    own = runs(part)
                    total.update(own)
                    if spoiled:
                        hits = {r: h for r in set(own) if not (h := zlib.crc32(r.encode(), prefix)) % spoiled}
                        for r in filter(hits.__contains__, own) if hits else ():
                            at = hits[r] % len(r)
                            total[r] -= 1
                            total[r[:at] + r[at + 1 :]] += 1
                    if len(total) > COUNTED:
                        yield record()
        yield record()

    return run


def count_words(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, spoiled: int = SPOILED) -> DataFrame:
    """(word, n) of the words of (doc_id, text); of runs whose hash ``spoiled`` divides one code point goes first (0: of none)."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    lean(docs.sparkSession)
    counted = docs.mapInArrow(released(_count(shortest, spoiled)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, key, whole) of all words: their own keys and those of their distinct single deletions."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    codes = mix(codes + U64(1))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * down[starts]
    # Of equal neighbours only the first goes: the others leave the same text.
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[starts[sizes > 0]] = True
    at = np.flatnonzero(new)
    word = np.searchsorted(ends, at, "right")
    before = (sums[at] - sums[starts[word]]) * down[starts[word]]
    after = (sums[ends[word]] - sums[at + 1]) * down[starts[word]] * BASE_INVERSE
    salt = lambda n: n.astype(U64) * U64(0xD6E8FEB86659FD93)
    keys = np.concatenate([mix(own + salt(sizes)), mix(before + after + salt(sizes[word] - 1))])
    number = np.concatenate([np.arange(len(words)), word])
    return number, keys.view(np.int64), np.arange(len(keys)) < len(words)


def _keys(batches):
    for batch in batches:
        ids, words, lo = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0
        while lo < len(words):
            hi, size = lo, 0
            while hi < len(words) and (hi == lo or size + len(words[hi]) <= STEP):
                size += len(words[hi])
                hi += 1
            number, keys, whole = deletions(words[lo:hi])
            for at in range(0, len(keys), 1 << 16):
                to = at + (1 << 16)
                yield records({"id": ids[lo:hi][number[at:to]], "key": keys[at:to], "whole": whole[at:to]}, KEYS)
            lo = hi


def meet(x: DataFrame, y: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the corpus: by shuffle and merge, whatever size Spark expects.

    Spark takes the keys of ``_keys`` for as small as the file of the words they come from, and would collect them in the driver.
    """
    return x.hint("merge").join(y.hint("merge"), key, how)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) ids of words (id, word) that differ by exactly one inserted, deleted or replaced code point, each pair once."""
    keyed = words.select("id", "word").mapInArrow(released(_keys), "id long, key long, whole boolean")
    x = keyed.select("key", F.col("id").alias("a"), F.col("whole").alias("whole_a"))
    y = keyed.select("key", F.col("id").alias("b"), F.col("whole").alias("whole_b"))
    met = meet(x, y, "key").filter((F.col("a") < F.col("b")) & ~(F.col("whole_a") & F.col("whole_b"))).select("a", "b")
    both = meet(met, words.select(F.col("id").alias("a"), F.col("word").alias("word_a")), "a")
    both = meet(both, words.select(F.col("id").alias("b"), F.col("word").alias("word_b")), "b")
    return both.filter(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of words with a form (id, form_id): forms followed to the last, pointers doubling in each stored round."""
    table = stored(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        far = table.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = stored(meet(table, far, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        drop_stored(table)
        table = new
        if not new.filter("moved").head(1):
            return table.select("id", "root")


def group_variants(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, spoiled: int = SPOILED, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words; a form has at least ``times`` its word's count."""
    words = stored(count_words(docs, shortest, rarest, spoiled).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = stored(near_words(words), "near")
    ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = F.min(F.struct((-F.col("n")).alias("n"), "word", F.col("id").alias("id"))).alias("first")
    near = meet(ends, words.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("of"), "n", "word", F.col("b").alias("id")).groupBy("of").agg(F.count("*").alias("n_near"), first)
    known = meet(words, near.withColumnRenamed("of", "id"), "id", "left").withColumn("has", F.coalesce(-F.col("first.n") >= times * F.col("n"), F.lit(False)))
    of_form = lambda c: F.when(F.col("has"), c)
    known = stored(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), of_form(F.col("first.word")).alias("form"), of_form(-F.col("first.n")).alias("form_n"), of_form(F.col("first.id")).alias("form_id")), "forms")
    ended = roots(known.filter("form_id is not null"))
    of_root = meet(ended, words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = meet(known, of_root, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    drop_stored(pairs)
    return out
