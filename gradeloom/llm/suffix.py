"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere goes. Positions are
brought together without losing any: each ``LENGTH``-byte window owns the ``GRAM``-byte gram in it
with the smallest hash (rightmost of equal ones), so equal windows own equal grams at equal
offsets. Consecutive windows that own one gram form a run, with the bytes they cover as its text.

1. Runs whose gram occurs once cannot repeat. Runs with equal text (by 64-bit gram and text
   hashes) are copies; all their windows repeat.
2. Of each gram with several texts one run of each text goes to the index of its hash partition.
   There the runs' texts are concatenated and sorted into a Burrows-Wheeler transform, and
   breadth-first backward extension finds common prefix values in increasing order: an interval
   of strings of length n that ends before an undecided place fixes the value n - 1 there. The
   expansion stops at ``LENGTH``; places still undecided separate equal windows from nothing.
3. A key with more than ``HOT`` texts (a line that a large part of the corpus holds) is split before
   it is indexed. A window around a common stretch has ``LENGTH`` bytes less that stretch to both
   sides together, so at least half of them to one side: each text goes to the key with that half on
   the left, where it has it, and to the one with that half on the right, cut to the windows that
   hold it (on the left, if on both sides). Equal windows meet in one of them. Keys that are still hot are split again; after at
   most nine splits a key is a whole window, whose rows need no index.

Rows of a key that many runs have are never dealt out by it: such keys are sent to the rows.

Defined results: null texts count as empty; texts shorter than ``LENGTH`` lose nothing; rows that
repeat a document are documents of their own and copies of each other; null ids are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_CODE, STEP_BYTES, U64, drop_stored, gram_hashes, join_keys, lean, mix, powers, records, released, steps, stored, utf8
from .winnow import _sliding_min

LENGTH, GRAM, HOT = 200, 64, 1024
#: Bytes of run texts that one transform holds; a key's runs stay together (at most HOT * 336 bytes).
INDEX_BYTES = 1 << 20
#: As in minhash: most document keys (16 bytes each) that are sent to all executors as a filter.
BROADCAST_IDS = 500_000
KEY = ["doc_id", "digest"]
RUN = "gram long, span long, first int, windows int, offset int"


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Row, gram hash, text hash, first window, number of windows, and gram offset in the first window, of all runs."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) + (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 3
    codes = BYTE_CODE[data]
    grams = mix(gram_hashes(codes, gram))
    values = (grams >> U64(32) << U64(32)) | (U64(0xFFFFFFFF) - np.arange(len(grams), dtype=U64))
    at = U64(0xFFFFFFFF) - (_sliding_min(values, length - gram + 1) & U64(0xFFFFFFFF))
    at = at.astype(np.int64)  # of each window start, the place of its gram
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = len(at)
    whole = row[:starts] == row[length - 1 : length - 1 + starts]
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    windows = np.bincount(group[whole], minlength=len(first))
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    offset = at[first] - first
    span = mix((sums[first + windows + length - 1] - sums[first]) * down[first] + (windows.astype(U64) << U64(32)) + offset.astype(U64) * BASE)
    return row[first], grams[at[first]], span, first - offsets[row[first]], windows, offset


def _runs(batches):
    kinds = (("gram", pa.int64()), ("span", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("offset", pa.int32()))
    struct = pa.struct(kinds)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("runs", pa.list_(struct))])
    for batch in batches:
        offsets, data = utf8(batch.column(2))
        for lo, hi in steps(offsets):
            row, gram, span, first, windows, offset = runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
            values = [gram.view(np.int64), span.view(np.int64), *(x.astype(np.int32) for x in (first, windows, offset))]
            column = pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, kinds, strict=True)], names=[n for n, _ in kinds])
            yield records({"doc_id": batch.column(0).slice(lo, hi - lo), "digest": batch.column(1).slice(lo, hi - lo), "runs": pa.ListArray.from_arrays(pa.array(ends), column)}, schema)


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` symbols at least, and the symbols before them in that order.

    Symbols are below 512; the text is a ring, so the one before each suffix always exists. Suffixes that are equal as
    far as they are looked at stand in any order: intervals of strings no longer than ``depth`` are the same in all of them.
    """
    n = len(text)
    padded = np.resize(text.astype(U64), n + 7)
    key = np.zeros(n, U64)
    for j in range(7):
        key = (key << U64(9)) | padded[j : j + n]
    size = 7
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        ordered = key[order]
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        if size >= depth or new.all():
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = (rank.astype(U64) << U64(32)) | np.roll(rank, -size).astype(U64)
        size *= 2
    return order, text[order - 1]


def undecided(before: np.ndarray, length: int) -> np.ndarray:
    """Places i whose suffix shares ``length`` symbols or more with the one before it, from the transform alone.

    Breadth-first: the intervals of strings of length n give, symbol by symbol, the intervals of
    strings one longer. A place is fixed by the first interval that ends before it, and only such
    intervals are extended further.
    """
    n = len(before)
    order = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix one longer stands
    back[order] = np.arange(n)
    symbol_start = np.zeros(n, bool)
    ordered = before[order]
    symbol_start[0] = True
    symbol_start[1:] = ordered[1:] != ordered[:-1]
    open_place = np.ones(n + 1, bool)
    open_place[0] = open_place[n] = False
    lows, highs = np.array([0]), np.array([n - 1])
    for _ in range(length):
        sizes = highs - lows + 1
        total = int(sizes.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(lows)), sizes)
        members = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lows, sizes)
        to = back[members]
        by = np.argsort(to)
        to, owner = to[by], owner[by]
        new = np.ones(total, bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | symbol_start[to[1:]]
        first = np.flatnonzero(new)
        lows, highs = to[first], to[np.append(first[1:], total) - 1]
        fixes = open_place[highs + 1]
        open_place[highs[fixes] + 1] = False
        keep = fixes | (highs == n - 1)  # the topmost interval ends before no place
        lows, highs = lows[keep], highs[keep]
    return np.flatnonzero(open_place)


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text a flag for each of its ``length``-byte windows: does it start anywhere else among the texts."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
    joined[ends - 1] = 0
    order, before = transform(joined, length)
    same = undecided(before, length)
    flags = np.zeros(len(joined), bool)
    flags[order[same]] = True
    flags[order[same - 1]] = True
    return [flags[e - s : max(e - s, e - length)] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


SPANS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())])


def flag_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def _index(batches):
    """Rows (key, doc_id, digest, first, alone, text) sorted by key; whole keys fill one transform after the other."""

    def found(rows):
        out = []
        for (doc_id, digest, first, alone, text), flags in zip(rows, repeated_windows([r[-1] for r in rows]), strict=True):
            if alone:
                out += [(doc_id, digest, first + at, n) for at, n in flag_runs(flags)]
        return records(dict(zip(SPANS.names, map(list, zip(*out, strict=True)), strict=True)), SPANS) if out else None

    rows, size, last = [], 0, None
    for batch in batches:
        for gram, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if gram != last and size >= INDEX_BYTES:
                if (x := found(rows)) is not None:
                    yield x
                rows, size = [], 0
            last = gram
            rows.append(row)
            size += len(row[-1])
    if rows and (x := found(rows)) is not None:
        yield x


CUT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("alone", pa.bool_()), ("lo", pa.int32()), ("hi", pa.int32()), ("bytes", pa.binary())])
CUT_DDL = "key long, doc_id long, digest long, first int, alone boolean, lo int, hi int, bytes binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return records(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)


def _cut(batches):
    """The wanted runs' texts; [lo, hi) is where the gram stands, which all texts of the key share."""
    for batch in batches:
        rows, size = [], 0
        for doc_id, digest, wanted, text in zip(*batch.columns, strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            for w in wanted.as_py():
                rows.append((w["gram"], doc_id.as_py(), digest.as_py(), w["first"], w["alone"], w["offset"], w["offset"] + GRAM, raw[w["first"] : w["first"] + w["windows"] + LENGTH - 1]))
                size += len(rows[-1][-1])
            if size > STEP_BYTES:
                yield _table(rows, CUT)
                rows, size = [], 0
        if rows:
            yield _table(rows, CUT)


def halves(key: int, lo: int, hi: int, text: bytes) -> list[tuple[int, int, int, int, bytes]]:
    """(new key, place of the new text in the old one, lo, hi, new text) with half of the missing bytes on the left and on the right."""
    half = -(-(LENGTH - (hi - lo)) // 2)
    out = []
    for side, (a, b) in enumerate(((lo - half, hi), (lo, hi + half))):
        if half and a >= 0 and b <= len(text):
            # A window with the half on both sides belongs to the left one only.
            begin, end = max(0, b - LENGTH, lo - half + 1 if side else 0), min(len(text), a + LENGTH)
            if end - begin < LENGTH:
                continue
            name = hashlib.blake2b(key.to_bytes(8, "little", signed=True) + bytes([side]) + text[a:lo] + text[hi:b], digest_size=8).digest()
            out.append((int.from_bytes(name, "little", signed=True), begin, a - begin, b - begin, text[begin:end]))
    return out


def _split(batches):
    for batch in batches:
        rows, size = [], 0
        for key, doc_id, digest, first, alone, lo, hi, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(k, doc_id, digest, first + at, alone, a, b, part) for k, at, a, b, part in halves(key, lo, hi, text)]
            size += 2 * len(text)
            if rows and size > STEP_BYTES:
                yield _table(rows, CUT)
                rows, size = [], 0
        if rows:
            yield _table(rows, CUT)


def _finish(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
    for batch in batches:
        out = []
        for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for first, windows in sorted((f["first"], f["windows"]) for f in found or ()):
                end = first + windows + LENGTH - 1
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([first, end])
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append((doc_id, len(raw), sum(b - a for a, b in spans), spans, b"".join(kept)))
        yield records(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in schema.names}, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, first, windows): all windows of ``docs`` (doc_id, digest, text) that repeat, as runs."""
    made = stored(docs.filter(F.octet_length("text") >= LENGTH).select(*KEY, "text").mapInArrow(released(_runs), f"doc_id long, digest long, runs array<struct<{RUN.replace(' ', ':')}>>".replace(",:", ", ")), "runs")
    every = made.select(*KEY, F.explode("runs").alias("x")).select(*KEY, "x.*")
    twice = stored(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    shared = stored(join_keys(every, twice, ["gram"], "n").drop("n"), "shared")
    drop_stored(made, twice)
    spans = shared.groupBy("gram", "span").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "first", "windows", "offset")).alias("rep"))
    spans = stored(spans, "spans")
    same = spans.filter("copies > 1").select("gram", "span", "copies")
    found = join_keys(shared, same, ["gram", "span"], "copies").select(*KEY, "first", "windows")
    several = stored(spans.groupBy("gram").agg(F.count("*").alias("texts")).filter("texts > 1"), "several")
    wanted = join_keys(spans, several, ["gram"], "texts").select("rep.*", "gram", (F.col("copies") == 1).alias("alone"))
    wanted = stored(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "first", "windows", "offset", "alone")).alias("wanted")), "wanted")
    drop_stored(several)
    # Document keys only; sent everywhere only if their count allows.
    small = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("digest").distinct()
    texts = docs.join(F.broadcast(ids) if small else ids, "digest", "left_semi").dropDuplicates(KEY)
    cut = wanted.join(texts, (wanted.digest == texts.digest) & wanted.doc_id.eqNullSafe(texts.doc_id)).select(wanted.doc_id, wanted.digest, "wanted", "text")
    todo = stored(cut.mapInArrow(released(_cut), CUT_DDL), "cut")
    drop_stored(wanted)
    while True:
        hot = stored(todo.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot")
        n = hot.count()
        known = F.broadcast(hot) if n <= BROADCAST_IDS else hot
        cold = (todo.join(known, "key", "left_anti") if n else todo).select("key", *KEY, "first", "alone", "bytes")
        found = found.union(cold.repartition("key").sortWithinPartitions("key").mapInArrow(released(_index), "doc_id long, digest long, first int, windows int"))
        if not n:
            return found
        held = todo.join(known, "key", "left_semi").select(*todo.columns)
        whole = F.col("hi") - F.col("lo") == LENGTH
        found = found.union(held.filter(whole & F.col("alone")).select(*KEY, "first", F.lit(1).alias("windows")))
        todo = stored(held.filter(~whole).mapInArrow(released(_split), CUT_DDL), "cut")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, spans (removed byte ranges) and kept (remaining bytes)."""
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    found = repeated_spans(docs).groupBy(*KEY).agg(F.collect_list(F.struct("first", "windows")).alias("found"))
    found = found.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "found")
    full = docs.join(found, (docs.digest == found.of_digest) & docs.doc_id.eqNullSafe(found.of_id), "left").select("doc_id", "text", "found")
    return full.mapInArrow(released(_finish), "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
