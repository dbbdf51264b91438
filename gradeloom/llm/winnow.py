"""Document fingerprints by winnowing.

Hashes of all ``GRAM``-grams of code points; in each window of ``WINDOW`` consecutive grams the
smallest is chosen, the rightmost of equal ones; chosen grams keep their positions. Two texts that
share ``GRAM + WINDOW - 1`` consecutive code points therefore share a chosen gram there.

Defined results: null and empty texts have an empty fingerprint; a text shorter than a gram is one
gram; one with fewer grams than a window is one window. Two empty fingerprints are alike (1.0).
Documents follow each other by id, equal ids in a fixed order; rows without an id come first; the last one is
followed by the first.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, gram_hashes, lean, mix, records, released

GRAM, WINDOW = 12, 36
#: Code points that one vectorised step looks at.
STEP = 1 << 19
NO_ID = -(2**63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes uint32, positions int) of the chosen grams of each text, in text order."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= STEP):
            size += len(texts[hi])
            hi += 1
        out += _fingerprints(texts[lo:hi], gram, window)
        lo = hi
    return out


def _fingerprints(texts: list[str], gram: int, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # Texts shorter than a gram are filled up with a code that no text has.
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    codes = (codes + U64(1)) * U64(0x9FB21C651E98DF25)
    padded = np.concatenate([codes, np.zeros(gram + window, U64)])
    grams = mix(gram_hashes(padded, gram)) >> U64(32)
    values = (grams << U64(32)) | (U64(0xFFFFFFFF) - np.arange(len(grams), dtype=U64))
    minima = _sliding_min(values, window)
    result = []
    for i, n in enumerate(lengths.tolist()):
        at, count = int(starts[i]), n - gram + 1
        if n == 0:
            chosen = values[:0]
        elif count < 1:
            alone = np.concatenate([codes[at : at + n], np.zeros(gram - n, U64)])
            result.append(((mix(gram_hashes(alone, gram)) >> U64(32)).astype(np.uint32), np.zeros(1, np.int64)))
            continue
        elif count < window:
            chosen = values[at : at + count].min(keepdims=True)
        else:
            chosen = minima[at : at + count - window + 1]
            new = np.ones(len(chosen), bool)
            np.not_equal(chosen[1:], chosen[:-1], out=new[1:])
            chosen = chosen[new]
        result.append(((chosen >> U64(32)).astype(np.uint32), (U64(0xFFFFFFFF) - (chosen & U64(0xFFFFFFFF))).astype(np.int64) - at))
    return result


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted distinct hash arrays, 0 to 1."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    both = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return both / (len(a) + len(b) - both)


def written(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits for each chosen gram, in text order."""
    return hashes.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text whose last quarter is replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("positions", pa.list_(pa.int32()))])


def _compare(batches):
    """Rows come by bucket, own rows before guests; each is answered once its follower is known."""

    def answer(rows, followers):
        texts = [t for _, t in rows]
        changed = [edited(t, f) for t, f in zip(texts, followers, strict=True)]
        # Neighbours share their fingerprints: a follower is mostly the next row itself.
        extra = [f for i, f in enumerate(followers) if i + 1 >= len(texts) or f is not texts[i + 1]]
        prints, other, rest = fingerprints(texts), fingerprints(changed), iter(fingerprints(extra))
        after = [next(rest) if i + 1 >= len(texts) or f is not texts[i + 1] else prints[i + 1] for i, f in enumerate(followers)]
        sets, other_sets, after_sets = ([np.unique(h) for h, _ in x] for x in (prints, other, after))
        return records(
            {
                "doc_id": [i for i, _ in rows],
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                "fingerprint": [written(h) for h, _ in prints],
                "edited_fingerprint": [written(h) for h, _ in other],
                "near_edited": [likeness(a, b) for a, b in zip(sets, other_sets, strict=True)],
                "near_next": [likeness(a, b) for a, b in zip(sets, after_sets, strict=True)],
                "positions": pa.array([p.astype(np.int32) for _, p in prints], pa.list_(pa.int32())),
            },
            SCHEMA,
        )

    last, waiting = None, None
    for batch in batches:
        rows, followers, size = [], [], 0
        for bucket, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = zstandard.decompress(text).decode("utf-8", "surrogatepass")
            if bucket == last and waiting is not None:
                rows.append(waiting)
                followers.append(text)
                size += len(text)
            waiting, last = (None if guest else (doc_id, text)), bucket
            if size > 2 * STEP:
                yield answer(rows, followers)
                rows, followers, size = [], [], 0
        if rows:
            yield answer(rows, followers)


def with_followers(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, guest, doc_id, packed text): ranges of ids, each sorted and closed by the start of the next range.

    Only range bounds and the first id of each range reach the driver: two numbers for each of ``parts`` ranges. Rows of an id that
    fills several ranges, or without an id, follow each other by a hash of their text and are dealt out by it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    cuts = [i / parts for i in range(1, parts)]
    found = np.array(ids.agg(F.percentile_approx("id", F.array(*map(F.lit, cuts)), 10_000)).head()[0] or [], np.int64) if cuts else np.zeros(0, np.int64)
    distinct, times = np.unique(found, return_counts=True)
    # (id, hash) that start a range; an id that fills several has its rows dealt out by the hash of their text.
    bounds = [(i, (k << 32) // n) for i, n in zip(distinct.tolist(), times.tolist(), strict=True) for k in range(n)]
    if len(distinct) < len(found):
        ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    else:
        ids = ids.withColumn("h", F.lit(0).cast("long"))
    split = len(distinct) < len(found)

    @F.pandas_udf("int")
    def bucket_of(x: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, key) for key in zip(x.tolist(), h.tolist(), strict=True)], dtype="int32")

    firsts = {b: tuple(i) for b, i in sorted(ids.groupBy(bucket_of("id", "h").alias("b")).agg(F.min(F.struct("id", "h"))).collect())}
    order = list(firsts)
    before = {b: order[k - 1] for k, b in enumerate(order)}

    schema = pa.schema([("bucket", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("packed", pa.binary())])

    def place(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                packed = zstandard.compress(raw, 6)
                key = (NO_ID if doc_id is None else doc_id, zlib.crc32(raw) if split else 0)
                own = bisect.bisect_right(bounds, key)
                rows.append((own, False, doc_id, key[1], packed))
                if firsts[own] == key:
                    rows.append((before[own], True, doc_id, key[1], packed))
                size += len(packed)
                if size > STEP:
                    yield records(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)
                    rows, size = [], 0
            if rows:
                yield records(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    # Texts travel packed: the exchange is the operator's only large one.
    placed = docs.mapInArrow(released(place), "bucket int, guest boolean, doc_id long, h long, packed binary")
    return placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "h", "packed").drop("h")


def compare_with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness; ``positions`` are those of ``fingerprint``."""
    parts = parts or 4 * int(lean(docs.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    rows = with_followers(docs, parts)
    return rows.mapInArrow(released(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>")
