"""Benchmark decontamination with CGK embeddings and bit-sampling LSH.

Texts and items are folded (A-Z to lower case, runs of ASCII white space to one space, ends
trimmed) and compared as UTF-8 bytes. A document holds an item if some stretch of it is at an edit
distance of at most ``share`` (a tenth) of the item's length.

Three steps:

1. A count filter says where windows are worth embedding, and loses nothing: an item of m bytes with
   e edits keeps m - (g - 1) - g * e of its g-grams (g is ``GRAM``, and less where the item is too
   short for a positive number), and their places in the text less their places in the item differ
   by 2e at most. Equal grams are counted by item and difference, in overlapping bands; bands with
   fewer are out. Grams that many items have are left uncounted up to half of that number, which
   then falls by as many. All differences of a band that is left, 4e + 1 at most, are the starts of windows.
2. Windows of the item's own size at these starts are embedded by ``WALKS`` CGK random walks (output
   the current byte, then stay or step on by a random bit of step number and byte), which turns
   edit distance into Hamming distance: equal texts have equal outputs, and after an edit the walks
   of item and copy tend to fall into step again. ``TABLES`` bit-sampling hashes of each walk,
   ``SAMPLE`` outputs each, look for items in the same bucket. A walk that agrees in a share p of
   its outputs misses with (1 - p**SAMPLE)**TABLES, and all walks must miss to lose a copy.
3. Exact verification: bit-parallel edit distance of the whole item against the band's surroundings.

Recall by kind of edit, measured with copies of the 200 items of sf0.1 whose exact distance is within the
limit, put at random places of a text: deletions alone, insertions alone, substitutions alone and all three, of 2, 5 and
10 % of the bytes, 2000 of 2000 each; items cut to 120, 60, 30 and 15 bytes, 5 and 10 %, 2400 of 2400 each.

Items are the query set; they go to the executors in blocks of at most ``BLOCK_ITEMS`` items and
about ``BLOCK_BYTES`` bytes, which bounds a worker's index to about 100 MB; each block scans all
documents. Defined results: null or empty texts and items match nothing, items too short for an
edit (under 10 bytes at a tenth) must stand there as they are and not within a longer word or
number, repeated rows answer for themselves, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, LOWER, SPACE, U64, lean, mix, released, steps, utf8

SHARE, GRAM = 0.1, 8
WALKS, TABLES, SAMPLE = 8, 24, 3
#: Steps after which the walks' random bits repeat; bytes of embedding that are held at once.
PERIOD, EMBED_BYTES = 1024, 24 << 20
#: A gram with more places in the items is common; so many pairs of places are compared at once.
COMMON, PAIRS = 64, 1 << 21
BLOCK_ITEMS, BLOCK_BYTES = 4_000, 2 << 20
#: Windows that are embedded together.
WINDOWS = 4096
FOLD = np.where(SPACE, np.uint8(32), LOWER)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and their offsets; each text starts and ends without space."""
    blank = SPACE[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after something solid stays
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[starts] = ~blank[starts]
    counts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = FOLD[data[keep]]
    ends = counts[1:][counts[1:] > counts[:-1]]
    trailing = ends[out[ends - 1] == 32] - 1
    if len(trailing):
        solid = np.ones(len(out), bool)
        solid[trailing] = False
        counts = np.concatenate([[0], np.cumsum(solid)])[counts]
        out = out[solid]
    return out, counts


def folded(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return fold(raw, np.array([0, len(raw)]))[0].tobytes()


def gram_codes(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (8 at most) bytes that start at each position, as one number."""
    count = max(0, len(data) - size + 1)
    out = np.zeros(count, U64)
    for i in range(size):
        out = (out << U64(8)) | data[i : i + count]
    return out


def gram_bins(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


_rng = np.random.Generator(np.random.PCG64(31))
#: One random bit for each walk, step and byte; where the outputs are sampled, as a share of the steps.
STAY_OR_STEP = _rng.integers(0, 2, (WALKS, PERIOD, 256), dtype=np.uint8)
SAMPLED = _rng.random((WALKS, TABLES, SAMPLE))


def bucket_keys(windows: list[bytes]) -> np.ndarray:
    """WALKS * TABLES bucket keys of each window (row); windows of different sizes share none."""
    out = np.empty((len(windows), WALKS * TABLES), U64)
    order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
    salt = mix(np.arange(1, WALKS * TABLES + 1, dtype=U64)).reshape(WALKS, TABLES)
    walk, lo = np.arange(WALKS)[:, None], 0
    while lo < len(order):
        longest = max(1, len(windows[order[lo]]))
        own = order[lo : lo + max(1, EMBED_BYTES // (WALKS * 2 * longest))]
        lo += len(own)
        size = np.array([len(windows[i]) for i in own])
        data = np.zeros(int(size.sum()) + 1, np.uint8)
        data[:-1] = np.frombuffer(b"".join(windows[i] for i in own), np.uint8)
        end = np.cumsum(size)
        at = np.tile(end - size, (WALKS, 1))
        said = np.zeros((WALKS, 2 * longest, len(own)), np.uint8)
        alive = np.searchsorted(-2 * size, -np.arange(2 * longest), "left")  # windows longer than half the step
        for j in range(2 * longest):
            n = int(alive[j])
            inside = at[:, :n] < end[:n]
            byte = np.where(inside, data[np.minimum(at[:, :n], len(data) - 1)], 0)
            said[:, j, :n] = byte
            at[:, :n] += STAY_OR_STEP[walk, j % PERIOD, byte]
        when = (SAMPLED[..., None] * (2 * size)).astype(np.int64)  # walk, table, sample, window
        keys = salt[:, :, None] ^ mix(size.astype(U64) * U64(0xA0761D6478BD642F))[None, None, :]
        for i in range(SAMPLE):
            keys = mix(keys ^ (said[walk[:, :, None], when[:, :, i], np.arange(len(own))].astype(U64) + U64(1)))
        out[own] = keys.reshape(WALKS * TABLES, len(own)).T
    return out


def edits(item: bytes, text: bytes) -> tuple[int, int]:
    """Smallest edit distance of the item to a stretch of the text, and where the first such stretch ends."""
    at: dict[int, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    top, every = 1 << len(item) - 1, (1 << len(item)) - 1
    up, down, score = every, 0, len(item)
    best, end = score, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up) & every, up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        plus, minus = plus << 1 & every, minus << 1 & every
        up = minus | ~((eq | down) | plus) & every
        down = plus & (eq | down)
    return best, end


def _in_word(left: bytes, right: bytes) -> bool:
    """Whether a word or number goes on from one text to the next; scripts without spaces do not count."""
    a, b = left[-4:].decode("utf-8", "ignore")[-1:], right[:4].decode("utf-8", "ignore")[:1]
    return all(c.isalnum() and ord(c) < 0x2E80 for c in (a, b)) if a and b else False


def standing(item: bytes, text: bytes, lo: int, hi: int) -> int | None:
    """Where the first copy of the item in text[lo:hi] ends that no longer word holds."""
    at = text.find(item, lo, hi)
    while at >= 0:
        end = at + len(item)
        if not _in_word(text[max(0, at - 4) : at], item) and not _in_word(item, text[end : end + 4]):
            return end
        at = text.find(item, at + 1, hi)
    return None


class Items:
    """The indexed items of one block."""

    def __init__(self, ids: list[int], texts: list[bytes], share: float):
        self.ids, self.texts = ids, texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.most = np.array([int(len(t) * share) for t in texts], np.int64)
        self.grams = np.minimum(GRAM, self.size // (self.most + 1))
        self.fewest = self.size - (self.grams - 1) - self.grams * self.most
        self.widest = int((self.size + self.most).max(initial=0))
        # (gram size, bits of a bin, bins that occur, sorted codes, item and place of each)
        self.tables = []
        for g in np.unique(self.grams).tolist():
            own = np.flatnonzero(self.grams == g).tolist()
            parts = [gram_codes(np.frombuffer(texts[i], np.uint8), g) for i in own]
            counts = [len(x) for x in parts]
            codes, item = np.concatenate(parts), np.repeat(own, counts)
            place = np.concatenate([np.arange(n) for n in counts])
            _, which, times = np.unique(codes, return_inverse=True, return_counts=True)
            keep, lo = np.ones(len(codes), bool), 0
            for i, n in zip(own, counts, strict=True):
                seen = times[which[lo : lo + n]]
                gone = np.argsort(-seen, kind="stable")[: int(self.fewest[i]) // 2]
                gone = gone[seen[gone] > COMMON]
                keep[lo + gone] = False
                self.fewest[i] -= len(gone)
                lo += n
            codes, item, place = codes[keep], item[keep], place[keep]
            by = np.argsort(codes)
            bits = max(16, min(24, (8 * len(codes)).bit_length()))
            present = np.zeros(1 << bits, bool)
            present[gram_bins(codes, bits)] = True
            self.tables.append((g, bits, present, codes[by], item[by].astype(np.int32), place[by].astype(np.int32)))
        walked = np.flatnonzero(self.most > 0)
        keys = bucket_keys([texts[i] for i in walked.tolist()])
        number = np.repeat(walked.astype(np.int32), WALKS * TABLES)
        by = np.argsort(keys.ravel())
        self.buckets, self.held = keys.ravel()[by], number[by]

    def bands(self, data: np.ndarray):
        """(item, least difference, greatest one, all of them) of the bands that hold enough equal grams."""
        for g, bits, present, known, item, place in self.tables:
            codes = gram_codes(data, g)
            spots = np.flatnonzero(present[gram_bins(codes, bits)])
            low, high = np.searchsorted(known, codes[spots], "left"), np.searchsorted(known, codes[spots], "right")
            spots, low, times = (x[high > low] for x in (spots, low, high - low))
            total = np.concatenate([[0], np.cumsum(times)])
            lo = 0
            while lo < len(spots):
                # A stretch that begins in this part may end in the next one.
                hi = max(int(np.searchsorted(total, total[lo] + PAIRS)), int(np.searchsorted(spots, spots[lo] + self.widest, "right")))
                hi = min(hi, len(spots))
                end = int(np.searchsorted(spots, spots[hi - 1] + self.widest, "right"))
                n = times[lo:end]
                at = np.arange(total[end] - total[lo]) + np.repeat(low[lo:end] - (total[lo:end] - total[lo]), n)
                own, diff = item[at].astype(np.int64), np.repeat(spots[lo:end], n) - place[at]
                width = 2 * self.most[own] + 1
                for shift in (0, 1):
                    key = own << 40 | (diff + self.widest + shift * width) // (2 * width)
                    by = np.argsort(key)
                    first = np.flatnonzero(np.diff(key[by], prepend=-1))
                    sizes = np.diff(first, append=len(by))
                    whose = own[by[first]]
                    for k in np.flatnonzero(sizes >= self.fewest[whose]).tolist():
                        some = by[first[k] : first[k] + sizes[k]]
                        # A copy begins at one of them, up to the edits before its first equal gram: 4e + 1 at most.
                        seen = np.unique(diff[some])
                        yield int(whose[k]), int(seen[0]), int(seen[-1]), seen.tolist()
                lo = hi

    def places(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item, start, end, window starts) of the pieces of the text that may hold an item."""
        for i, least, greatest, begun in self.bands(data):
            size, most = int(self.size[i]), int(self.most[i])
            a, b = max(0, least - most), min(len(data), greatest + size + 2 * most)
            r, z = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
            for row in range(r, z):
                lo, hi = max(a, int(offsets[row])), min(b, int(offsets[row + 1]))
                if hi - lo >= size - most:
                    yield row, i, lo, hi, {min(max(x, lo), hi - 1) for x in begun}

    def meet(self, windows: list[bytes]) -> set[tuple[int, int]]:
        """(window, item) pairs that share a bucket."""
        if not windows or not len(self.buckets):
            return set()
        keys = bucket_keys(windows).ravel()
        low = np.searchsorted(self.buckets, keys, "left")
        n = np.searchsorted(self.buckets, keys, "right") - low
        window = np.repeat(np.arange(len(windows)), WALKS * TABLES)
        out: set[tuple[int, int]] = set()
        total, lo = np.concatenate([[0], np.cumsum(n)]), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS)))
            some = n[lo:hi]
            at = np.arange(total[min(hi, len(n))] - total[lo]) - np.repeat(total[lo : lo + len(some)] - total[lo], some) + np.repeat(low[lo:hi], some)
            both = np.unique(np.repeat(window[lo:hi], some) << 32 | self.held[at])
            out |= set(zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist(), strict=True))
            lo = hi
        return out

    def search(self, parts) -> list[tuple[int, int, int, int]]:
        """(row, item id, edits, end) of the items in folded texts; end counts folded bytes.

        ``parts`` gives (first row, bytes, offsets).
        """
        out: dict[tuple[int, int], tuple[int, int]] = {}
        windows: dict[bytes, int] = {}  # bytes of each window, to its number
        pieces: dict[tuple[int, int, int, int], tuple[bytes, set[int]]] = {}  # row, item, place: its text and its windows

        def verify() -> None:
            met = self.meet(list(windows))
            for (row, item, lo, _), (text, own) in sorted(pieces.items()):
                if any((w, item) in met for w in own):
                    e, end = edits(self.texts[item], text)
                    if e <= self.most[item] and (e, lo + end) < out.get((row, item), (e + 1, 0)):
                        out[row, item] = e, lo + end
            windows.clear()
            pieces.clear()

        for first, data, offsets in parts if self.texts else ():
            for row, item, lo, hi, starts in self.places(data, offsets):
                a, b = int(offsets[row]), int(offsets[row + 1])
                if not self.most[item]:
                    if (first + row, item) not in out and (end := standing(self.texts[item], data[a:b].tobytes(), 0, b - a)) is not None:
                        out[first + row, item] = 0, end
                    continue
                own = pieces.setdefault((first + row, item, lo - a, hi - a), (data[lo:hi].tobytes(), set()))[1]
                for s in starts:
                    own.add(windows.setdefault(data[s : min(b, s + int(self.size[item]))].tobytes().ljust(int(self.size[item]), b"\0"), len(windows)))
            if len(windows) >= WINDOWS:
                verify()
        verify()
        return [(row, self.ids[item], e, end) for (row, item), (e, end) in sorted(out.items())]


_LAST: list = []
KEPT.append(_LAST.clear)


def _index(sent, share: float) -> Items:
    """A worker keeps the index of the block it met last, with the block, by which it knows it."""
    if not _LAST or _LAST[0] is not sent.value or _LAST[1] != share:
        _LAST[:] = [sent.value, share, Items(*sent.value, share)]
    return _LAST[2]


def _blocks(items: DataFrame):
    """Blocks of (ids, folded texts): bounded by number and bytes."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        text = folded(r.text)
        if r.item_id is None or not text:
            continue
        ids.append(r.item_id)
        texts.append(text)
        size += len(text)
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, edits, end_at): for each row of docs the items it holds, with the fewest edits found."""
    spark = lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("end_at", pa.int32())])
    out = None
    for ids, texts in _blocks(items):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches, sent=sent):
            index = _index(sent, share)
            for batch in batches:
                offsets, data = utf8(batch.column(1))
                names = batch.column(0)
                parts = ((lo, *fold(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in steps(offsets))
                if rows := index.search(parts):
                    row, item, e, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(item, pa.int64()), pa.array(e, pa.int32()), pa.array(end, pa.int32())], schema=schema)

        one = docs.mapInArrow(released(run), "doc_id long, item_id long, edits int, end_at int")
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, edits int, end_at int")
