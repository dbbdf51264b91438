"""Sum-of-squares packing of tokenised documents into sequences of ``SEQUENCE`` ids.

Each document's ids are closed by ``END``. Whole sequences are cut off its front; what remains goes,
as the documents come, into the fill level that leaves the smallest sum of squared counts of
partly filled sequences. A level array holds those counts: moving a sequence from level h to h + s
changes the sum by 2 (N[h+s] - N[h]) + 2, opening one by 2 N[s] + 1, filling one up by 1 - 2 N[h]; ties go to the
fullest level. Every task packs its own rows, so nothing is shuffled. When a task ends, or has
``MOST_OPEN`` sequences open, the fullest are filled up with cuts from the emptiest; of the one that is left,
lengths that are powers of two are cut off, which need no padding. So no sequence is padded at all.

Ids are those of the tokenizers library. They are computed by tiktoken, which is three times as fast, from
the same vocabulary file and splitting pattern; tests compare the two on every code point. Long texts
are encoded in steps that end before white space, where the pattern always has a boundary, or
between a letter or digit and punctuation.

Defined results: null and empty texts are their end alone; a null id stays null; every row is a
document, also where ids or texts repeat; other columns are ignored. ``sequence_id`` numbers the sequences of a
task after the task's number: the same rows in the same partitions give the same ids.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import KEPT, released, shipped
from .tokenfiles import SPLIT

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SEQUENCE, END = 2048, 1
MOST_OPEN = 4096
#: Code points that one step encodes; a step goes on to the next place where a text may be cut.
STEP = 1 << 18

CUT = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z0-9ぁ-ゖァ-ヺ一-龥])(?=[.,;:!?、。！，？])")


class Encoder:
    """Ids of texts by a byte-level vocabulary file, special tokens in them included."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        read = json.loads(vocabulary)
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        # Fixed rule of such files: printable bytes stand for themselves, the others follow from code point 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("packed", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.vocabulary = vocabulary

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.vocabulary)

    def step(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # white space of over a million code points in one run
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """The ids of the text, closed by ``END``."""
        out, lo = [], 0
        while lo < len(text):
            cut = CUT.search(text, lo + STEP) if len(text) - lo > STEP else None
            hi = cut.start() if cut else len(text)
            out.append(self.step(text[lo:hi]))
            lo = hi
        return np.concatenate([*out, np.array([END], np.uint32)]).astype(np.uint32)


_encoders: dict[int, Encoder] = {}
KEPT.append(_encoders.clear)


def encoder(vocabulary: bytes) -> Encoder:
    """A worker keeps the last one."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


class Piece:
    """Some consecutive ids of a document."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.total), Piece(self.doc_id, self.start + n, self.ids[n:], self.total)


class Packer:
    """Sequences of one task; ``done`` holds the rows of the full ones."""

    def __init__(self, task: int, size: int = SEQUENCE, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.next, self.done = task << 33, []
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.n_open = 0

    def close(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.done.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, self.next, offset))
            offset += len(p.ids)
        self.next += 1

    def level(self, s: int) -> int:
        """The level at which ``s`` more ids leave the smallest sum of squares; 0 opens a sequence."""
        counts = self.counts
        change = 2 * (counts[s + 1 : self.size + 1] - counts[1 : self.size + 1 - s]) + 2
        change[-1:] -= 1  # full sequences are not counted: counts[size] stays 0
        change[counts[1 : self.size + 1 - s] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else 0
        return best + 1 if len(change) and change[best] <= 2 * counts[s] + 1 else 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, rest = len(ids), len(ids) % self.size
        for at in range(0, total - rest, self.size):
            self.close([Piece(doc_id, at, ids[at : at + self.size], total)])
        if rest:
            self.place([Piece(doc_id, total - rest, ids[total - rest :].copy(), total)], rest)
        if self.n_open > self.most_open:
            last = self.merge()
            if last:
                self.place(last, sum(len(p.ids) for p in last))

    def place(self, pieces: list[Piece], s: int) -> None:
        h = self.level(s)
        held = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
            self.n_open -= 1
        held = held + pieces
        if h + s == self.size:
            self.close(held)
        else:
            self.open[h + s].append(held)
            self.counts[h + s] += 1
            self.n_open += 1

    def merge(self) -> list[Piece]:
        """Fill the fullest open sequences up from the emptiest; returns the pieces of the one that is left, maybe none."""
        rows = [held for level in reversed(self.open) for held in level]
        self.counts[:] = 0
        self.open, self.n_open = [[] for _ in range(self.size)], 0
        i, j = 0, len(rows) - 1
        gap = self.size - sum(len(p.ids) for p in rows[0]) if rows else 0
        while i < j:
            piece = rows[j].pop()
            if len(piece.ids) > gap:
                kept, piece = piece.cut(len(piece.ids) - gap)
                rows[j].append(kept)
            rows[i].append(piece)
            gap -= len(piece.ids)
            if not rows[j]:
                j -= 1
            if not gap:
                self.close(rows[i])
                i += 1
                gap = self.size - sum(len(p.ids) for p in rows[i]) if i < len(rows) else 0
        left = rows[i] if i < len(rows) and i <= j else []
        if left and not gap:
            self.close(left)
            left = []
        return left

    def finish(self) -> None:
        """Close everything: what is left is cut into lengths that are powers of two."""
        left = self.merge()
        while left:
            room = 1 << (sum(len(p.ids) for p in left).bit_length() - 1)
            now = []
            while room:
                piece = left.pop(0)
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    left.insert(0, rest)
                now.append(piece)
                room -= len(piece.ids)
            self.close(now)

    def record(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [()] * len(SCHEMA)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SCHEMA)


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece of a document (doc_id, text): its ids from ``start`` on lie in a sequence from ``offset`` on."""
    sent = shipped(docs.sparkSession, vocabulary)

    def run(batches):
        own, packer = encoder(sent.value), Packer(TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, own.ids(text.as_py() or ""))
                if len(packer.done) > 4096:
                    yield packer.record()
        packer.finish()
        yield packer.record()

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(released(run), ", ".join(f"{n} long" for n in SCHEMA.names))
