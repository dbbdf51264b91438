"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

A text becomes segments at the places that no piece crosses: before a run of spaces, around
newlines, and between a letter and a punctuation mark. Segments a worker has not met are encoded
together: their characters are concatenated and suffix-sorted to the longest piece, every piece is
looked up by binary search for its range of occurrences, and the occurrences become edges sorted by
position. The model merges, again and again, the best-scored piece (leftmost of equals) whose two
ends are symbol borders with one border between them. Relaxation does the same in fewer rounds: an
edge that is better than all edges it overlaps, whether these can be merged yet or not, will be
merged whatever happens elsewhere, so all such edges are merged at once; of a row of equal pieces
that overlap one another (a run of one character), every second one. Segments of any length take
this one way, so the ids are those of the model's merge order.

Defined results: null texts have null ids; empty ones have none. U+2581 counts as a space, as the
model's own normaliser has it, so only such texts do not survive the round trip.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import KEPT, list_column, records, released, shipped, steps

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments, and characters of segments, whose ids a worker keeps; those least used go when the memory is full.
KNOWN_SEGMENTS, KNOWN_CHARS = 400_000, 4 << 20
#: Characters of new segments that are indexed together, and of texts that are answered together.
INDEX_CHARS, STEP_CHARS = 1 << 20, 1 << 21
#: Letters and marks between which segments may be cut as well, where no piece has such a letter before such a mark.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ",.;:!?"
SPACE = "▁"


class Pieces:
    def __init__(self, model: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(size)]
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        normal = [i for i in range(size) if not special[i]]
        if any("\n" in names[i] or SPACE in names[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece crosses segment borders")
        texts = [names[i].replace(SPACE, " ") for i in normal]
        crossed = {m for t in texts for m in re.findall(rf"[{LETTERS}]([{re.escape(MARKS)}])", t)}
        marks = "".join(m for m in MARKS if m not in crossed)
        self.segment = re.compile((rf"\n| *[{LETTERS}]+(?=[{re.escape(marks)}])|" if marks else r"\n|") + r" *[^ \n]+| +")
        self.id_of = dict(zip(texts, normal, strict=True))
        self.score = {t: lib.get_score(i) for t, i in self.id_of.items()}
        self.of_char = np.full(0x110000, -1, np.int32)
        self.symbol = np.ones(0x110000, np.uint16)  # 0 stands between segments, 1 for characters without a piece
        for t in texts:
            for c in t:
                if self.symbol[ord(c)] == 1:
                    self.symbol[ord(c)] = self.symbol.max() + 1
            if len(t) == 1:
                self.of_char[ord(t)] = self.id_of[t]
        many = sorted((t for t in texts if len(t) > 1), key=lambda t: (-self.score[t], self.id_of[t]))
        order = np.array([-self.score[t] for t in many])
        self.rank = np.unique(order, return_inverse=True)[1].astype(np.int64)  # equal scores, equal rank: leftmost wins
        self.ids = np.array([self.id_of[t] for t in many], np.int32)
        self.lengths = np.array([len(t) for t in many])
        self.longest = int(self.lengths.max(initial=1))
        self.width = -(-self.longest // 4) * 4
        table = np.zeros((len(many), self.width), np.uint16)
        for i, t in enumerate(many):
            table[i, : len(t)] = self.symbol[[ord(c) for c in t]]
        shift = np.arange(48, -1, -16, dtype=np.uint64)
        self.table = (table.astype(np.uint64).reshape(len(many), -1, 4) << shift).sum(2, dtype=np.uint64)
        used = (self.lengths[:, None] > np.arange(self.width)).reshape(len(many), -1, 4)
        self.mask = (np.where(used, np.uint64(0xFFFF), np.uint64(0)) << shift).sum(2, dtype=np.uint64)
        raw = [bytes([int(n[3:5], 16)]) if lib.is_byte(i) else b"" if special[i] else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.raw_start = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    # Matching

    def edges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece number) of every occurrence of every piece, sorted by position."""
        n = len(symbols)
        padded = np.concatenate([symbols, np.zeros(self.width, np.uint16)]).astype(np.uint64)
        key = np.zeros(n + self.width - 3, np.uint64)
        for j in range(4):
            key = (key << np.uint64(16)) | padded[j : j + len(key)]
        four = key  # four symbols in one number
        order = np.argsort(key[:n])
        size = 4
        while size < self.longest:
            ordered = key[order]
            rank = np.zeros(n + self.width, np.uint64)
            new = np.ones(n, np.uint64)
            new[1:] = ordered[1:] != ordered[:-1]
            rank[order] = np.cumsum(new)
            key = (rank[:n] << np.uint64(32)) | rank[size : size + n]
            size *= 2
            order = np.argsort(key)
        four = np.concatenate([four, np.zeros(self.width, np.uint64)])
        count, columns = self.table.shape

        def bound(low: np.ndarray, after: bool) -> np.ndarray:
            low, high = low.copy(), np.full(count, n)
            for _ in range(n.bit_length()):
                busy = low < high
                mid = (low + high) // 2
                at = order[np.minimum(mid, n - 1)]
                go = np.full(count, after)
                for c in range(columns - 1, -1, -1):
                    there = four[at + 4 * c] & self.mask[:, c]
                    go = np.where(there == self.table[:, c], go, there < self.table[:, c])
                go &= busy
                low = np.where(go, mid + 1, low)
                high = np.where(busy & ~go, mid, high)
            return low

        low = bound(np.zeros(count, np.int64), False)
        high = bound(low, True)
        sizes = high - low
        piece = np.repeat(np.arange(count), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        position = order[place]
        by = np.argsort(position)
        return position[by], piece[by]

    def relax(self, codes: np.ndarray, word_of: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol borders and, where a symbol starts, its piece id (or -1 - character for bytes)."""
        symbols = self.symbol[codes]
        symbols[codes == 10] = 1
        between = word_of < 0
        symbols[between] = 0
        start, piece = self.edges(symbols)
        # Best first, for good: of several edges over a character the last one written is then the best.
        by = np.argsort(self.rank[piece] << 32 | start)[::-1]
        start, piece = start[by], piece[by]
        end = start + self.lengths[piece]
        rank, word = self.rank[piece], word_of[start]
        border = np.ones(len(codes) + 1, bool)
        token = self.of_char[codes].copy()
        token[token < 0] = -1 - codes[token < 0].astype(np.int64)
        over = np.empty(len(codes), np.int64)  # at each character, the best edge over it
        reach = np.full(len(codes), len(codes) + 1)  # where a ready edge that starts there ends
        while True:
            inner = np.cumsum(border)
            alive = border[start] & border[end] & (inner[end - 1] > inner[start])
            if not alive.any():
                break
            start, end, piece, rank, word = (x[alive] for x in (start, end, piece, rank, word))
            ready = inner[end - 1] - inner[start] == 1
            size = end - start
            at = np.repeat(start, size) + _ramp(size)
            first = np.cumsum(size) - size
            # An edge with no ready one inside can never get ready itself.
            reach[start[ready]] = end[ready]
            hope = ready | (np.minimum.reduceat(reach[at], first) <= end)
            reach[start[ready]] = len(codes) + 1
            if not hope.all():
                at = at[np.repeat(hope, size)]
                start, end, piece, rank, word, ready, size = (x[hope] for x in (start, end, piece, rank, word, ready, size))
                first = np.cumsum(size) - size
                if not len(start):
                    break
            number = np.arange(len(start))
            over[at] = np.repeat(number, size)
            best = np.maximum.reduceat(over[at], first)  # higher numbers are better
            sure = ready & (best == number)
            ahead = np.full(words, -1)
            ahead[word[ready]] = number[ready]  # a segment's best ready edge is its next merge in any case
            sure[ahead[ahead >= 0]] = True
            # Rows of equal pieces: ready edges that only edges of their own rank beat, one symbol apart.
            equal = np.flatnonzero(ready & (rank[best] == rank))
            if len(equal) > int(sure.sum()):
                late = np.zeros(len(codes), bool)  # characters under equal edges that are not ready
                waiting = np.flatnonzero(~ready)
                spots = np.repeat(start[waiting], size[waiting]) + _ramp(size[waiting])
                late[spots[over_rank(over, rank, spots) == np.repeat(rank[waiting], size[waiting])]] = True
                free = ~np.logical_or.reduceat(late[at], first)[equal]
                equal = equal[free | sure[equal]]
                equal = equal[np.argsort(start[equal], kind="stable")]
                symbol = inner[start[equal]]
                new = np.ones(len(equal), bool)
                new[1:] = (symbol[1:] != symbol[:-1] + 1) | (rank[equal[1:]] != rank[equal[:-1]])
                head = np.maximum.accumulate(np.where(new, np.arange(len(equal)), 0))
                every_second = (np.arange(len(equal)) - head) % 2 == 0
                sure[equal[every_second & sure[equal[head]]]] = True
            won = np.flatnonzero(sure)
            # One border stands strictly inside each winner.
            inside = np.repeat(start[won], size[won] - 1) + _ramp(size[won] - 1) + 1
            border[inside] = False
            token[start[won]] = self.ids[piece[won]]
        return border, token

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all segments and how many each has."""
        lengths = np.fromiter(map(len, segments), np.int64)
        codes = np.frombuffer("\n".join([*segments, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        word_of = np.repeat(np.arange(len(segments)), lengths + 1)
        ends = np.cumsum(lengths + 1)
        word_of[ends - 1] = -1
        border, token = self.relax(codes, word_of, len(segments))
        at = np.flatnonzero(border[:-1] & (word_of >= 0))
        word, token = word_of[at], token[at]
        odd = np.flatnonzero(token < 0)
        if len(odd):
            as_bytes = [chr(-1 - t).encode() for t in token[odd].tolist()]
            times = np.ones(len(token), np.int64)
            times[odd] = [len(b) for b in as_bytes]
            spots = np.cumsum(times) - times
            word, token = np.repeat(word, times), np.repeat(token, times)
            fill = np.repeat(spots[odd], times[odd]) + _ramp(times[odd])
            token[fill] = self.byte_ids[np.frombuffer(b"".join(as_bytes), np.uint8)]
        return token.astype(np.int32), np.bincount(word, minlength=len(segments))

    # Texts

    def _learn(self, fresh: list[str]) -> None:
        ends = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1)
        made = [self.encode_segments(fresh[lo:hi]) for lo, hi in steps(np.concatenate([[0], ends]), INDEX_CHARS)]
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.chars += int(ends[-1])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        sizes = np.concatenate([self.sizes, *(n for _, n in made)])
        self.flat, self.sizes, self.starts = np.concatenate([self.flat, *(x for x, _ in made)]), sizes, np.cumsum(sizes) - sizes

    def _forget(self) -> None:
        """Keep the segments used at least twice, up to half of what fits; none at first."""
        names, uses = list(getattr(self, "known", ())), getattr(self, "uses", np.zeros(0, np.int64))
        chars = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(-uses, kind="stable")
        fits = (uses[order] > 1) & (np.cumsum(chars[order]) <= KNOWN_CHARS // 2) & (np.arange(len(order)) < KNOWN_SEGMENTS // 2)
        kept = np.sort(order[fits])
        if len(kept):
            each = self.sizes[kept]
            self.flat = self.flat[np.repeat(self.starts[kept], each) + _ramp(each)]
        else:
            each, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.known: dict[str, int] = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.chars, self.uses = int(chars[kept].sum()), uses[kept] // 2
        self.sizes, self.starts = each, np.cumsum(each) - each

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of the texts and the number of ids of each."""
        segments = [self.segment.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        fresh = set(itertools.chain.from_iterable(segments)).difference(self.known)
        if fresh and (len(self.known) + len(fresh) > KNOWN_SEGMENTS or self.chars > KNOWN_CHARS):
            self._forget()
            fresh = set(itertools.chain.from_iterable(segments)).difference(self.known)
        if fresh:
            self._learn(list(fresh))
        number = self.known.__getitem__
        index = np.fromiter(map(number, itertools.chain.from_iterable(segments)), np.int64)
        if not len(index):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        self.uses += np.bincount(index, minlength=len(self.uses))
        each = self.sizes[index]
        rows = np.repeat(np.arange(len(texts)), [len(r) for r in segments])
        counts = np.bincount(rows, each, len(texts)).astype(np.int64)
        return self.flat[np.repeat(self.starts[index], each) + _ramp(each)], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids; the space that encoding puts first goes."""
        sizes = self.raw_start[ids + 1] - self.raw_start[ids]
        raw = self.raw[np.repeat(self.raw_start[ids], sizes) + _ramp(sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + 1 if raw[a : a + 1] == b" " else a : b] for a, b in zip(ends, ends[1:], strict=False)]


def over_rank(over: np.ndarray, rank: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Rank of the best edge over each of the characters."""
    return rank[over[spots]]


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@functools.lru_cache(1)
def pieces(model: bytes) -> Pieces:
    """A worker keeps the tables of the model it met last."""
    return Pieces(model)


KEPT.append(pieces.cache_clear)


def _text_steps(texts: list[str | None]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > STEP_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of (doc_id, text): n_tokens, token_ids, and whether decoding the ids gives the text back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = pieces(sent.value)
            for lo, hi in _text_steps(texts):
                part = texts[lo:hi]
                ids, counts = known.encode([t or "" for t in part])
                back = known.decode(ids, counts)
                missing = np.array([t is None for t in part])
                lists = list_column(ids, counts, pa.int32())
                if missing.any():
                    lists = pa.array([None if m else x for m, x in zip(missing, lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
                same = [t is None or t.encode() == b for t, b in zip(part, back, strict=True)]
                yield records({"doc_id": batch.column(0).slice(lo, hi - lo), "n_tokens": counts, "token_ids": lists, "round_trip": same}, schema)

    sent = shipped(docs.sparkSession, model)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(released(run), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            counts = np.array([len(x or ()) for x in lists], np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int32)
            texts = pieces(sent.value).decode(ids, counts)
            yield records({"doc_id": batch.column(0), "text": [None if x is None else t.decode("utf-8", "replace") for x, t in zip(lists, texts, strict=True)]}, schema)

    sent = shipped(encoded.sparkSession, model)
    return encoded.selectExpr("cast(doc_id as long) doc_id", "token_ids").mapInArrow(released(run), "doc_id long, text string")
