"""Language-model scoring with a hidden Markov model over word classes.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text and one end token, known
by a 64-bit hash. A state emits a class (``CLASSES`` hash classes; the end token has its own) and
the class emits the word, ``(c + 0.1) / (C + 0.1 * (V + 1))`` with the word's count, and the count
and number of words of the class in training text. So the model has a fixed size while every word
of the corpus is counted, and its likelihood factors into the words' part and that of the class
sequence.

Training: random start, then ``ROUNDS`` rounds of Baum-Welch over all training documents, no part of them
counting more than another: each partition sums expected counts and the sums are aggregated.

Sequences run side by side, one step for a token of each. So that a few long ones don't set the
number of steps, a sequence is cut into pieces of ``PIECE`` tokens, and the recursions are carried
over the cuts exactly: the product of a piece's transition and emission matrices takes the forward
vector from its start to its end and the backward vector from its end to its start. Expected counts
and likelihoods are those of whole sequences.

Counts of the most frequent words (at most ``HOT_WORDS``, 16 bytes each) are sent to the
executors; all other words meet their counts in a shuffled join, where no word is frequent.

Defined results: null texts count as empty and have the end token only; rows without an id are not
held out and train; with no training text the model is uniform over states and classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_CODE, U64, lean, records, released, span_hashes, steps, stored, utf8, word_spans
from .langid import held_out

STATES, CLASSES, PIECE = 6, 8192, 512
#: Rounds on a part of the training texts (none) and on all of them.
START_ROUNDS, ROUNDS = 0, 4
HOT_WORDS = 400_000
END = U64(0x51ED270B7F4A7C15)
ADD = 0.1


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts and the number of tokens of each; each text ends with END."""
    starts, ends, rows = word_spans(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1) + 1
    out = np.full(len(starts) + len(counts), END, U64)
    out[np.arange(len(starts)) + rows] = span_hashes(LOWER_CODE[data], starts, ends)
    return out, counts


def classes_of(hashes: np.ndarray) -> np.ndarray:
    """Class 0 is the end token's own."""
    out = (hashes >> U64(20)) % U64(CLASSES - 1) + U64(1)
    out[hashes == END] = 0
    return out.astype(np.int32)


def lanes(counts: np.ndarray, piece: int):
    """(start, length, sequence, number in the sequence) of all pieces, longest first."""
    starts = np.cumsum(counts) - counts
    parts = -(-counts // piece)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    lengths = np.minimum(np.repeat(counts, parts) - nth * piece, piece)
    starts = np.repeat(starts, parts) + nth * piece
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order], np.repeat(np.arange(len(counts)), parts)[order], nth[order]


class Parameters:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)  # emit: class x state

    @classmethod
    def random(cls, seed: int = 7) -> Parameters:
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = rng.uniform(0.5, 1.5, (CLASSES, STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, total: np.ndarray) -> Parameters:
        start, move, emit = unflat(total)
        return cls((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), (emit + 0.01) / (emit + 0.01).sum(0))


SIZE = STATES + STATES * STATES + CLASSES * STATES


def unflat(x: np.ndarray):
    a, b = STATES, STATES + STATES * STATES
    return x[:a], x[a:b].reshape(STATES, STATES), x[b:].reshape(CLASSES, STATES)


def _products(p: Parameters, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix that takes a forward vector over each piece (a start's included move), scaled, and its scale's log10.

    Pieces come longest first.
    """
    n = len(starts)
    x = np.tile(np.eye(STATES, dtype=np.float32), (n, 1, 1))
    log, active = np.zeros(n), n
    for t in range(int(lengths[0]) if n else 0):
        while lengths[active - 1] <= t:
            active -= 1
        now = (x[:active].reshape(-1, STATES) @ p.move).reshape(active, STATES, STATES)
        now *= p.emit[classes[starts[:active] + t]][:, None, :]
        if t % 4 == 3 or t == lengths[0] - 1 or lengths[active - 1] == t + 1:
            norm = now.max((1, 2))
            now /= norm[:, None, None]
            log[:active] += np.log10(norm)
        x[:active] = now
    return x, log


def _entries(p: Parameters, classes: np.ndarray, starts, lengths, sequence, nth, count: int, backward: bool):
    """Forward vectors that enter each piece, log10 likelihoods of the whole sequences, and backward vectors at each piece's end.

    A first piece is entered by nothing (its forward vector begins with ``start``), a last one ends in ones.
    """
    later = np.flatnonzero(nth > 0)
    x, log = _products(p, classes, starts[later], lengths[later])
    number = np.full(len(starts), -1)
    number[later] = np.arange(len(later))
    enter, leave = np.zeros((len(starts), STATES), np.float32), np.ones((len(starts), STATES), np.float32)
    by = np.lexsort((nth, sequence))  # pieces of a sequence one after the other
    at = np.empty(len(by), np.int64)
    at[by] = np.arange(len(by))
    first = np.flatnonzero(nth == 0)
    parts = np.bincount(sequence, minlength=count)
    alpha, total = _forward(p, classes, starts[first], lengths[first])
    now, likelihood = np.zeros((count, STATES), np.float32), np.zeros(count)
    now[sequence[first]], likelihood[sequence[first]] = alpha, total
    place = np.zeros(count, np.int64)
    place[sequence[first]] = at[first]
    for k in range(1, int(parts.max(initial=0))):
        rows = np.flatnonzero(parts > k)
        piece = by[place[rows] + k]
        enter[piece] = now[rows]
        m = number[piece]
        new = np.einsum("ni,nij->nj", now[rows], x[m])
        norm = new.sum(1)
        now[rows] = new / norm[:, None]
        likelihood[rows] += np.log10(norm) + log[m]
    if backward:
        now = np.ones((count, STATES), np.float32)
        for k in range(int(parts.max(initial=0)) - 1, 0, -1):
            rows = np.flatnonzero(parts > k)
            piece = by[place[rows] + k]
            new = np.einsum("nij,nj->ni", x[number[piece]], now[rows])
            now[rows] = new / new.max(1)[:, None]
            leave[by[place[rows] + k - 1]] = now[rows]
    return enter, likelihood, leave


def _forward(p: Parameters, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Scaled forward vectors at the ends of sequences' first pieces, longest first, and log10 of their scales."""
    n = len(starts)
    total, scale, active = np.zeros(n), np.ones(n), n
    alpha = np.tile(p.start, (n, 1))
    for t in range(int(lengths[0]) if n else 0):
        while lengths[active - 1] <= t:
            active -= 1
        now = alpha[:active] if t == 0 else alpha[:active] @ p.move
        now = now * p.emit[classes[starts[:active] + t]]
        norm = now @ np.ones(STATES, np.float32)
        alpha[:active] = now / norm[:, None]
        scale[:active] *= norm
        if t % 8 == 7:
            total += np.log10(scale)
            scale[:] = 1
    return alpha, total + np.log10(scale)


def log10_forward(p: Parameters, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each whole class sequence by the scaled forward recursion."""
    return _entries(p, classes, *lanes(counts, PIECE), len(counts), False)[1]


def expected_counts(p: Parameters, classes: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
    """Add the expected counts of one Baum-Welch round over these whole sequences."""
    starts, lengths, sequence, nth = lanes(counts, PIECE)
    if not len(starts):
        return
    enter, _, leave = _entries(p, classes, starts, lengths, sequence, nth, len(counts), True)
    head = (nth == 0)[:, None]
    start, move, emit = unflat(into)
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # pieces longer than t
    ones = np.ones(STATES, np.float32)
    alphas, norms, seen = [], [], []
    alpha = enter
    for t in range(longest):
        a = int(alive[t])
        symbols = classes[starts[:a] + t]
        now = alpha[:a] @ p.move
        if t == 0:
            now = np.where(head, p.start, now)
        now = now * p.emit[symbols]
        norm = (now @ ones)[:, None]
        alpha = now / norm
        alphas.append(alpha)
        norms.append(norm)
        seen.append(symbols)
    beta = leave
    gammas = [None] * longest
    for t in range(longest - 1, -1, -1):
        a = int(alive[t])
        b = int(alive[t + 1]) if t < longest - 1 else 0
        back = leave[:a] / (alphas[t] * leave[:a]).sum(1, keepdims=True)  # pieces that end here
        if b:
            ahead = p.emit[seen[t + 1]] * beta / norms[t + 1]
            move += (alphas[t][:b].T @ ahead) * p.move
            back[:b] = ahead @ p.move.T
        beta = back
        gammas[t] = alphas[t] * beta
    first = p.emit[seen[0]] * beta / norms[0]
    move += (enter.T @ first) * p.move  # steps over cuts; a first piece is entered by nothing
    start += gammas[0][nth == 0].sum(0)
    every, weight = np.concatenate(seen), np.concatenate(gammas)
    for k in range(STATES):
        emit[:, k] += np.bincount(every, weight[:, k], CLASSES)


def _token_chunks(column, limit=1 << 22):
    offsets, data = utf8(column)
    for lo, hi in steps(offsets, limit):
        yield lo, hi, *token_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each token, known by its hash, occurs in all the texts."""

    def count(batches):
        schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            parts = [np.unique(h, return_counts=True) for _, _, h, _ in _token_chunks(batch.column(0))]
            if parts:
                words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
                yield records({"word": words.view(np.int64), "n": np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)}, schema)

    return texts.select("text").mapInArrow(released(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class_column():
    """The class of a word's hash, as classes_of has it; shiftrightunsigned keeps it in the positive range."""
    own = F.shiftrightunsigned("word", 20) % (CLASSES - 1) + 1
    return F.when(F.col("word") == F.lit(int(END)), 0).otherwise(own)


def _round(texts: DataFrame, p: Parameters) -> np.ndarray:
    """Expected counts of one round, summed over all partitions; SIZE numbers, whatever the corpus."""
    sent = texts.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        into, any_rows = np.zeros(SIZE), False
        for batch in batches:
            for _, _, hashes, counts in _token_chunks(batch.column(0)):
                expected_counts(sent.value, classes_of(hashes), counts, into)
                any_rows = True
        if any_rows:
            pieces = np.array_split(into, 32)
            at = np.cumsum([0, *map(len, pieces)])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([x.tolist() for x in pieces], pa.list_(pa.float64()))], names=["at", "counts"])

    parts = texts.select("text").mapInArrow(released(run), "at long, counts array<double>")
    sums = parts.select("at", F.posexplode("counts").alias("i", "x")).groupBy((F.col("at") + F.col("i")).alias("i")).agg(F.sum("x").alias("x"))
    got = sums.toArrow()
    out = np.zeros(SIZE)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return out


def train(texts: DataFrame) -> Parameters:
    """Baum-Welch over all rows of ``texts`` (doc_id, text)."""
    p = Parameters.random()
    for _ in range(ROUNDS):
        p = Parameters.from_counts(_round(texts, p))
    return p


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of (doc_id, text)."""
    spark = lean(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out("doc_id", 10, 0).alias("held_out"))
    texts = docs.filter(~F.col("held_out")).select("doc_id", "text")
    counts = stored(word_counts(texts), "words")
    by_class = counts.groupBy(_class_column().alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    of_class = np.zeros((CLASSES, 2))
    of_class[by_class["c"].to_numpy().astype(int)] = np.stack([by_class["n"].to_numpy(), by_class["v"].to_numpy()], 1)
    total, distinct = int(of_class[:, 0].sum()), int(of_class[:, 1].sum())
    # The smallest power of two as a count that no more than HOT_WORDS words reach.
    reach = np.zeros(64, np.int64)
    for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("p")).count().collect():
        reach[r.p] = r["count"]
    least = 1 << int(np.argmax(np.cumsum(reach[::-1])[::-1] <= HOT_WORDS))
    hot = counts.filter(F.col("n") >= least).toArrow()
    hot_words, hot_n = hot["word"].to_numpy(), hot["n"].to_numpy()
    order = np.argsort(hot_words)
    sent = spark.sparkContext.broadcast((train(texts), hot_words[order], np.log10(hot_n[order] + ADD), np.log10(of_class[:, 0] + ADD * (of_class[:, 1] + 1))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("hot", pa.float64()), ("model", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        p, words, logs, class_logs = sent.value
        for batch in batches:
            for lo, hi, hashes, n in _token_chunks(batch.column(3)):
                row = np.repeat(np.arange(hi - lo), n)
                signed = hashes.view(np.int64)
                at = np.searchsorted(words, signed)
                known = words[np.minimum(at, len(words) - 1)] == signed if len(words) else np.zeros(len(signed), bool)
                at = at[known]
                hot_sum = np.bincount(row[known], logs[at], hi - lo)
                classes = classes_of(hashes)
                model = log10_forward(p, classes, n) - np.bincount(row, class_logs[classes], hi - lo)
                cold_row, cold = row[~known], signed[~known]
                o = np.lexsort((cold, cold_row))
                cold_row, cold = cold_row[o], cold[o]
                new = np.ones(len(cold), bool)
                new[1:] = (cold[1:] != cold[:-1]) | (cold_row[1:] != cold_row[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(cold))).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(cold_row[first], minlength=hi - lo))]).astype(np.int32)
                yield records(
                    {
                        **{x: batch.column(i).slice(lo, hi - lo) for i, x in enumerate(("row", "doc_id", "held_out"))},
                        "n_tokens": n.astype(np.int64), "n_known": np.bincount(row[known], minlength=hi - lo).astype(np.int64), "hot": hot_sum, "model": model,
                        "words": pa.ListArray.from_arrays(pa.array(ends), pa.array(cold[first])), "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times)),
                    },
                    schema,
                )

    first = stored(rows.mapInArrow(released(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, hot double, model double, words array<long>, times array<int>"), "scored")
    cold = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    cold = cold.join(counts.filter(F.col("n") < least), "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("cold"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("cold_known"))
    out = first.drop("words", "times").join(cold, "row", "left")
    words = F.col("hot") + F.coalesce("cold", F.lit(0.0))
    base = words - F.col("n_tokens") * F.lit(float(np.log10(total + ADD * (distinct + 1))))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (words + F.col("model")).alias("score"))
