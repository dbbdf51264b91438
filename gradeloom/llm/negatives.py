"""Hard negatives by product quantisation with stored residual norms.

Vectors become integers, floor(256 x). They are cut into ``SUB``-dimensional parts, each part is
replaced by the nearest of ``CODES`` centres, and a row keeps its codes and the norm of what the
centres leave over. An anchor's lookup table holds its inner product with every centre, so sums
of table entries score all rows; by Cauchy and Schwarz the true score lies within anchor norm times
residual norm of that sum. Rows whose bounds cannot reach an anchor's positives, or a window of its
negatives, are put aside without loss; the others are scored again as exact integers.

The centres are fitted on ``FIT_ROWS`` rows at most, chosen by a hash; they decide how much is
put aside, never what is returned. Anchors go to the executors in blocks of ``ANCHORS`` at most, and
each block scans the stored index twice: for positives, then for the windows that these open.
Every task keeps the best few of each anchor, and Spark ranks what the tasks found.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no
part. Shorter vectors count as filled up with zeros, so an empty one scores 0 everywhere. Components
are clipped where scores would leave 64 bits. A row with a null id takes part, after all ids among equal scores, but
is no anchor. Rows that repeat an id are rows of their own, but never others for an anchor of that id;
as anchors they return what each of them finds. Anchors without positives, and windows without rows,
return nothing. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, lean, released, stored, utf8

SUB, CODES, FIT_ROWS, FIT_ROUNDS = 2, 256, 2048, 6
ANCHORS, POSITIVES, NEGATIVES = 1024, 5, 5
#: Pairs whose exact scores one step computes.
EXACT = 1 << 15
#: What rounding may add to a score, as a share of the norms: far above that of 32-bit sums over some thousand entries.
SLACK = 2.0**-12
#: Stands for a null id, which sorts last and is no multiple of anything.
NO_ID = np.iinfo(np.int64).max
FOUND = pa.schema([("place", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def prepared(rows: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part; ``label`` is a column of ``rows``."""
    taken = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    taken = taken.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & ~odd)
    most = 1e15  # as far as floor() stays within 64 bits
    return taken.select("vec_id", "label", F.transform("x", lambda c: F.floor(256 * F.greatest(F.least(c, F.lit(most)), F.lit(-most)))).alias("ints"))


def matrix(rows: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Integer rows of any length as one matrix, filled up with zeros."""
    sizes = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.concatenate([*rows, np.zeros(0, np.int64)])
    return out


def fit(index: DataFrame, n_rows: int) -> np.ndarray:
    """Centres (part, code, ``SUB``) by k-means over at most 2 * ``FIT_ROWS`` of about ``n_rows`` rows; zeros where vectors are shorter."""
    share = min(1.0, FIT_ROWS / max(n_rows, 1))
    chosen = index.filter(F.pmod(F.xxhash64("vec_id", "ints"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    x = matrix([np.array(r.ints, np.int64) for r in chosen.select("ints").limit(2 * FIT_ROWS).collect()]).astype(np.float64)
    parts = -(-x.shape[1] // SUB)
    x = np.pad(x, ((0, 0), (0, parts * SUB - x.shape[1]))).reshape(len(x), parts, SUB)
    centres = np.zeros((parts, CODES, SUB))
    for j in range(parts):
        points = x[:, j]
        # Beginnings spread over the rows by their norm.
        own = points[np.argsort((points**2).sum(1), kind="stable")[np.linspace(0, len(points) - 1, CODES).astype(int)]]
        for _ in range(FIT_ROUNDS):
            near = ((own**2).sum(1)[None, :] - 2 * points @ own.T).argmin(1)
            n = np.bincount(near, minlength=CODES)
            sums = np.stack([np.bincount(near, points[:, d], CODES) for d in range(SUB)], 1)
            own = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], own)
        centres[j] = own
    return centres


def _encode(centres: np.ndarray):
    """Codes of each row, and the norm that bounds what its table sums leave out."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("ints", pa.binary()), ("codes", pa.binary()), ("left", pa.float64())])
    parts = len(centres)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.column(2):
                r = np.asarray(r.values.to_numpy(zero_copy_only=False), np.int64)
                most = math.isqrt((1 << 62) // max(len(r), 1))
                rows.append(np.clip(r, -min(most, 2**31 - 1), min(most, 2**31 - 1)))
            x = matrix(rows, parts * SUB).astype(np.float64)
            within = x[:, : parts * SUB].reshape(len(x), parts, SUB)
            codes = np.zeros((len(x), parts), np.uint8)
            for j in range(parts):
                codes[:, j] = ((centres[j] ** 2).sum(1)[None, :] - 2 * within[:, j] @ centres[j].T).argmin(1)
            coded = centres[np.arange(parts)[None, :], codes] if parts else np.zeros((len(x), 0, SUB))
            left = np.sqrt(((within - coded) ** 2).sum((1, 2)) + (x[:, parts * SUB :] ** 2).sum(1))
            left = left + SLACK * (left + np.sqrt((x**2).sum(1))) + 1e-6
            packed = [pa.array([v.tobytes() for v in values], pa.binary()) for values in ([r.astype(np.int32) for r in rows], codes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed, pa.array(left)], schema=schema)

    return run


class Block:
    """Anchors by label, with their lookup tables; ``windows`` are the (anchor, highest score) that negatives are sought for."""

    def __init__(self, rows: list, centres: np.ndarray):
        rows = sorted(rows, key=lambda r: r.label)
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        self.numbers = np.array([r.anchor for r in rows], np.int64)
        self.labels = [r.label for r in rows]
        self.ints = matrix([np.frombuffer(r.ints, np.int32).astype(np.int64) for r in rows])
        self.centres = centres
        self.windows = np.zeros((0, 2), np.int64)
        self.tables = None

    def ready(self) -> Block:
        """Built on the executors: inner products of every anchor with every centre."""
        if self.tables is None:
            parts = len(self.centres)
            x = np.pad(self.ints.astype(np.float64), ((0, 0), (0, max(0, parts * SUB - self.ints.shape[1]))))
            self.norms = np.sqrt((x**2).sum(1)) * (1 + 1e-9)
            self.tables = [(c @ x[:, j * SUB : (j + 1) * SUB].T).astype(np.float32) for j, c in enumerate(self.centres)]
            self.slices, n = {}, len(self.labels)
            for i, label in enumerate(self.labels):
                lo, _ = self.slices.get(label, (i, i))
                self.slices[label] = (lo, i + 1)
            self.places = n
        return self

    def bounds(self, codes: np.ndarray, left: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score of each row with the anchors lo to hi."""
        sums = np.zeros((len(codes), hi - lo), np.float32)
        for j, table in enumerate(self.tables):
            sums += table[:, lo:hi][codes[:, j]] if hi - lo < len(self.ids) else np.take(table, codes[:, j], axis=0)
        about = left[:, None] * self.norms[None, lo:hi]
        return sums - about, sums + about

    def exact(self, x: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        width = min(x.shape[1], self.ints.shape[1])
        out = np.zeros(len(rows), np.int64)
        for at in range(0, len(rows), EXACT):
            r, a = rows[at : at + EXACT], anchors[at : at + EXACT]
            out[at : at + EXACT] = np.einsum("ij,ij->i", x[r, :width], self.ints[a, :width])
        return out


class Best:
    """The first few (score, id) of each place: higher scores first, then smaller ids."""

    def __init__(self, places: int, few: int):
        self.few, self.places = few, places
        self.floor = np.full(places, -np.inf)
        self.place, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        place, score, ids = (np.concatenate(x) for x in ((self.place, place), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, place))
        place, score, ids = place[order], score[order], ids[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        keep = nth < self.few
        last = nth == self.few - 1
        self.floor[place[last]] = score[last]
        self.place, self.score, self.id = place[keep], score[keep], ids[keep]

    def record(self) -> pa.RecordBatch:
        ids = pa.array(self.id, mask=self.id == NO_ID)
        return pa.RecordBatch.from_arrays([pa.array(self.place.astype(np.int32)), pa.array(self.score), ids], schema=FOUND)


def _batches(batches, parts: int):
    """(ids, labels, vectors, codes, left) of each batch."""
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            at, data = utf8(batch.column(2))
            values = data.view(np.int32).astype(np.int64)
            x = matrix([values[lo // 4 : hi // 4] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            codes = utf8(batch.column(3))[1].reshape(batch.num_rows, parts)
            labels = batch.column(1).dictionary_encode()
            yield ids, labels.indices.to_numpy(), labels.dictionary.to_pylist(), x, codes, batch.column(4).to_numpy()


def _positives(sent):
    """The best rows of each anchor's own label."""

    def run(batches):
        block = sent.value.ready()
        best = Best(block.places, POSITIVES)
        for ids, label, labels, x, codes, left in _batches(batches, len(block.centres)):
            for k, name in enumerate(labels):
                if name not in block.slices:
                    continue
                (lo, hi), own = block.slices[name], np.flatnonzero(label == k)
                low, high = block.bounds(codes[own], left[own], lo, hi)
                same = ids[own][:, None] == block.ids[None, lo:hi]
                low[same], high[same] = -np.inf, -np.inf
                floor = best.floor[lo:hi]
                if len(own) >= POSITIVES:
                    floor = np.maximum(floor, np.partition(low, len(own) - POSITIVES, axis=0)[len(own) - POSITIVES])
                r, a = np.nonzero((high >= floor[None, :]) & ~same)
                score = block.exact(x, own[r], lo + a)
                keep = score >= floor[a]
                best.add(lo + a[keep], score[keep], ids[own[r[keep]]])
        yield best.record()

    return run


def _negatives(sent):
    """The best rows of other labels in each window: scores of four fifths of its positive's to the whole."""

    def run(batches):
        block = sent.value.ready()
        of, top = block.windows[:, 0], block.windows[:, 1]  # sorted by anchor
        least = top - top // 5
        first, n = np.searchsorted(of, np.arange(block.places)), np.bincount(of, minlength=block.places)
        highest = np.full(block.places, -np.inf)
        np.maximum.at(highest, of, top)
        best = Best(len(of), NEGATIVES)
        for ids, label, labels, x, codes, left in _batches(batches, len(block.centres)):
            low, high = block.bounds(codes, left, 0, block.places)
            floors = np.maximum(least, best.floor)
            floor = np.full(block.places, np.inf)
            np.minimum.at(floor, of, floors)
            can = (high >= floor[None, :]) & (low <= highest[None, :])
            for k, name in enumerate(labels):
                if name in block.slices:
                    can[label == k, slice(*block.slices[name])] = False
            r, a = np.nonzero(can)
            low, high = low[r, a], high[r, a]
            score, known = np.zeros(len(r), np.int64), np.zeros(len(r), bool)
            found = []
            for j in range(int(n.max(initial=0))):
                w = np.minimum(first[a] + j, max(len(of) - 1, 0))
                open_ = np.flatnonzero((j < n[a]) & (high >= floors[w]) & (low <= top[w]))
                new = open_[~known[open_]]
                score[new], known[new] = block.exact(x, r[new], a[new]), True
                inside = open_[(score[open_] >= floors[w[open_]]) & (score[open_] <= top[w[open_]])]
                found.append((w[inside], score[inside], ids[r[inside]]))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield best.record()

    return run


def _first(found: DataFrame, few: int) -> DataFrame:
    """What all tasks found, ranked within each place."""
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= few)


def mine(rows: DataFrame, label: Column | None = None, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, rows whose vec_id ``every`` divides."""
    spark = lean(rows.sparkSession)
    own = prepared(rows, F.col("label") if label is None else label)
    centres = fit(own, rows.count())
    encoded = own.mapInArrow(released(_encode(centres)), "vec_id long, label string, ints binary, codes binary, left double")
    index = stored(encoded, "vectors")
    anchors = index.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "ints")
    blocks = -(-anchors.count() // ANCHORS)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not blocks:
        return out
    anchors = stored(anchors.repartition(blocks).select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("anchor")), "anchors")
    paths = []
    for b in range(blocks):
        block = Block(anchors.filter(F.col("block") == b).collect(), centres)
        sent = spark.sparkContext.broadcast(block)
        positives = _first(index.mapInArrow(released(_positives(sent)), "place int, score long, vec_id long"), POSITIVES)
        positives = sorted(positives.collect(), key=lambda r: (r.place, r["rank"]))
        sent.destroy()
        # Below zero, four fifths of a score lie above it: no window.
        positives = [r for r in positives if r.score >= 0]
        block.windows = np.array([(r.place, r.score) for r in positives], np.int64).reshape(-1, 2)
        sent = spark.sparkContext.broadcast(block)
        windows = [(w, int(block.ids[r.place]), r.vec_id, r.score) for w, r in enumerate(positives)]
        windows = spark.createDataFrame(windows, "place int, anchor_id long, positive_id long, positive_score long")
        negatives = _first(index.mapInArrow(released(_negatives(sent)), "place int, score long, vec_id long"), NEGATIVES)
        found = negatives.join(F.broadcast(windows), "place")  # at most POSITIVES rows for each anchor of a block
        found = stored(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        sent.destroy()
        paths.append(found.stored_at)
    drop_stored(index, anchors)
    return spark.read.schema(out.schema).parquet(*paths)
