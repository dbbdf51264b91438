"""Language identification with string kernels.

A text's features are the byte n-grams of 1 to ``LONGEST`` bytes that are present in it (letters in
lower case, hashed to ``BINS`` bins). The kernel of two texts is the number of shared n-grams over
the geometric mean of their numbers. Landmarks of each language give Nyström features, and kernel
ridge regression is fitted one language against the rest. Texts are scored in batches:
presence matrix x landmark matrix, then x coefficients.

Learning is bounded by parameters: for each language the ``FIT_PER_LANG`` labelled documents with
the smallest hash of their id, of which the first ``PER_LANG`` are landmarks. Every language is
learned; where there are more than 16 of them these numbers fall, so that all have ``FIT_DOCS``
documents and ``LANDMARKS`` landmarks together, but no language less than ``LEAST_FIT`` and
``LEAST_MARKS``. A table with over ``MOST_LANGS`` labels is refused with an error: such a column
holds no languages, and no label is dropped in silence.

Defined results: null texts and texts without a letter are ``und`` with score 0; if nothing can be
learned every text is ``und``; score is the winner's regression value moved from [-1, 1] to [0, 1]
and clipped; ties go to the language that sorts first.

The score only ranks the languages learned, as one of them always wins. Whether a text is in the
winner at all is told by ``known``: the share of its n-grams that at least two fit documents of the
winner have reaches ``SLACK`` times what all but 1 % of these documents reach among the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, lean, records, released, steps, utf8

LONGEST, BINS = 3, 1 << 14
PER_LANG, FIT_PER_LANG = 48, 240
LANDMARKS, FIT_DOCS, LEAST_MARKS, LEAST_FIT, MOST_LANGS = 768, 3840, 1, 4, 1000
RIDGE = 1e-2
SLACK = 0.75
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence matrix (rows x BINS) of the n-grams of the texts between the offsets."""
    rows = len(offsets) - 1
    out = np.zeros(rows * BINS, np.float32)
    codes = LOWER[data].astype(np.uint32)
    owner = np.repeat(np.arange(rows, dtype=np.int64) * BINS, np.diff(offsets))
    gram = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        gram = gram[:size] * np.uint32(257) + codes[n - 1 :] + np.uint32(1)
        bins = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS.bit_length() + 1)
        inside = owner[:size] == owner[n - 1 :]
        out[(owner[:size] + bins)[inside]] = 1
    return out.reshape(rows, BINS)


def has_letter(text: bytes) -> bool:
    if _LETTER[np.frombuffer(text, np.uint8)].any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace")) if text and max(text) > 127 else False


def _packed(batches):
    schema = pa.schema([("lang", pa.string()), ("rank", pa.int32()), ("bits", pa.binary())])
    for batch in batches:
        offsets, data = utf8(batch.column(2))
        bits = []
        for lo, hi in steps(offsets, 1 << 19):
            for a in range(lo, hi, 256):
                b = min(hi, a + 256)
                bits += [x.tobytes() for x in np.packbits(presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) > 0, axis=1)]
        yield records({"lang": batch.column(0), "rank": batch.column(1), "bits": bits}, schema)


class Model:
    """Landmark matrix, its norms and the coefficients of all languages; a few MB, whatever the corpus."""

    def __init__(self, langs: list[str], rank: np.ndarray, x: np.ndarray, y: np.ndarray, per_lang: int = PER_LANG):
        self.langs = langs
        marks = x[rank <= per_lang]
        self.marks = np.packbits(marks > 0, axis=1)
        self.norm = np.sqrt(np.maximum(marks.sum(1), 1))
        gram = self.kernel(marks, marks)
        values, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(gram)))
        keep = values > 1e-4
        to_features = vectors[:, keep] / np.sqrt(values[keep])
        phi = self.kernel(x, marks) @ to_features
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        target = np.where(y[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
        weights = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) / 100 * np.eye(phi.shape[1]), phi.T @ target)
        self.coefficients = (to_features @ weights[:-1]).astype(np.float32)
        self.constant = weights[-1].astype(np.float32)
        common, self.least = [], np.zeros(len(langs))
        for k in range(len(langs)):
            own = x[y == k] > 0
            times = own.sum(0)
            among = [(times[r] > 2).sum() / max(1, r.sum()) for r in own]
            common.append(times >= 2)
            self.least[k] = SLACK * np.quantile(among, 0.01)
        self.common = np.packbits(np.array(common), axis=1)

    def kernel(self, x: np.ndarray, marks: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(1, dtype=np.float64), 1))
        return (x @ marks.T) / size[:, None] / self.norm[None, :]

    def score(self, x: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return self.kernel(x, marks).astype(np.float32) @ self.coefficients + self.constant

    def known(self, x: np.ndarray, best: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Whether enough n-grams of each text are common in its best language."""
        shared = (x @ common.T)[np.arange(len(x)), best]
        return shared >= self.least[best] * np.maximum(x.sum(1), 1)


def fit(docs: DataFrame) -> Model | None:
    """Learn from (doc_id, text, lang); rows without text, language or id teach nothing."""
    lean(docs.sparkSession)
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null")
    n = labelled.select("lang").distinct().limit(MOST_LANGS + 1).count()
    if n > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} labels: this column holds no languages")
    if not n:
        return None
    fit_docs, per_lang = min(FIT_PER_LANG, max(LEAST_FIT, FIT_DOCS // n)), min(PER_LANG, max(LEAST_MARKS, LANDMARKS // n))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("lang", "doc_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fit_docs)
    # At most fit_docs ids of each language; an id that several rows repeat counts once, with its first text.
    chosen = chosen.groupBy("lang", "doc_id").agg(F.min("rank").alias("rank"))
    sample = labelled.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    rows = sorted(sample.mapInArrow(released(_packed), "lang string, rank int, bits binary").collect())
    langs = sorted({r.lang for r in rows})
    x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    return Model(langs, np.array([r["rank"] for r in rows]), x, np.array([langs.index(r.lang) for r in rows]), per_lang)


def classify(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language and score of each text, and whether its n-grams are that language's, a bounded number of texts at a time."""
    langs, scores, known = [], [], []
    marks = None if model is None else np.unpackbits(model.marks, axis=1).astype(np.float32)
    common = None if model is None else np.unpackbits(model.common, axis=1).astype(np.float32)
    offsets, data = utf8(column)
    for lo, hi in steps(offsets, 1 << 19):
        for a in range(lo, hi, 256):
            b = min(hi, a + 256)
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if model is None:
                langs += ["und"] * (b - a)
                scores.append(np.zeros(b - a))
                known.append(np.zeros(b - a, bool))
                continue
            grams = presence(part, own)
            values = model.score(grams, marks)
            best = values.argmax(1)
            sure = model.known(grams, best, common)
            names = [model.langs[i] for i in best.tolist()]
            score = np.clip((values[np.arange(b - a), best].astype(float) + 1) / 2, 0, 1)
            plain = np.concatenate([[0], np.cumsum(_LETTER[part], dtype=np.int32)])
            for i in np.flatnonzero(plain[own[1:]] == plain[own[:-1]]).tolist():
                if not has_letter(part[own[i] : own[i + 1]].tobytes()):
                    names[i], score[i], sure[i] = "und", 0.0, False
            langs += names
            scores.append(score)
            known.append(sure)
    return langs, np.concatenate([*scores, np.zeros(0)]), np.concatenate([*known, np.zeros(0, bool)])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (with ``text``) with lang_pred, score and known added; every other column passes through."""
    sent = lean(docs.sparkSession).sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "known").withColumn("text", F.col("text").cast("string"))
    at = kept.columns.index("text")

    def run(batches):
        for batch in batches:
            langs, scores, known = classify(sent.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "known"])

    return kept.mapInArrow(released(run), T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.BooleanType())]))


def held_out(doc_id="doc_id", modulus: int = 4, remainder: int = 2):
    """Whether crc32 of the id as text has the remainder; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
