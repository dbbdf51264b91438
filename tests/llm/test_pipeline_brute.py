"""The whole pipeline's rows against plain Python, stage by stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import langid, leaks, pieces, pseudonyms
from test_near_duplicates import brute
from test_whole_leaks import edited


def bins(t):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    out = set()
    for n in range(1, langid.LONGEST + 1):
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 257 + b + 1) % 2**32
            out.add((h * 0x9E3779B1 % 2**32) >> (32 - langid.BINS.bit_length() + 1))
    return out


def languages(rows):
    """Ids of the rows whose best language, by plain sets, they belong to."""
    fit = [(lang, bins(t)) for _, t, lang, *_ in rows if lang and t is not None]
    langs = sorted({lang for lang, _ in fit})
    gram = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for _, b in fit] for _, a in fit])
    values, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(fit)))
    to = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
    phi = np.hstack([gram @ to, np.ones((len(fit), 1))])
    target = np.where(np.array([langs.index(x) for x, _ in fit])[:, None] == np.arange(len(langs)), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + langid.RIDGE * len(phi) / 100 * np.eye(phi.shape[1]), phi.T @ target)
    times, least = {}, {}
    for lang in langs:
        own = [s for x, s in fit if x == lang]
        times[lang] = {}
        for s in own:
            for b in s:
                times[lang][b] = times[lang].get(b, 0) + 1
        least[lang] = langid.SLACK * np.quantile([sum(times[lang][b] > 2 for b in s) / max(1, len(s)) for s in own], 0.01)
    kept = set()
    for i, t, *_ in rows:
        s = bins(t)
        if not any(c.isalpha() for c in t or ""):
            continue
        k = np.array([len(s & b) / np.sqrt(max(1, len(s)) * len(b)) for _, b in fit])
        best = langs[int((np.append(k @ to, 1.0) @ w).argmax())]
        if sum(times[best].get(b, 0) >= 2 for b in s) >= least[best] * max(1, len(s)):
            kept.add(i)
    return kept


def test_rows_of_the_pipeline(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(41)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(60)] for lang, letters in (("en", "etaoinshrdlu"), ("fi", "äöyakivmjpou"))}
    make = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, make(lang := rng.choice(sorted(vocabulary)), rng.randint(20, 70)), lang, "s", 0) for i in range(70)]
    items = [(k, make("en", 25)) for k in range(6)]
    personal = ["4111 1111 1111 1111", "bo.42@mail.example.com", "2021-03-04", "10.20.30.40"]
    for k in range(20):
        words = rows[k][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words), rows[k][2], "s", 0))
        rows.append((200 + k, make("en", 15) + " " + edited(rng, items[k % 6][1], len(items[k % 6][1]) * k // 200) + " " + make("en", 15), "en", "s", 0))
        rows.append((300 + k, f"{make('en', 20)} {rng.choice(personal)} {make('en', 12)}, {rng.choice(personal)}.", "en", "s", 0))
    rows += [(400, "", None, "s", 0), (401, None, None, "s", 0), (402, "12 -- 34", "en", "s", 0), (403, "Всё это написано совсем другими буквами и на другом языке", None, "s", 0), (404, rows[3][1], None, "s", 0), (5, rows[5][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = languages(rows)
    left = [r for r in rows if r[0] in kept]
    firsts = {i for i, _, _, first in brute([r[:2] for r in left], 5, 80) if first}
    left = list(dict.fromkeys((r[0], r[1]) for r in left if r[0] in firsts))
    spoiled = lambda t: any(leaks.edits(leaks.folded(s), leaks.folded(t))[0] <= len(leaks.folded(s)) // 10 for _, s in items)
    left = [r for r in left if not spoiled(r[1])]
    new = {r.v: r.n for r in spark.createDataFrame([(v,) for v in personal], "v string").select("v", pseudonyms.pseudonym(F.col("v")).alias("n")).collect()}
    want = {}
    for i, t in left:
        marked = t
        for k, v in enumerate(personal):
            marked = marked.replace(v, chr(0xE000 + k))
        for k, v in enumerate(personal):
            marked = marked.replace(chr(0xE000 + k), new[v])
        want[i] = lib.encode(marked)
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 60 <= len(want) < 120 and not {402, 403, 404} & set(want)
