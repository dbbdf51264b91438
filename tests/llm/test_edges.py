"""Whole results against plain versions, and the cases every operator must take: empty tables, clashing columns, long texts."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gradeloom.llm import hmm, langid, leaks, minhash, pieces, pseudonyms, quotes, suffix, tokenfiles, winnow
from test_text_operators import ODD, documents
from test_whole_leaks import edited

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Documents with columns named like what operators make on their way."""
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", 1.5, [1]) for i, t, lang in rows], SCHEMA + ", words string, score double, found array<int>")


# Language ID


def plain_language(rows):
    """The classifier with plain Python sets and double precision."""

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

    kernel = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    fit = [(lang, t) for i, t, lang in rows if lang is not None and t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({lang for lang, _ in fit})
    sets = [bins(t) for _, t in fit]
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(sets)))
    keep = values > 1e-4
    to = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([gram @ to, np.ones((len(sets), 1))])
    target = np.where(np.array([langs.index(x) for x, _ in fit])[:, None] == np.arange(len(langs)), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + langid.RIDGE * len(phi) / 100 * np.eye(phi.shape[1]), phi.T @ target)
    out = {}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            out[i] = ("und", 0.0)
            continue
        s = np.append(np.array([kernel(bins(t), b) for b in sets]) @ to, 1.0) @ w
        out[i] = (langs[int(s.argmax())], float(np.clip((s.max() + 1) / 2, 0, 1)))
    return out


def test_language_against_plain_version(spark):
    rows = [r for r in documents(90, 3) if r[0] is not None and r[0] != 905]
    want = plain_language(rows)
    for r in langid.identify(table(spark, rows)).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=2e-3)


def test_all_languages_are_learned(spark):
    """More languages than a fixed number of landmarks each would allow, and ids that many rows repeat."""
    rng = random.Random(4)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(70)}
    rows = [(n, " ".join(rng.choice(words[k]) for _ in range(30)), k) for n, k in enumerate(list(words) * 8)]
    rows += [(10_000, rows[0][1], rows[0][2])] * 300
    out = langid.identify(table(spark, rows)).collect()
    assert len(out) == len(rows) and len({r.lang_pred for r in out}) == 70
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in out if r.doc_id < 10_000 and r.held_out]) > 0.95
    with pytest.raises(ValueError):
        langid.fit(spark.range(langid.MOST_LANGS + 5).selectExpr("id doc_id", "'a' text", "string(id) lang"))


# Decontamination


def test_leaks_of_all_lengths(spark):
    """Items of 10 to 400 bytes, each the only one of its length; documents that end in a letter; text without spaces."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 9)))
    items = {}
    for n in (10, 14, 25, 40, 50, 69, 73, 90, 110, 120, 128, 135, 200, 400):
        t = ""
        while len(t) < n:
            t += word() + " "
        items[n] = t[: n - 1] + "q"
    items[900] = "大学的图书馆在星期天早上九点钟开门请大家安静地看书不要说话"
    rows = []
    for n, t in items.items():
        for k, share in enumerate((0, 0.05, 0.1)):
            copy = edited(rng, t, int(len(t.encode()) * share / (1 if n < 900 else 3)))
            around = "これは別の文章です" if n == 900 else " ".join(word() for _ in range(20))
            rows.append((n * 10 + k, around + ("" if n == 900 else " ") + copy + ("" if n == 900 else " a" if k % 2 else " ") + ("続きます" if n == 900 else "")))
    for single in (False, True):
        for i, t in list(items.items()) if single else [(None, None)]:
            own = items if not single else {i: t}
            if single and i not in (50, 73, 120):
                continue
            out = leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(own.items()), "item_id long, text string"))
            got = {(r.doc_id, r.item_id): r.edits for r in out.collect()}
            want = {}
            for d, text in rows:
                for k, s in own.items():
                    e = leaks.edits(leaks.folded(s), leaks.folded(text))[0]
                    if e <= len(leaks.folded(s)) // 10:
                        want[d, k] = e
            assert got == want


# Language model


def plain_scores(rows):
    """Training and scoring in double precision, one sequence after the other."""
    def sequence(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        hashes, _ = hmm.token_hashes(raw, np.array([0, len(raw)]))
        return hashes, hmm.classes_of(hashes)

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = [sequence(t) for i, t, _ in rows if not held(i)]
    p = hmm.Parameters.random()
    start, move, emit = p.start.astype(float), p.move.astype(float), p.emit.astype(float)
    for _ in range(hmm.START_ROUNDS + hmm.ROUNDS):
        s0, m0, e0 = np.zeros_like(start), np.zeros_like(move), np.zeros_like(emit)
        for _, c in train:
            f = [start * emit[c[0]]]
            f[0] /= f[0].sum()
            for x in c[1:]:
                a = (f[-1] @ move) * emit[x]
                f.append(a / a.sum())
            b = [np.ones(hmm.STATES)]
            for x in c[:0:-1]:
                a = move @ (emit[x] * b[0])
                b.insert(0, a / a.sum())
            for t in range(len(c)):
                g = f[t] * b[t]
                e0[c[t]] += g / g.sum()
                if t:
                    xi = np.outer(f[t - 1], emit[c[t]] * b[t]) * move
                    m0 += xi / xi.sum()
            s0 += f[0] * b[0] / (f[0] * b[0]).sum()
        start, move, emit = (s0 + 0.1) / (s0 + 0.1).sum(), (m0 + 0.1) / (m0 + 0.1).sum(1, keepdims=True), (e0 + 0.01) / (e0 + 0.01).sum(0)
    count, of_class = {}, {}
    for h, c in train:
        for w, k in zip(h.tolist(), c.tolist()):
            count[w] = count.get(w, 0) + 1
            n, v = of_class.get(k, (0, set()))
            of_class[k] = (n + 1, v | {w})
    out = []
    for i, t, _ in rows:
        h, c = sequence(t)
        a, total = None, 0.0
        for x in c:
            a = (start if a is None else a @ move) * emit[x]
            total += math.log10(a.sum())
            a = a / a.sum()
        for w, k in zip(h.tolist(), c.tolist()):
            n, v = of_class.get(k, (0, ()))
            total += math.log10(count.get(w, 0) + 0.1) - math.log10(n + 0.1 * (len(v) + 1))
        out.append((i, len(h), total))
    return out


def test_model_against_plain_version(spark):
    rows = documents(50, 9)
    rows.append((950, " ".join(rows[k % 40][1] for k in range(60)), None))  # over two pieces
    want = sorted(plain_scores(rows), key=repr)
    got = [sorted(((r.doc_id, r.n_tokens, r.score) for r in hmm.score(table(spark, rows).repartition(n)).collect()), key=repr) for n in (1, 5)]
    for g in got:
        for (i, n, s), (j, m, x) in zip(g, want, strict=True):
            assert (i, n) == (j, m) and s == pytest.approx(x, rel=1e-3, abs=0.02)


# Empty tables, clashing columns, long texts


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert [df.count() for df in (pieces.encode_documents(none), pieces.decode_documents(spark.createDataFrame([], "doc_id long, token_ids array<int>")), tokenfiles.count_tokens(none), suffix.remove_repeats(none), winnow.compare_with_edits(none, 2))] == [0] * 5
    assert pseudonyms.pseudonymise(none, "k").count() == 0 and hmm.score(none).count() == 0 and minhash.near_duplicates(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.in_reply_order(quotes.link_quotations(turns)).count() == 0 and quotes.build_conversations(quotes.in_reply_order(quotes.link_quotations(turns))).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASH = "key long, rep long, component long, digest long, row long, hot double, words array<long>, file string, block long, item_id long, edits int, token_ids array<int>, lang_pred string"


def test_clashing_columns(spark, tmp_path):
    rows = [(i, t, lang) for i, t, lang in documents(12, 5) if i is not None]
    plain = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    more = plain.selectExpr("*", *(f"cast(null as {c.split(' ', 1)[1]}) as {c.split(' ', 1)[0]}" for c in CLASH.split(", ")))
    items = spark.createDataFrame([(1, rows[0][1][:60])], "item_id long, text string")
    same = lambda f: sorted(map(repr, f(plain).collect())) == sorted(map(repr, f(more).collect()))
    assert same(lambda d: leaks.find_leaks(d, items)) and same(pieces.encode_documents) and same(suffix.remove_repeats) and same(lambda d: tokenfiles.count_tokens(d).select("doc_id", "n_tokens"))
    assert same(lambda d: hmm.score(d).selectExpr("doc_id", "n_tokens", "n_known", "round(base_score, 6) b")) and same(minhash.near_duplicates)
    more.write.parquet(f"{tmp_path}/documents.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "token_ids", "round_trip"]


def test_long_segments_and_small_files(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = ["x" * 20_000, "".join(rng.choice("etaoin") for _ in range(20_000)), "日本語" * 3000, "ab" * 5000 + "c", "1" * 999, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode_documents(df).collect():
        assert r.token_ids == (None if texts[r.doc_id] is None else lib.encode(texts[r.doc_id]))
    tokenfiles.write_token_files(df.coalesce(1), f"file://{tmp_path}/t", file_bytes=100_000)
    sizes = [p.stat().st_size for p in (tmp_path / "t").glob("*.txt")]
    assert max(sizes) <= 100_000 and sum(sizes) > 50_000
    one = tokenfiles.write_token_files(spark.createDataFrame([(k, "a b c") for k in range(5000)] + [(9999, "x y " * 300_000)], "doc_id long, text string").coalesce(1), f"file://{tmp_path}/u", file_bytes=1 << 20)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "u").glob("*.txt"))
    assert one is None and len(sizes) == 2 and sizes[1] > 1 << 20 > sizes[0]  # one long text does not set the size of the other files
    found = {r.doc_id: r.n_tokens for r in tokenfiles.count_tokens(spark.createDataFrame([(1, "x" + " " * 1_500_000 + "y"), (2, " " * 1_500_000), (3, "a")], "doc_id long, text string")).collect()}
    assert found[3] == 1 and found[1] > 1000 and found[2] > 1000
    few = tmp_path / "few.tiktoken"
    few.write_bytes(b"YQ== 0\nYg== 50367\n")
    with pytest.raises(ValueError):
        tokenfiles.tokenizer(str(few))


def test_odd_rows_go_through_the_pipeline(spark, tmp_path):
    rows = [(*r, "s", 0) for r in documents(40, 6)] + [(*r, None, "s", 0) for r in ODD]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out if r.doc_id is not None} >= set(range(40)) and all(r.token_ids is not None for r in out)


def test_one_id_on_most_rows(spark):
    """Rows of a frequent id are dealt out by their texts; every row comes back, followed by its neighbour in that order."""
    rng = random.Random(19)
    rows = [(7 if k % 3 else k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(20))) for k in range(300)] + [(None, f"no id {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    want = sorted(((i, len(t), winnow.edited(t, order[(k + 1) % len(order)][1])) for k, (i, t) in enumerate(order)), key=repr)
    parts = winnow.with_followers(df, 8).filter("not guest").groupBy("bucket").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 150
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in winnow.compare_with_edits(df, 8).collect()), key=repr)
    assert got == sorted(((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in want), key=repr)


def test_every_round_of_the_language_model_reads_all_training_texts(spark, monkeypatch):
    seen, plain = [], hmm._round
    monkeypatch.setattr(hmm, "_round", lambda texts, p: seen.append(texts.count()) or plain(texts, p))
    hmm.train(spark.range(1500).selectExpr("id doc_id", "concat('word ', id % 7) text"))
    assert seen == [1500] * hmm.ROUNDS
