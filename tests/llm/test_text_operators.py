import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gradeloom.llm import common, hmm, langid, leaks, pieces, suffix, tokenfiles, winnow

WORDS = {"en": "the and that with from this have which their would about there".split(), "de": "und der die das nicht mit sich auch eine werden über für".split(), "fr": "les des une dans pour qui sur avec pas être à où".split()}
ODD = [(900, None), (901, ""), (902, " \n "), (903, "7 8 9 --- !!"), (None, "no id here"), (904, "a"), (905, "same text twice in two rows"), (905, "same text twice in two rows"), (906, "日本語 ünïcode 😀 " * 5)]


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def documents(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(sorted(WORDS)), rng.randint(5, 80)), lang) for i in range(n)] + [(i, t, None) for i, t in ODD]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, words string, score double")


# Winnowing


def brute_winnow(t, k, w):
    """Positions chosen by plain minima over the operator's own gram hashes."""
    if not t:
        return []
    grams = [winnow.fingerprints([t[i : i + k]], k, w)[0][0][0] for i in range(max(1, len(t) - k + 1))]
    if len(grams) <= w:
        windows = [range(len(grams))]
    else:
        windows = [range(i, i + w) for i in range(len(grams) - w + 1)]
    return sorted({max(r, key=lambda i: (-int(grams[i]), i)) for r in windows})


def test_winnowing(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(n)) for n in (0, 1, 3, 4, 9, 30, 200)]
    for t, (h, p) in zip(texts, winnow.fingerprints(texts, 4, 5), strict=True):
        assert p.tolist() == brute_winnow(t, 4, 5) and len(h) == len(p)
    shared = "".join(rng.choice("abcdefgh") for _ in range(winnow.GRAM + winnow.WINDOW - 1))
    a, b = winnow.fingerprints([text(rng, "en", 30) + shared + text(rng, "de", 30), text(rng, "fr", 20) + shared])
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_fingerprints_of_followers(spark):
    rows = [r for r in documents() if r[0] != 905]
    for parts in (1, 3, 7):
        out = winnow.compare_with_edits(frame(spark, rows), parts).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        follower = {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}
        assert len(out) == len(rows)
        own = {r[0]: r[1] or "" for r in rows}
        for r in out:
            t, f = own[r.doc_id], follower[r.doc_id]
            changed = winnow.edited(t, f)
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            prints = [np.unique(h) for h, _ in winnow.fingerprints([t, changed, f])]
            assert r.near_edited == winnow.likeness(prints[0], prints[1]) and r.near_next == winnow.likeness(prints[0], prints[2])
    repeated = winnow.compare_with_edits(frame(spark, documents()), 2)
    assert repeated.count() == len(documents()) and len({r.fingerprint for r in repeated.filter("doc_id = 905").collect()}) == 1
    assert winnow.compare_with_edits(frame(spark, rows).limit(0), 2).count() == 0


# Language ID


def test_language_accuracy(spark):
    rows = documents(300)
    out = {(r.doc_id): r for r in langid.identify(frame(spark, rows)).collect()}
    truth = {i: lang for i, _, lang in rows if lang}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(out[i].held_out for i in held) and np.mean([out[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902, 903))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(frame(spark, rows).limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(frame(spark, [(i, t, None) for i, t, _ in rows])).collect()} == {"und"}


def test_held_out_does_not_teach(spark):
    rows = documents(120)
    spoiled = [(i, t, "xx" if lang and zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    key = lambda r: (str(r.doc_id), r.lang_pred, r.score)
    assert sorted(map(key, langid.identify(frame(spark, rows)).collect())) == sorted(map(key, langid.identify(frame(spark, spoiled)).collect()))


# Decontamination


def test_edit_distance_and_fold():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    rng = random.Random(4)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(lo, 12))) for lo in (1, 0))
        assert leaks.edits(a, b)[0] == brute(a, b)
    assert leaks.folded("  A \n b\tC ") == b"a b c" and leaks.folded(None) == b"" and leaks.folded(" \n") == b""


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(14, 50)))) for i in range(30)] + [(97, None), (98, "short"), (3, None)]
    rows, truth = [], set()
    for d in range(120):
        t = [word() for _ in range(rng.randint(0, 150))]
        if d % 2:
            i, s = items[d % 30]
            s = list(s)
            for _ in range(int(0.03 * len(s)) if d % 4 == 1 else 0):
                s[rng.randrange(len(s))] = rng.choice(letters)
            t.insert(rng.randint(0, len(t)), "".join(s).upper() if d % 3 == 0 else "".join(s))
            truth.add((d, i))
        rows.append((d, "  ".join(t)))
    rows += ODD
    out = leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert got <= truth and len(got) >= 0.97 * len(truth)
    assert {x for x in truth if x[0] % 4 != 1} <= got
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), empty).count() == 0


# SentencePiece


def test_pieces_are_the_library_s(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(8)
    texts = [text(rng, lang, 40) + ", " + text(rng, lang, 3) + "." for lang in sorted(WORDS)] + [" a  b\n c\t é ￿ x ", "  ", "\n", "aaaaaaa" * 40, "日本語 😀😀 a▁b", "x" * 300 + " y", "12345  678", "e.g. http://a.b/c?d=e"]
    rows = [(i, t) for i, t in enumerate(texts)] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r, t in zip(pieces.encode_documents(df.coalesce(1)).collect(), [t for _, t in rows], strict=True):
        assert (r.token_ids is None) if t is None else (r.token_ids == lib.encode(t)), t
        assert r.round_trip == ("▁" not in (t or "")) and r.n_tokens == len(r.token_ids or ())
    back = pieces.decode_documents(pieces.encode_documents(df.filter("doc_id < 900")))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


# Hidden Markov model


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    p = hmm.Parameters.random()
    seqs = [rng.integers(0, 50, n) for n in (1, 2, 9, 30)]
    got = hmm.log10_forward(p, np.concatenate(seqs).astype(np.int32), np.array([len(s) for s in seqs]))
    for s, g in zip(seqs, got, strict=True):
        a = p.start.astype(float) * p.emit[s[0]]
        for c in s[1:]:
            a = (a @ p.move) * p.emit[c]
        assert g == pytest.approx(math.log10(a.sum()), rel=1e-4)


def test_expected_counts_are_exact():
    rng = np.random.default_rng(2)
    p = hmm.Parameters.random()
    seqs = [rng.integers(0, 20, n) for n in (1, 3, 7)]
    into = np.zeros(hmm.SIZE)
    hmm.expected_counts(p, np.concatenate(seqs).astype(np.int32), np.array([len(s) for s in seqs]), into)
    start, move, emit = hmm.unflat(into)
    want_start, want_move, want_emit = np.zeros_like(start), np.zeros_like(move), np.zeros_like(emit)
    for s in seqs:
        f, b = [p.start * p.emit[s[0]]], [np.ones(hmm.STATES)]
        for c in s[1:]:
            f.append((f[-1] @ p.move) * p.emit[c])
        for c in s[:0:-1]:
            b.insert(0, p.move @ (p.emit[c] * b[0]))
        total = f[-1].sum()
        g = [x * y / total for x, y in zip(f, b, strict=True)]
        want_start += g[0]
        for t, c in enumerate(s):
            want_emit[c] += g[t]
            if t:
                want_move += np.outer(f[t - 1], p.emit[c] * b[t]) * p.move / total
    assert np.allclose(start, want_start, rtol=1e-3) and np.allclose(move, want_move, rtol=1e-3, atol=1e-6) and np.allclose(emit, want_emit, rtol=1e-3, atol=1e-6)


def test_scores(spark, monkeypatch):
    rows = [(i, t) for i, t, _ in documents(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for hot in (hmm.HOT_WORDS, 3):  # all words sent, and nearly all joined
        monkeypatch.setattr(hmm, "HOT_WORDS", hot)
        out = sorted(hmm.score(df).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
        for r, (i, t) in zip(out, sorted(rows, key=lambda x: (str(x[0]), len(words(x[1])))), strict=True):
            ws = words(t)
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            assert r.score < 0
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert hmm.score(df.limit(0)).count() == 0


# Token files


def test_token_counts(spark, tmp_path):
    encode = tokenfiles.tokenizer(tokenfiles.VOCABULARY).encode_ordinary
    rows = [(i, t) for i, t, _ in documents(40)] + [(-5, "minus"), (2**62 + 7, "big")]
    out = tokenfiles.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_tokens) for r in out.collect()), key=repr) == sorted(((i, len(encode(t or ""))) for i, t in rows), key=repr)
    tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"{tmp_path}/t")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{tmp_path}/t")
    for block in (1, 2, 7, 64, 1 << 18):  # edges anywhere, also inside the header
        found = tokenfiles.scan(files, header=tokenfiles.HEADER, block=block).orderBy("document").collect()
        assert [(tokenfiles.read_id(r["head"]), r.n_tokens) for r in found] == [(i, len(encode(t or ""))) for i, t in rows]
    open_end = spark.createDataFrame([("f", np.array([1, 2, tokenfiles.END, 3], ">u2").tobytes()), ("g", b""), ("h", None)], "path string, content binary")
    assert [(r.file, r.document, r.n_tokens) for r in tokenfiles.scan(open_end).orderBy("file", "document").collect()] == [("f", 0, 2), ("f", 1, 1)]


# Repeated byte strings


@pytest.mark.parametrize(("hot", "frequent"), [(1, 1), (2, 4)])
def test_hot_keys_are_split_without_loss(spark, monkeypatch, hot, frequent):
    """A line that all documents hold, shared stretches of many lengths around it: as brute force finds them."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(common, "FREQUENT", frequent)
    rng = random.Random(17)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    left, right = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(2))
    make = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    rows = [(i, make(rng.randint(0, 90)) + left[200 - rng.randint(0, 150) :] + line + right[: rng.randint(0, 150)] + make(rng.randint(0, 90))) for i in range(60)]
    rows += [(100, line), (101, line * 3), (102, "q" * 900), (102, "q" * 900)]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out.collect()), key=repr)
    assert got == brute_repeats(rows, suffix.LENGTH)


def brute_repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), len(suffix.flag_runs(gone)), kept))
    return sorted(out, key=repr)


def test_transform_finds_all_repeats():
    rng = random.Random(1)
    for _ in range(150):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        seen = Counter(t[i : i + 8] for t in texts for i in range(len(t) - 7))
        for t, f in zip(texts, suffix.repeated_windows(texts, 8), strict=True):
            assert f.tolist() == [seen[t[i : i + 8]] > 1 for i in range(len(t) - 7)]


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(7)
    shared = [text(rng, "de", n) for n in (30, 45, 80)]
    rows = [(i, text(rng, "en", rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 40) :] + text(rng, "fr", rng.randint(0, 60))) for i in range(40)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, "!! " * 200), (102, shared[2] + "é" + shared[2]), (103, "z" * 199), *ODD]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out.collect()), key=repr)
    assert got == brute_repeats(rows, suffix.LENGTH)
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
