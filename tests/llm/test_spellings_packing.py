"""Spelling variants and packing against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradeloom.llm import packing, spellings

CLASH = "doc_id long, text string, word string, n long, id long, key long, root string, start long, sequence_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "r", 4, 5) for i, t in rows], CLASH)


def plain_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def distance_one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = defaultdict(list)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for a in words:
        near[a] = [b for size in (len(a) - 1, len(a), len(a) + 1) for b in by_length[size] if b != a and distance_one(a, b)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def variants(spark, rows, **more):
    out = spellings.group_variants(table(spark, rows).repartition(3), **more)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()))


def test_variants_against_all_pairs(spark):
    rng = random.Random(8)
    alphabet = "aé×"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 7))) for _ in range(200)]
    words += ["aaaaa" + "a" * k for k in range(6)] + ["STRASSE", "Strasse", "straße", "strase"]
    weights = [1 / (1 + k % 40) for k in range(len(words))]
    text = lambda: " ".join(rng.choices(words, weights, k=rng.randint(0, 300))) + rng.choice(["", ". 5", "日本語", "\n"])
    rows = [(k, text()) for k in range(80)] + [(None, text()), (3, text()), (4, None), (5, ""), (-7, text())]
    rows += [rows[0], rows[0]]
    want = plain_variants(rows)
    assert variants(spark, rows) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_long_texts_and_runs(spark, monkeypatch):
    """A run of 10^5 letters, three times; a text of several steps; few words at a time."""
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))
    rows = [(k, f"{long} {long[:-1] if k else long}") for k in range(4)] + [(9, "between words " * 90_000)]
    monkeypatch.setattr(spellings, "COUNTED", 2)
    got = {r[0]: r for r in variants(spark, rows, spoiled=0)}
    assert got["between"][3] == got["words"][3] == 90_000
    assert got[long][3:5] == (5, 1) and got[long[:-1]][3:5] == (3, 1) and got[long[:-1]][1] is None
    assert variants(spark, []) == [] and variants(spark, [(1, None)]) == []


def test_deletion_keys():
    words = ["aab", "ab", "abb", "", "b", "éab"]
    number, keys, whole = spellings.deletions(words)
    of = defaultdict(set)
    for n, k, w in zip(number.tolist(), keys.tolist(), whole.tolist()):
        of[n].add((k, w))
    plain = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    assert [len(of[n]) - 1 for n in range(6)] == [len(plain(w)) for w in words]
    key = {w: next(k for k, whole in of[n] if whole) for n, w in enumerate(words)}
    assert key["ab"] in {k for k, _ in of[0]} and key["ab"] in {k for k, _ in of[2]} and key["ab"] in {k for k, _ in of[5]} and key["b"] in {k for k, _ in of[1]}


# Packing


def rebuilt(rows, out):
    """Checks that the pieces hold every id of every row once and that sequences have no gaps; returns the padding."""
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(packing.VOCABULARY)
    left = Counter()
    ids = {}
    for i, t in rows:
        own = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        ids[i] = own
        left[i] += 1
    covered = defaultdict(Counter)
    for r in out:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and len(own) == r.length and r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(own.tobytes()) == r.ids_crc32
        covered[r.doc_id][r.start, r.start + r.length] += 1
    for i, spans in covered.items():
        times = np.zeros(len(ids[i]) + 1, int)
        for (a, b), n in spans.items():
            times[a] += n
            times[b] -= n
        assert (np.cumsum(times)[:-1] == left[i]).all()
    assert covered.keys() == ids.keys()
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for own in sequences.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
        padding += 0 if at & (at - 1) == 0 else packing.SEQUENCE - at
    return padding


def test_packing_keeps_every_id(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))
    rows = [(k, " ".join(word() for _ in range(int(rng.expovariate(1 / 300))))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "<|endoftext|> a<|endoftext|>"), (None, "no id"), (5_000, "two words " * 150_000), rows[0], rows[0]]
    out = packing.pack(table(spark, rows).repartition(3))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rebuilt(rows, out.collect()) == 0
    assert packing.pack(table(spark, [])).count() == 0


def test_level_is_the_best():
    """The chosen level leaves the smallest sum of squares of all that fit."""
    rng = random.Random(3)
    packer = packing.Packer(0, size=32)
    for k in range(3000):
        s = rng.choice([3, 5, 7, 11, 13, rng.randint(1, 31)])
        chosen = packer.level(s)

        def after(h):
            counts = packer.counts.copy()
            if h:
                counts[h] -= 1
            if h + s < 32:
                counts[h + s] += 1
            return int((counts**2).sum())

        options = [h for h in range(32 - s + 1) if h == 0 or packer.counts[h]]
        assert after(chosen) == min(map(after, options))
        packer.place([packing.Piece(k, 0, np.zeros(s, np.uint32), s)], s)


def test_many_open_sequences_are_merged():
    packer = packing.Packer(2, size=64, most_open=10)
    for k in range(500):
        packer.add(k, np.arange(40, dtype=np.uint32))
        assert packer.n_open <= 11
    packer.finish()
    sums = Counter()
    for doc, start, length, crc, total, sequence, offset in packer.done:
        assert total == 40 and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
        sums[sequence] += length
    assert sum(sums.values()) == 500 * 40 and all(n & (n - 1) == 0 for n in sums.values()) and min(sums) >> 33 == 2


def test_ids_on_every_code_point():
    """The fast encoder and the tokenizers library agree, in the neighbourhoods that decide splitting."""
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(packing.VOCABULARY)
    with open(packing.VOCABULARY, "rb") as f:
        own = packing.Encoder(f.read())
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 7)]]
    texts = ["".join(f"a{c}1{c} {c}{c}.{c}b {c}\n{c}5'{c}s" for c in points[at : at + 50]) for at in range(0, len(points), 50)]
    for text, found in zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert own.ids(text).tolist() == [*found.ids, 1]


def test_ids_in_steps(monkeypatch):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(packing.VOCABULARY)
    with open(packing.VOCABULARY, "rb") as f:
        own = packing.Encoder(f.read())
    long = " " * 1_500_000 + "x"  # one run that the fast library refuses
    assert own.ids(long).tolist() == [*lib.encode(long, add_special_tokens=False).ids, 1]
    rng = random.Random(2)
    monkeypatch.setattr(packing, "STEP", 9)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b ", "\n", "  ", "'s", "’", ".", "大学。", "5", "<|endoftext|>", "é", "\x85", "　"]) for _ in range(20))
        assert own.ids(text).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1]


def test_no_join_of_words_or_keys_goes_through_the_driver(spark):
    words = spark.createDataFrame([(i, f"word{i}") for i in range(50)], "id long, word string")
    plan = spellings.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
