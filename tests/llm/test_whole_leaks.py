import random

import numpy as np

from gradeloom.llm import leaks

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        at, kind = rng.randrange(1, len(s) - 1), rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice(LETTERS)
        elif kind == 1:
            s.insert(at, rng.choice(LETTERS))
        else:
            del s[at]
    return "".join(s)


def test_copies_up_to_the_threshold(spark):
    """Insertions, deletions and substitutions up to a tenth of the bytes, against brute force."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(LETTERS[:8]) for _ in range(rng.randint(2, 8)))
    items = {i: " ".join(word() for _ in range(rng.randint(10, 60))) for i in range(20)}
    rows = []
    for d in range(120):
        s = items[d % 20]
        around = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(2)]
        rows.append((d, f"{around[0]} {edited(rng, s, int(len(s) * (0.02, 0.05, 0.08, 0.1, 0.1, 0.13)[d // 20]))} {around[1]}"))
    out = leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.edits, r.end_at) for r in out.collect()}
    want = {(d, i): x for d, t in rows for i, s in items.items() if (x := leaks.edits(leaks.folded(s), leaks.folded(t)))[0] <= len(leaks.folded(s)) // 10}
    assert got == want and len(want) >= 100


def test_short_items(spark):
    items = [(1, "What is seven times eight?"), (2, "Paris"), (3, "The capital of Norway"), (4, "日本"), (5, "42"), (6, " \n"), (7, "x" * 39 + "y")]
    rows = [
        (0, "so: what  is seven times EIGHT? yes"), (1, "what is sevn times eigth?"), (2, "what is sven tims eigth now?"), (3, "in Paris."), (4, "comparison, parisian, éparis"), (5, "the capitol of norway"),
        (6, "これは日本です"), (7, "1420 0.42"), (8, "142"), (9, "x" * 36 + "y"), (10, None), (11, "paris"), (12, "Parisé Paris"),
    ]
    want = {(0, 1), (3, 2), (5, 3), (6, 4), (7, 5), (9, 7), (11, 2), (12, 2)}
    want |= {(d, 1) for d in (1, 2) if leaks.edits(leaks.folded(items[0][1]), leaks.folded(rows[d][1]))[0] <= 2}
    for parts in (1, len(rows)):
        out = leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id"), spark.createDataFrame(items, "item_id long, text string"))
        assert {(r.doc_id, r.item_id) for r in out.collect()} == want


def test_recall_by_kind_of_edit():
    """A tenth of the bytes deleted, inserted, replaced: each kind by itself, of copies whose exact distance is within the limit."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice(LETTERS[:14]) for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(20, 60))).encode() for _ in range(100)]
    index = leaks.Items(list(range(100)), items, leaks.SHARE)
    for kind in "dis":
        rows, want = [], []
        for i, item in enumerate(items * 3):
            copy = bytearray(item)
            for _ in range(len(item) // 10):
                at = rng.randrange(1, len(copy) - 1)
                copy[at : at + (kind != "i")] = b"" if kind == "d" else rng.choice(LETTERS).encode()
            text = " ".join(word() for _ in range(rng.randint(1, 30))).encode() + b" " + bytes(copy) + b" " + word().encode()
            if leaks.edits(item, text)[0] <= len(item) // 10:
                want.append((len(rows), i % 100))
            rows.append(text)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        got = {(r, i) for r, i, _, _ in index.search([(0, np.frombuffer(b"".join(rows), np.uint8), offsets)])}
        assert len(want) > 250 and len(got & set(want)) >= 0.99 * len(want)
