import random

import duckdb
import numpy as np

from gradeloom.llm import common, minhash, op_queries

VOCABULARY = [f"w{i}" for i in range(400)]


def brute(rows, words, percent):
    def shingles(text):
        ws = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        if not ws:
            return set()
        return {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} or {tuple(ws)}

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets), key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(30, 120))]
        for share in (0, 0, 0.02, 0.04, 0.08, 0.1, 0.15, 0.3):
            ws = [rng.choice(VOCABULARY) if rng.random() < share else w for w in base]
            rows.append((n, " ".join(ws)))
            n += 1
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (3, "one two"), (None, rows[0][1]), (1006, "x" * 5000)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(df, 2, 80).collect()), key=repr)
    assert got == brute(rows, 2, 80)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_pairs_at_the_threshold(spark):
    """Pairs that share exactly 80 of 100 shingles: also those whose signatures differ in more symbols than the threshold."""
    rng = np.random.default_rng(8)
    rows, far = [], 0
    number = 0
    while far < 5 or len(rows) < 600:
        shared, own = [f"s{number}x{k}" for k in range(80)], [[f"{c}{number}x{k}" for k in range(10)] for c in "ab"]
        number += 1
        texts = [" ".join(rng.permutation(shared + o)) for o in own]
        import pyarrow as pa

        sets = list(minhash.shingle_sets(pa.array(texts), 1))
        assert len(np.intersect1d(*sets)) == 80 and len(np.union1d(*sets)) == 100
        signatures = [minhash.signature(s) for s in sets]
        over = (signatures[0] != signatures[1]).sum() > minhash.threshold()
        if over and not np.intersect1d(*minhash.index_keys(np.array(signatures))).size:
            continue  # shares no key: one in ten million
        if over or len(rows) < 590:
            far += over
            rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
        if number > 60_000:
            break
    assert far >= 5
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in out)


def test_drifting_group(spark):
    """A large group whose members are similar to some of the others only."""
    rng = random.Random(9)
    base = [rng.choice(VOCABULARY) for _ in range(90)]
    rows = [(i, " ".join(rng.choice(VOCABULARY) if rng.random() < rng.choice((0.02, 0.05, 0.08, 0.12)) else w for w in base)) for i in range(60)]
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()), key=repr)
    assert got == brute(rows, 2, 80)


def test_keys_meet_within_the_threshold():
    """Pigeonhole: signatures that differ in threshold() symbols share a key wherever the differences are."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, (200, minhash.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.SYMBOLS, minhash.threshold(), replace=False)
        row[at] ^= np.uint16(1)
    x, y = minhash.index_keys(a), minhash.index_keys(b)
    assert all(np.intersect1d(p, q).size for p, q in zip(x, y, strict=True))


def test_sql_says_the_same(spark, tmp_path):
    rows = [r for r in corpus() if r[0] not in (None, 3) or r[1] != "one two"]
    rows = [(i, t) for i, t in rows if i is not None]
    rows = list(dict(rows).items())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, n_shingles, component_id, kept from ({op_queries.ORACLE_SQL['op1_minhash_near_dedup']})").fetchall()
    got = op_queries.op1_minhash_near_dedup(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ids_with_several_texts(spark):
    """An id that occurs with different texts is one document for the links, an empty text of it included."""
    a, b, c = "one two three four five", "six seven eight nine ten", "a b c d e f"
    rows = [(2, b), (3, a), (3, b), (1, c), (9, c), (9, None), (4, a), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(df, 2, 80).collect()}
    assert got == {(2, 4): 2, (3, 4): 2, (4, 4): 2, (1, 5): 1, (9, 5): 1, (9, 0): 1, (7, 0): 7}


def test_frequent_shingles(spark, monkeypatch):
    """Equal results when every shared shingle counts as frequent."""
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    monkeypatch.setattr(common, "FREQUENT", 1)
    assert sorted((tuple(r)[:4] for r in minhash.near_duplicates(df, 2, 80).collect()), key=repr) == brute(rows, 2, 80)
