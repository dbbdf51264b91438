"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds the hashes of its distinct word shingles. ``SYMBOLS`` minima of
``SYMBOL_BITS`` bits make its signature. The signature is cut into chunks of ``CHUNK`` symbols;
two signatures that differ in at most ``threshold()`` symbols have, by pigeonhole, a chunk with at
most ``ERRORS`` wrong symbols, so enumerating which symbols of a chunk may be wrong gives index
keys on which all such pairs meet. At a set similarity of 0.8 a symbol differs with probability
0.2, so the threshold lies 3.7 standard deviations above the mean. It only orders the work: a pair above it that
shares a key is still compared by its sets in the end. A pair at 0.8 shares no key with a probability of about 1e-7.

Links are confirmed on whole sets. Equal sets are collapsed before anything is joined. Inside a
key no pairs are emitted at first: every member meets the key's smallest id, then its best linked member; components are
built from confirmed links; later rounds look at all pairs that still lie in different components, have keys that join
components, and share one of their rarest shingles, which sets of the wanted similarity must.

Defined results: null, empty and blank texts have an empty set and no links; rows with a null id
keep their set size and get a null component and ``kept`` false; rows that repeat an id share its
component; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, LOWER_CODE, U64, drop_stored, join_keys, lean, mix, records, released, span_hashes, steps, stored, utf8, word_spans

SYMBOLS, SYMBOL_BITS, CHUNK, ERRORS = 60, 16, 5, 1
#: Largest number of ids sent to all executors as a filter (8 bytes each); beyond it the filter is a shuffled join.
BROADCAST_IDS = 500_000
#: Closest candidates of a document that a round confirms before components are rebuilt.
CLOSEST = 3
#: Rounds in which members of a key also meet its best linked member.
HUB_ROUNDS = 2

_rng = np.random.Generator(np.random.PCG64(77))
SEEDS = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
FACTORS = _rng.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def threshold() -> int:
    """Symbols in which two signatures may differ and still surely share a key."""
    return SYMBOLS // CHUNK * (ERRORS + 1) - 1


def shingle_sets(column: pa.Array, words: int):
    """For each text, in order, the sorted distinct 64-bit hashes of its word shingles."""
    offsets, data = utf8(column)
    for lo, hi in steps(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, rows = word_spans(part, own)
        hashes = span_hashes(LOWER_CODE[part], starts, ends)
        cut = np.searchsorted(rows, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            own_words = hashes[cut[i] : cut[i + 1]]
            size = min(words, len(own_words))
            if not size:
                yield own_words
                continue
            total = np.full(len(own_words) - size + 1, size, U64)
            for j in range(size):
                total = total * BASE + own_words[j : j + len(total)]
            yield np.unique(mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The b-bit minima of a non-empty set."""
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), 2048):
        x = (low[None, lo : lo + 2048] ^ SEEDS[:, None]) * FACTORS[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(1), out=out)
    return (out * np.uint32(0x297A2D39) >> np.uint32(32 - SYMBOL_BITS)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of each signature (row): a chunk without each choice of ``ERRORS`` = 1 of its symbols."""
    chunks = signatures.reshape(len(signatures), -1, CHUNK).astype(U64)
    keys = []
    for wrong in range(CHUNK):
        kept = [j for j in range(CHUNK) if j != wrong]
        value = np.zeros(chunks.shape[:2], U64)
        for j in kept:
            value = (value << U64(SYMBOL_BITS)) | chunks[:, :, j]
        salt = (np.arange(chunks.shape[1], dtype=U64) * U64(CHUNK) + U64(wrong)) * U64(0xA0761D6478BD642F)
        keys.append(mix(value ^ mix(salt + U64(1))[None, :]))
    return np.concatenate(keys, 1).view(np.int64)


def _sketch(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            sizes, ids, signatures = [], [], []
            for s in shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield records({"doc_id": batch.column(0), "n_shingles": sizes, "set_id": ids, "signature": signatures}, schema)

    return run


def _keys(batches):
    schema = pa.schema([("rep", pa.int64()), ("keys", pa.list_(pa.int64()))])
    for batch in batches:
        if batch.num_rows:
            _, data = utf8(batch.column(1))
            keys = index_keys(data.view(np.uint16).reshape(batch.num_rows, SYMBOLS))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1]
            yield records({"rep": batch.column(0), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))}, schema)


def _distance(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])
    for batch in batches:
        if batch.num_rows:
            x, y = (utf8(batch.column(i))[1].view(np.uint16).reshape(batch.num_rows, SYMBOLS) for i in (2, 3))
            yield records({"a": batch.column(0), "b": batch.column(1), "distance": (x != y).sum(1).astype(np.int32)}, schema)


def _sets(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
            yield records({"doc_id": batch.column(0), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))}, schema)

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked id with the smallest id it reaches.

    Smallest labels travel along the links and labels jump to their own label's label, one stored
    table for each round, until none changes.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    table = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    labels = table.select("id", "component")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("there")), "b").groupBy(F.col("a").alias("id")).agg(F.min("there").alias("there"))
        near = labels.join(seen, "id").select("id", "component", F.least("component", "there").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        new = stored(near.join(jump, "near", "left").select("id", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("component")).alias("moved")), "labels")
        drop_stored(table)
        table, labels = new, new.select("id", "component")
        if not new.filter("moved").head(1):
            drop_stored(both)
            return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    both = both.withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    union = F.size("set_a") + F.size("set_b") - F.col("shared")
    return both.filter(100 * F.col("shared") >= percent * union).select("a", "b").distinct()


def _mixed(met: DataFrame, found: DataFrame) -> DataFrame:
    """(key, rep, component) of the keys that join components."""
    placed = met.select("key", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return placed.join(mixed, "key")


def _to_hubs(mixed: DataFrame, links: DataFrame) -> DataFrame:
    """Each member of a key with the key's best linked member, where their components differ."""
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("degree"))
    mixed = mixed.join(degree, "rep", "left")
    hubs = mixed.groupBy("key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("rep").alias("hub"), F.col("component").alias("of_hub"))).alias("x")).select("key", "x.hub", "x.of_hub")
    pairs = mixed.join(hubs, "key").filter("component <> of_hub")
    return pairs.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()


def _apart(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components, of documents whose keys join components, that can still be similar.

    Sets of the wanted similarity must share one of their rarest shingles: as many of each set as
    it may lack, and one more. Where the first shared one stands in both orders bounds what they
    can share at all. Copies that have drifted too far from a large group hold only shingles of
    their own among their rarest and meet nobody.
    """
    rest = stored(mixed.select("rep", "component").distinct(), "rest")
    own = rest.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = own.groupBy("shingle").agg(F.count("*").alias("df"))
    rank = F.array_sort(F.collect_list(F.struct("df", "shingle")))
    rare = own.join(common, "shingle").groupBy("rep", "component", "n").agg(rank.alias("ranked"))
    lacking = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1
    rare = rare.select("rep", "component", "n", F.posexplode(F.slice("ranked", F.lit(1), lacking)).alias("at", "x")).filter("x.df > 1")
    rare = stored(rare.select("rep", "component", "n", "at", F.col("x.shingle").alias("shingle")), "rare")
    joins = rare.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n_key")).filter("lo < hi").select("shingle", "n_key")
    # Stored, so that both sides of the join stand alone behind their exchanges and Spark may split the rows of a frequent shingle.
    rare = stored(join_keys(rare, joins, ["shingle"], "n_key"), "rare")
    x = rare.select("shingle", F.col("rep").alias("a"), F.col("component").alias("of_a"), F.col("n").alias("n_a"), (F.col("n") - F.col("at")).alias("left_a"))
    y = rare.select("shingle", F.col("rep").alias("b"), F.col("component").alias("of_b"), F.col("n").alias("n_b"), (F.col("n") - F.col("at")).alias("left_b"))
    can = (F.col("of_a") < F.col("of_b")) & ((100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return x.join(y, "shingle").filter(can).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id, kept, n_links.

    ``n_links`` counts the confirmed links the document took part in; copies that share a set
    count through their set's smallest id only.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stored(docs.mapInArrow(released(_sketch(words)), "doc_id long, n_shingles long, set_id binary, signature binary"), "sketch")
    reps = stored(sketched.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")), "reps")
    keyed = reps.select("rep", "signature").mapInArrow(released(_keys), "rep long, keys array<long>").select("rep", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lowest"), F.max("rep").alias("highest")).filter("lowest < highest").select("key", "lowest")
    met = stored(keyed.join(shared, "key"), "met")
    ids = met.select(F.col("rep").alias("doc_id")).distinct()
    # At most one row for each met document; the plan sends it everywhere only if its count allows.
    met_ids = stored(ids, "ids")
    small = met_ids.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(met_ids) if small else met_ids, "doc_id", "left_semi")
    sets = stored(wanted.mapInArrow(released(_sets(words)), "doc_id long, shingles array<long>"), "sets")
    marks = reps.select("rep", "signature")

    def close(pairs: DataFrame) -> DataFrame:
        a, b = (marks.select(F.col("rep").alias(x), F.col("signature").alias(f"sig_{x}")) for x in "ab")
        full = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
        return full.mapInArrow(released(_distance), "a long, b long, distance int").filter(F.col("distance") <= threshold())

    # An id that has several sets links them.
    set_key = F.coalesce("set_id", F.lit(b""))
    several = stored(sketched.filter("doc_id is not null").groupBy("doc_id").agg(F.min(set_key).alias("lo"), F.max(set_key).alias("hi")).filter("lo < hi").select("doc_id"), "several")
    repeats = bool(several.head(1))
    if repeats:
        same_id = sketched.join(several, "doc_id").select("doc_id", "set_id").join(reps.select("set_id", "rep"), "set_id").filter("doc_id <> rep")
        same_id = stored(same_id.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct(), "same-id")

    first = close(met.filter("lowest < rep").select(F.col("lowest").alias("a"), F.col("rep").alias("b")).distinct())
    ranked = first.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "a"))), 1, CLOSEST).alias("near"))
    tested = stored(ranked.select("b", F.explode("near").alias("x")).select("x.a", "b"), "tested")
    links = stored(_confirmed(tested, sets, percent), "confirmed")
    hubs = HUB_ROUNDS
    while True:
        found = components(links.union(same_id) if repeats else links)
        mixed = stored(_mixed(met, found), "mixed")
        candidates = _to_hubs(mixed, links) if hubs else _apart(mixed, sets, percent)
        new_pairs = candidates.join(tested, ["a", "b"], "left_anti")
        # Signatures say which pairs to try first; the last word has the join of rare shingles, which goes by the sets alone.
        open_pairs = stored(close(new_pairs) if hubs else new_pairs, "open")
        more = stored(_confirmed(open_pairs, sets, percent), "confirmed")
        new = bool(more.head(1))
        if not hubs and not new:
            break
        hubs = hubs - 1 if hubs and new else 0
        drop_stored(mixed)
        tested = stored(tested.union(open_pairs.select("a", "b")).distinct(), "tested")
        links = stored(links.union(more), "confirmed") if new else links
    drop_stored(met, met_ids, sets, mixed)
    ends = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    of_set = reps.select("set_id", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").join(ends, "rep", "left")
    out = sketched.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    if repeats:  # all rows of such an id take its component, also that of an empty text
        by_id = several.join(found.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", F.col("component").alias("of_id"))
        out = out.join(by_id, "doc_id", "left")
    else:
        out = out.withColumn("of_id", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_id", "component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
