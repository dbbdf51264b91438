"""Shared pieces: UTF-8 buffers of Arrow columns, rolling hashes, durable intermediate tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 20
PARALLEL_FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Rows that make a key of a join frequent, and most frequent keys (at most 24 bytes each) that are sent to all executors.
FREQUENT, BROADCAST_KEYS = 1024, 200_000

_rng = np.random.Generator(np.random.PCG64(20240917))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in a single process, where it may be unset, a folder of our own."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='gradeloom-')}"
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def lean(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of texts bounded, unless its own setting is not Spark's default.

    Workers hold a batch and what they derive from it, so its size is the measure of their memory.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shipped(spark: SparkSession, path: str):
    """A vocabulary file of the driver (some MB at most) for all executors, which need not have it themselves."""
    with open(path, "rb") as f:
        return lean(spark).sparkContext.broadcast(f.read())


#: For the C library: how much free memory it keeps, from which size on a block is its own mapping, by how much it grows.
MALLOC = ((-1, 64 << 20), (-3, 32 << 20), (-2, 4 << 20))


#: What empties the things that operators keep in a worker from task to task, and the operator that ran last.
KEPT: list = []
_last = [""]


def _settle(operator: str) -> None:
    """Arrays of some MB come and go in every step; a task takes their memory from the system once, not each time.

    A worker that another operator used before drops what that one kept.
    """
    if operator != _last[0]:
        for empty in KEPT:
            empty()
        _last[0] = operator
        _release()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        for key, value in MALLOC:
            ctypes.CDLL(None).mallopt(key, value)
    except AttributeError:  # another C library
        pass


def _release() -> None:
    """Give freed memory back to the system: idle workers keep what their allocators hold otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass


def released(run):
    """A function for mapInArrow whose worker holds no freed memory once its task is done."""

    def wrapped(batches):
        _settle(run.__module__)
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gradeloom/{label}-{uuid.uuid4().hex}"
    # Partitions of the size the session advises, however many cores are free: a small table is one file.
    before = spark.conf.get(PARALLEL_FIRST, "true")
    spark.conf.set(PARALLEL_FIRST, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(PARALLEL_FIRST, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of a stored table with unique keys, ``weight`` being how many rows each has.

    Frequent keys (``FREQUENT`` rows, or more where too many keys have that) go to all executors, so
    their rows stay where they are; the others meet in a shuffle, where no key is frequent.
    """
    reach = np.zeros(64, np.int64)
    for r in keys.filter(F.col(weight) >= FREQUENT).groupBy(F.floor(F.log2(weight) + 1e-9).cast("int").alias("p")).count().collect():
        reach[r.p] = r["count"]
    if not reach.any():
        return rows.join(keys, on)
    above = np.cumsum(reach[::-1])[::-1]
    least = max(FREQUENT, 1 << int(np.argmax(above <= BROADCAST_KEYS)))
    hot, cold = keys.filter(F.col(weight) >= least), keys.filter(F.col(weight) < least)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes together; every row is in one range."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits; bijective."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for j, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[j] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a sequence of 64-bit codes."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    lengths = (ends - starts).astype(U64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * U64(0xD6E8FEB86659FD93))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams by doubling; result i covers codes[i:i+k]."""
    have, size, out, done, power = codes, 1, None, 0, BASE
    while True:
        if k & size:
            if out is None:
                out, done = have, size
            else:
                n = len(codes) - done - size + 1
                out = out[:n] * power + have[done : done + n]
                done += size
        if size * 2 > k:
            return out
        n = len(have) - size
        have = have[:n] * power + have[size:]
        power, size = U64(int(power) ** 2 % 2**64), size * 2


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+``; words end where texts end."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the number of values in each row."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def records(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)
