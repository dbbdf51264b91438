"""Token counts of flat token files by a separator scan.

A token file is nothing but big-endian 16-bit ids, documents one after the other, each closed by an
end-of-document id; there is no index. Files are read in blocks of ``BLOCK`` ids. In each block one
vectorised comparison finds the separators; documents inside are counted there, and the pieces at
the block's edges are stitched: a prefix sum of the separators of earlier blocks gives each piece
the number of its document in the file, under which pieces add up. Files are read once: the pieces
are stored, and stitching reads those of the blocks' edges only.

``write_token_files`` makes such files from documents. It opens each document with ``HEADER`` ids of
15 bits that spell the document's id, since a flat file has no other place for it. The
end-of-document id 0xC4BF is above the tokenizer's ids and is a UTF-8 character, so Spark's text
writer can put it as its line separator, which is how the files get to any store that Spark writes.

Defined results: a file's last document counts also without a separator if it has an id; empty
files have no documents; null and empty texts are documents without tokens; null ids come back null.
A file is one record of Spark's reader, which may have 2 GB at most. The writer packs documents into records of some MB, so many
of them to a file; a text whose ids may not fit into a record has a file of its own. A scan of a file over 2 GB
fails with the reader's error. A vocabulary with ids from the end-of-document id on is refused.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEPT, released, shared_dir, shipped, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END, END_TEXT, CLOSE = 0xC4BF, "Ŀ", b"\xc4\xbf"
HEADER = 5
BLOCK = 1 << 18
#: Bytes of a file at most, but for those that hold one long text, and records in it.
FILE_BYTES, RECORDS = 1 << 26, 16
#: White space of a text that is looked at as one piece.
LONG_SPACE = re.compile(r"\s{100000,}")
NO_ID = 1 << 70


@functools.lru_cache(1)
def tokenizer(ranks: str | bytes):
    """The tokenizer of a file of base64 tokens and ranks, given by its path or content; a worker keeps the last one."""
    import tiktoken

    if isinstance(ranks, str):
        with open(ranks, "rb") as f:
            ranks = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    if max(ranks.values()) >= END:
        raise ValueError(f"the vocabulary has ids from the end-of-document id {END} on")
    return tiktoken.Encoding("flat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


KEPT.append(tokenizer.cache_clear)


def encode(encoding, text: str) -> list[int]:
    """The ids of any text: the library gives up on very long runs of white space, which all but their last character are pieces by themselves."""
    if len(text) < 100_000 or not LONG_SPACE.search(text):
        return encoding.encode_ordinary(text)
    out, lo = [], 0
    for run in LONG_SPACE.finditer(text):
        out += encoding.encode_ordinary(text[lo : run.start()])
        lo = run.end() - (run.end() < len(text))
        out += encoding._encode_single_piece(text[run.start() : lo])
    return out + encoding.encode_ordinary(text[lo:])


def spelled(doc_id: int | None) -> list[int]:
    value = NO_ID if doc_id is None else doc_id % 2**64
    return [value >> 15 * i & 0x7FFF for i in range(HEADER)]


def read_id(head: list[int]) -> int | None:
    value = sum(x << 15 * i for i, x in enumerate(head))
    return None if value >= NO_ID else value - 2**64 * (value >> 63)


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES) -> None:
    """Tokenise (doc_id, text) into flat files below ``path``, none of which has over ``file_bytes`` unless one text alone may."""
    record = file_bytes // RECORDS - 2  # the writer closes each with a separator

    def run(batches):
        encoding, rows, size = tokenizer(sent.value), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.array(spelled(doc_id) + encode(encoding, text.as_py() or ""), ">u2").tobytes()
                if rows and size + len(row) > record:
                    yield pack([CLOSE.join(rows)])
                    rows, size = [], 0
                rows.append(row)
                size += len(row) + len(CLOSE)
        if rows:
            yield pack([CLOSE.join(rows)])

    def pack(rows):  # bytes under the type of text: the writer copies them as they are
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        column = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(rows))])
        return pa.RecordBatch.from_arrays([column], names=["value"])

    sent = shipped(docs.sparkSession, vocabulary)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    # A text has no more ids than bytes.
    fits = F.coalesce(F.octet_length("text"), F.lit(0)) <= (record - len(CLOSE)) // 2 - HEADER
    write = lambda df, n: df.mapInArrow(released(run), "value string").write.mode("append").option("lineSep", END_TEXT).option("maxRecordsPerFile", n).text(path)
    longer = docs.filter(~fits)
    write(docs.filter(fits), RECORDS)
    if longer.head(1):
        write(longer, 1)


PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("ends", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("head", pa.list_(pa.int32()))])


def scan_block(ids: np.ndarray, end: int, header: int):
    """Pieces of one block, in order: their lengths, their first ids, and the number of separators."""
    at = np.flatnonzero(ids == end)
    starts = np.concatenate([[0], at + 1])
    lengths = np.concatenate([at, [len(ids)]]) - starts
    take = np.minimum(lengths, header)
    ends = np.concatenate([[0], np.cumsum(take)])
    flat = ids[np.repeat(starts - ends[:-1], take) + np.arange(ends[-1])].astype(np.int32)
    heads = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
    return lengths, heads, len(at)


def scan(files: DataFrame, end: int = END, header: int = 0, block: int = BLOCK) -> DataFrame:
    """(file, document, n_tokens, head) from (path, content): each document's number in its file, its ids after the first ``header``, and those."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                content = np.frombuffer(batch.column(1)[i].as_buffer() or b"", ">u2")
                for b, lo in enumerate(range(0, len(content), block)):
                    lengths, heads, ends = scan_block(content[lo : lo + block].astype(np.uint16), end, header)
                    n = len(lengths)
                    whole = np.ones(n, bool)
                    whole[[0, -1]] = False  # the edges go on in other blocks
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.string()), pa.array(np.full(n, b)), pa.array(np.arange(n)), pa.array(np.full(n, ends)), pa.array(whole), pa.array(lengths), heads], schema=PIECES)

    pieces = stored(files.select("path", "content").mapInArrow(released(run), "file string, block long, nth long, ends long, whole boolean, n long, head array<int>"), "pieces")
    before = pieces.filter("nth = 0").select("file", "block", F.coalesce(F.sum("ends").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = pieces.join(before, ["file", "block"]).withColumn("document", F.col("before") + F.col("nth"))
    whole = placed.filter("whole").select("file", "document", "n", "head")
    edges = placed.filter("not whole").groupBy("file", "document").agg(F.sum("n").alias("n"), F.max(F.col("nth") < F.col("ends")).alias("closed"), F.array_sort(F.collect_list(F.struct("block", "head"))).alias("heads"))
    edges = edges.filter("closed or n > 0").select("file", "document", "n", F.slice(F.flatten("heads.head"), 1, header).alias("head") if header else F.array().cast("array<int>").alias("head"))
    every = whole.union(edges)
    return every.select("file", "document", F.greatest(F.col("n") - header, F.lit(0)).alias("n_tokens"), "head")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, file, document): the documents written to flat files and counted from the files alone."""
    spark: SparkSession = docs.sparkSession
    path = f"{shared_dir(spark)}/gradeloom/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    found = scan(files, header=HEADER)
    word = lambda i: F.get("head", F.lit(i)).cast("long")
    value = word(0)
    for i in range(1, HEADER):
        value = value.bitwiseOR(F.shiftleft(word(i), 15 * i))
    doc_id = F.when(word(4) < 1 << 10, value)
    return found.select(doc_id.alias("doc_id"), "n_tokens", F.element_at(F.split("file", "/"), -1).alias("file"), "document")
