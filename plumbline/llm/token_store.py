"""Token-id files: ids of all documents end to end, document boundaries and doc_ids as Elias-Fano sequences.

A file ("shard") holds consecutive documents in doc_id order:

    magic 8 bytes | width u32, n_docs u64, n_null u64, n_ids u64, first doc_id i64 | boundaries | doc_ids | ids

boundaries are the n_docs + 1 offsets into the ids; doc_ids are stored less the first one (rows with a null doc_id come
first and are counted by n_null). An Elias-Fano sequence of n values up to u takes n * (2 + log2(u / n)) bits: the low
bits of each value packed, the high bits in unary, and the place of every 256th one-bit as 32-bit number, so that
select(i) reads a short stretch of the unary part. Nothing holds a 64-bit entry for each document.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import stored

MAGIC = b"EFTOKEN1"
HEAD = struct.Struct("<IQQQq")
EF_HEAD = struct.Struct("<QQBIII")
EVERY = 256
#: Values that are unpacked at a time.
BLOCK = 1 << 13


def ef_encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of non-negative integers."""
    values = np.asarray(values, dtype=np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = np.zeros((n * low + 7) // 8, np.uint8)
    for a in range(0, n if low else 0, BLOCK):  # BLOCK values make whole bytes
        bits = (values[a : a + BLOCK, None] >> np.arange(low, dtype=np.uint64)).astype(np.uint8) & 1
        packed = np.packbits(bits.ravel(), bitorder="little")
        lows[a * low // 8 :][: len(packed)] = packed
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
    bits[places] = 1
    highs, samples = np.packbits(bits, bitorder="little"), places[::EVERY].astype("<u4")
    return EF_HEAD.pack(n, top, low, len(lows), len(highs), len(samples)) + lows.tobytes() + highs.tobytes() + samples.tobytes()


class EliasFano:
    def __init__(self, data: memoryview):
        self.n, self.top, self.low, n_low, n_high, n_sample = EF_HEAD.unpack_from(data)
        at = EF_HEAD.size
        self.lows = np.frombuffer(data, np.uint8, n_low, at)
        self.highs = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(data, "<u4", n_sample, at + n_low + n_high)
        self.size = at + n_low + n_high + 4 * n_sample

    def _low(self, i: int) -> int:
        bit = i * self.low
        word = int.from_bytes(self.lows[bit >> 3 : (bit + self.low + 7 >> 3)].tobytes(), "little")
        return word >> (bit & 7) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // EVERY]), i % EVERY
        while left:  # bytes after the sampled one-bit
            at = place + 1
            ones = np.flatnonzero(np.unpackbits(self.highs[at >> 3 : (at >> 3) + 64], bitorder="little")[at & 7 :])
            step = min(left, len(ones))
            place, left = (at + int(ones[step - 1]), left - step) if step else (((at >> 3) + 64) * 8 - 1, left)
        return (place - i) << self.low | (self._low(i) if self.low else 0)

    def selected(self, a: int, b: int) -> np.ndarray:
        """The values from the a-th up to before the b-th: the place of the a-th is selected, the others follow it."""
        if a >= b:
            return np.zeros(0, np.int64)
        first = (self.select(a) >> self.low) + a
        last = (self.select(b - 1) >> self.low) + b - 1
        places = np.flatnonzero(np.unpackbits(self.highs[first >> 3 : (last >> 3) + 1], bitorder="little")[first & 7 :])[: b - a] + first
        values = (places - np.arange(a, b)) << self.low
        if self.low:
            start, end = a * self.low, b * self.low
            bits = np.unpackbits(self.lows[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].reshape(b - a, self.low)
            values = values + bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return values.astype(np.int64)


def shard_head(doc_ids: list, ends: list[int], width: int) -> bytes:
    """All of a shard before its ids."""
    n_null = sum(x is None for x in doc_ids)
    known = np.asarray([x for x in doc_ids if x is not None], dtype=object)
    first = int(known[0]) if len(known) else 0
    return MAGIC + HEAD.pack(width, len(doc_ids), n_null, ends[-1], first) + ef_encode(np.array(ends)) + ef_encode(np.array([int(x) - first for x in known], dtype=np.uint64))


class Shard:
    """A shard in memory; ids(i) and bounds(i) touch one document only."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token-id file")
        self.width, self.n_docs, self.n_null, self.n_ids, self.first = HEAD.unpack_from(view, 8)
        at = 8 + HEAD.size
        self.ends = EliasFano(view[at:])
        self.docs = EliasFano(view[at + self.ends.size :])
        self.array = np.frombuffer(view, f"<u{self.width}", self.n_ids, at + self.ends.size + self.docs.size)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i), self.ends.select(i + 1)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.array[a:b]

    def doc_ids(self, a: int, b: int) -> list:
        """Of the documents from the a-th up to before the b-th."""
        known = self.docs.selected(max(0, a - self.n_null), max(0, b - self.n_null))
        return [None] * (b - a - len(known)) + [int(x) + self.first for x in known]


def write_store(docs: DataFrame, folder: str, vocabulary: str, kind: str = "word", end_id: int = 2, width: int = 2, shard_ids: int = 1 << 25, shard_docs: int = 1 << 20) -> DataFrame:
    """Write the ids of docs (doc_id, text) to token-id files in folder, in ascending doc_id order.

    Returns the manifest: file, part, number, n_docs, n_ids, base (ids in all files before). Null texts count as empty;
    a document with no ids still gets end_id; rows with a null doc_id come first; rows that repeat a doc_id stay side by
    side; other columns are ignored; an empty table makes an empty manifest. A task writes a file under a name of its own
    attempt and renames it, so a task that runs twice leaves one whole file. width: bytes of an id, 2 or 4.
    A file ends after shard_ids ids or shard_docs documents, which bounds what a task holds.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = bpe.encoder(vocabulary, kind, width).encode
        end = int(end_id).to_bytes(width, "little")
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        state = {"docs": [], "ends": [0], "ids": [], "number": 0}

        def flush() -> pd.DataFrame:
            name = f"part-{part:06d}-{state['number']:05d}.eftk"
            with fs.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                out.write(shard_head(state["docs"], state["ends"], width))
                for block in state["ids"]:
                    out.write(block)
            fs.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            row = pd.DataFrame({"file": [name], "part": [part], "number": [state["number"]], "n_docs": [len(state["docs"])], "n_ids": [state["ends"][-1]]})
            state.update(docs=[], ends=[0], ids=[], number=state["number"] + 1)
            return row

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text if isinstance(text, str) else None) + end
                state["docs"].append(None if pd.isna(doc_id) else int(doc_id))
                state["ends"].append(state["ends"][-1] + len(ids) // width)
                state["ids"].append(ids)
                if state["ends"][-1] >= shard_ids or len(state["docs"]) >= shard_docs:
                    yield flush()
        if state["docs"]:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # doc_id as text: a pandas column with nulls would turn 64-bit numbers into floats
    rows = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(write, "file string, part int, number int, n_docs long, n_ids long")
    manifest = stored(rows, "token-manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not document
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_store(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone (base: from the manifest).

    Boundaries and doc_ids come by select, a block of documents at a time; no table of all offsets is made.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch["file"], batch["base"], strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                for a in range(0, shard.n_docs, BLOCK):
                    b = min(shard.n_docs, a + BLOCK)
                    ends = shard.ends.selected(a, b + 1)
                    crc = [zlib.crc32(shard.array[i:j].astype("<u4").tobytes()) for i, j in itertools.pairwise(ends.tolist())]
                    yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids(a, b), dtype="Int64"), "start": ends[:-1] + base, "n_tokens": np.diff(ends), "ids_crc32": crc})

    files = manifest.count()
    return manifest.select("file", "base").repartition(max(1, files)).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

