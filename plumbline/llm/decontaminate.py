"""Benchmark decontamination: test items whose word shingles a document contains.

Items are partitioned by size. The sketch of an item is its least shingles under a hash order (bottom-k MinHash), with k
set by the size partition so that a document holding at least the threshold share of the item's shingles must hold one of
the sketch: at most (1 - threshold) * size shingles can be missing, and k is larger than that. So the search has no false
negatives however long the document is, documents too short for a partition skip it, and each candidate is then verified
by exact containment of the shingles themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, where_text

#: ASCII punctuation and controls separate words.
APART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(APART).split()


class Index:
    """The size partitions of some items, small enough for each task. items: (item_id, text) or (item_id, text, copies)."""

    def __init__(self, items: list[tuple], words: int = 5, threshold: float = 0.8):
        self.words, self.threshold = words, threshold
        self.vocabulary: dict[bytes, int] = {}
        classes: dict[frozenset, list[tuple]] = defaultdict(list)
        short: dict[tuple, list[tuple]] = defaultdict(list)  # items of fewer words: one shingle of their own length
        for item_id, text, *copies in items:
            item = (item_id, *(copies or [1]))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if len(ids) >= words:
                classes[frozenset(zip(*(ids[k:] for k in range(words)), strict=False))].append(item)
            elif ids:
                short[tuple(ids)].append(item)
        one = lambda own: (min((i for i, _ in own if i is not None), default=None), sum(n for _, n in own))
        self.short = {shingle: one(own) for shingle, own in short.items()}
        self.items = [(*one(own), shingles) for shingles, own in classes.items()]
        sketch: dict[int, list[int]] = defaultdict(list)
        self.partition = []
        for place, (_, _, shingles) in enumerate(self.items):
            upper = 1 << (len(shingles) - 1).bit_length()  # sizes in (upper / 2, upper]
            self.partition.append(upper)
            k = min(len(shingles), math.floor((1 - threshold) * upper + 1e-9) + 1)
            for h in sorted(self.hashes(np.array(sorted(shingles), dtype=np.uint64)).tolist())[:k]:
                sketch[h].append(place)
        self.sketch = dict(sketch)
        self.table = np.array(sorted(sketch), dtype=np.uint64)
        self.most_short = max((len(x) for x in self.short), default=0)

    def hashes(self, shingles: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (shingles * np.resize(MIX, self.words)[None]).sum(axis=1, dtype=np.uint64)
            h ^= h >> np.uint64(29)
            return h * MIX[0]

    def search(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item_id, containment, shingles found, shingles of the item, items with these shingles); item_id is the smallest of those."""
        parts = words_of(text)
        if not parts:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in parts), np.int64, len(parts))
        out = []
        if self.short:
            known, row = set(), ids.tolist()
            for n in {len(x) for x in self.short}:
                known.update(x for x in zip(*(row[k:] for k in range(n)), strict=False) if x in self.short)
            out += [(item_id, 1.0, 1, 1, copies) for item_id, copies in map(self.short.get, known)]
        n = len(ids) - self.words + 1
        if n < 1 or not len(self.table):
            return out
        inside = ids > 0
        whole = np.logical_and.reduce([inside[k : k + n] for k in range(self.words)])
        at = np.flatnonzero(whole)
        if not len(at):
            return out
        shingles = ids[at[:, None] + np.arange(self.words)].astype(np.uint64)
        hashes = self.hashes(shingles)
        place = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        hit = np.unique(self.table[place[self.table[place] == hashes]])
        if not len(hit):
            return out
        held = set(map(tuple, shingles.tolist()))
        for place in {p for h in hit.tolist() for p in self.sketch[h]}:
            item_id, copies, wanted = self.items[place]
            if len(held) < self.threshold * len(wanted) - 1e-9:
                continue
            found = len(wanted & held)
            if found >= self.threshold * len(wanted) - 1e-9:
                out.append((item_id, found / len(wanted), found, len(wanted), copies))
        return out


def classes(benchmark: DataFrame, words: int) -> DataFrame:
    """item_id, text, copies: one row for all items (item_id, text) with the same shingles; item_id is the smallest, null if all are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = []
            for text in batch["text"]:
                parts = words_of(text)
                shingles = {b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()
                keys.append(hashlib.blake2b(b"\n".join(sorted(shingles)), digest_size=16).digest())
            yield batch.assign(key=keys)

    items = benchmark.select(F.col("item_id").cast("long").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    keyed = items.mapInPandas(run, "item_id string, text string, key binary").withColumn("item_id", F.col("item_id").cast("long"))
    return keyed.groupBy("key").agg(F.min("item_id").alias("item_id"), F.min("text").alias("text"), F.count("*").alias("copies")).select("key", "item_id", "text", "copies")


def indexes(benchmark: DataFrame, words: int, threshold: float, block_bytes: int) -> list:
    """Broadcasts of an Index each, for blocks of about block_bytes of text; items with the same shingles are in one block."""
    items = stored(classes(benchmark, words), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = []
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("item_id", "text", "copies")  # about block_bytes
        out.append(benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], words, threshold)))
    return out


def contained_items(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, containment, found, shingles, copies: the items of benchmark (item_id, text) that docs (doc_id, text) contain.

    Items with the same shingles are one class, named by its smallest item_id (null if all are null); copies is their
    number. An item of fewer words is one shingle of its own length; items and documents without words (null, empty) match
    nothing; rows that repeat a doc_id each give their rows; other columns are ignored. The items are shipped to all tasks
    in blocks of about block_bytes of text, one pass over docs each, so that the index a task holds is bounded whatever the
    benchmark's size.
    """
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id string, item_id string, containment double, found long, shingles long, copies long"
    out = None
    for index in indexes(benchmark, words, threshold, block_bytes):

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            search = index.value.search
            for batch in batches:
                rows = [(d, None if x[0] is None else str(x[0]), *x[1:]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for x in search(t if isinstance(t, str) else None)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "containment", "found", "shingles", "copies"])

        one = texts.mapInPandas(run, schema)
        out = one if out is None else out.unionAll(one)
    return out.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """docs without the rows whose text contains a benchmark item, whatever the item's id.

    Each row is judged by its own text, whatever its doc_id (null and repeated ones too), in one pass without a shuffle;
    all columns stay as they are; null and empty texts stay; an empty table on either side drops nothing.
    """
    for index in indexes(benchmark, words, threshold, block_bytes):

        def judge(index=index):
            search = index.value.search
            return lambda text: not search(text)

        docs = where_text(docs, judge)
    return docs
