"""Best-fit packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm on islands.

A chromosome is a list of bins, each a list of pieces. Crossover injects whole well-filled bins of one parent into the
other, removes bins that now hold a piece twice, and fits the displaced pieces in: first in place of smaller ones where that
fills a bin better (Falkenauer's replacement), then by best fit. Pieces are dealt to blocks of a few
thousand by hash; each block is evolved by several islands, between epochs the best packings migrate to the next island,
and the best packing of all islands stays. Bins that stay badly filled are opened and packed again with those of other blocks.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import in_parts, small_batches, stored

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


# ---- one block ----------------------------------------------------------------------------------------------------
def best_fit(lengths: list[int], order: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put each piece in the fullest bin that has room, else in a new one. bins: what is packed already; it is not changed."""
    bins, length = [list(b) for b in bins or []], lengths.__getitem__
    room = sorted((capacity - sum(map(length, b)), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at == len(room):
            k, left = len(bins), capacity
            bins.append([])
        else:
            left, k = room.pop(at)
        bins[k].append(i)
        bisect.insort(room, (left - lengths[i], k))
    return bins


def fitness(lengths: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the fuller ones (larger is better)."""
    length = lengths.__getitem__
    return -len(bins), sum((sum(map(length, b)) / capacity) ** 2 for b in bins)


def least_bins(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins (Martello and Toth's bound L2)."""
    number = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)
    count, total = (np.concatenate(([0], np.cumsum(x))) for x in (number, number * np.arange(capacity + 1)))  # of lengths below n
    half, small = capacity // 2 + 1, np.arange(capacity // 2 + 1)
    halves = count[capacity + 1] - count[half]  # no two of these share a bin
    large = capacity - small + 1  # nothing of length small or more fits beside these
    room = (count[large] - count[half]) * capacity - (total[large] - total[half])
    more = -(-(total[half] - total[small] - room) // capacity)
    return int((halves + np.maximum(0, more)).max())


def replace(lengths: list[int], bins: list[list[int]], pieces: list[int], capacity: int) -> list[int]:
    """Put pieces, the longest first, in place of one or two shorter ones of a bin where they fill it best.

    Changes bins and returns the pieces that have no place then. Each place taken leaves less room, so it ends.
    """
    room = [capacity - sum(lengths[i] for i in b) for b in bins]
    todo, without = sorted(pieces, key=lengths.__getitem__), []
    while todo:
        piece = todo.pop()
        n, best = lengths[piece], (capacity, 0, ())
        for k, b in enumerate(bins):
            if r := room[k]:
                for x, i in enumerate(b):
                    if 0 < (more := n - lengths[i]) <= r and r - more < best[0]:
                        best = (r - more, k, (i,))
                    for j in b[:x]:
                        if 0 < (more := n - lengths[i] - lengths[j]) <= r and r - more < best[0]:
                            best = (r - more, k, (i, j))
                if not best[0]:
                    break
        left, k, gone = best
        if gone:
            bins[k], room[k] = [*(i for i in bins[k] if i not in gone), piece], left
            for i in gone:
                bisect.insort(todo, i, key=lengths.__getitem__)
        else:
            without.append(piece)
    return without


def crossover(lengths: list[int], a: list[list[int]], b: list[list[int]], capacity: int, rng: random.Random, loose: int = 32, tried: int = 128) -> list[list[int]]:
    """Well-filled bins of b go into a whole; bins of a with a piece of theirs are opened and their other pieces fitted in.

    The least filled bins are opened too; the displaced pieces may take places in the loose least filled of the others."""
    length = lengths.__getitem__
    good = [x for x in b if sum(map(length, x)) >= 0.99 * capacity]
    injected = rng.sample(good, max(1, len(good) // 3)) if good else []
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append((-sum(map(length, x)), len(kept), x))
        else:
            displaced += [i for i in x if i not in taken]
    kept = [x for _, _, x in sorted(kept)]
    opened = max(1, len(kept) // 10) if kept else 0
    displaced += [i for x in kept[len(kept) - opened :] for i in x]
    kept = kept[: len(kept) - opened]
    first = max(0, len(kept) - loose)
    displaced.sort(key=lambda i: -lengths[i])
    last = [list(x) for x in kept[first:]]
    rest = displaced[tried:] + replace(lengths, last, displaced[:tried], capacity)  # the longest; the others are best-fitted
    return best_fit(lengths, sorted(rest, key=lambda i: -lengths[i]), capacity, kept[:first] + last + injected)


def evolve(lengths: list[int], capacity: int, immigrants: list[list[list[int]]], seed: int, population: int = 4, patience: int = 4, generations: int = 60) -> list[list[list[int]]]:
    """The two best packings after some generations (the one, if it can't be better).

    It ends when no packing can have fewer bins, or when so many generations in a row (patience) gave no better packing.
    """
    rng, least = random.Random(seed), least_bins(lengths, capacity)
    done = [x for x in immigrants if len(x) <= least]
    if done:
        return done[:1]
    falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [*immigrants] or [best_fit(lengths, falling, capacity)]  # what comes in is no worse
    if len(people[-1]) > least:
        while len(people) < population:  # falling order, with neighbours exchanged
            key = {i: -lengths[i] * rng.uniform(0.9, 1.1) for i in falling}
            people.append(best_fit(lengths, sorted(falling, key=key.get), capacity))
    ranked = sorted(((fitness(lengths, x, capacity), k, x) for k, x in enumerate(people)), reverse=True)
    idle = 0
    for k in range(generations):
        best = ranked[0][0]
        if -best[0] <= least or idle >= patience:
            break
        child = crossover(lengths, *rng.sample([x for _, _, x in ranked[:3]], 2), capacity, rng)
        ranked = sorted([*ranked[: population - 1], (fitness(lengths, child, capacity), len(people) + k, child)], reverse=True)
        idle = 0 if ranked[0][0] > best else idle + 1
    return [x for _, _, x in ranked[:2]]


# ---- blocks and islands -------------------------------------------------------------------------------------------
def _flat(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(flat) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        out[k].append(i)
    return out


def pack_blocks(items: DataFrame, capacity: int, islands: int = 2, epochs: int = 2) -> DataFrame:
    """items (block, pid, length) -> block, pid, bin, offset, fill. Blocks must be of bounded size."""
    spread = items.withColumn("island", F.explode(F.array(*map(F.lit, range(islands)))))
    schema = "block long, island int, elites array<array<int>>"

    def one(number: int, key: tuple, own: pd.DataFrame, guests) -> pd.DataFrame:
        lengths = own.sort_values("pid")["length"].tolist()
        immigrants = [_bins(list(x)) for e in guests for x in e]
        best = evolve(lengths, capacity, immigrants, hash((int(key[0]), int(key[1]), number)))
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "elites": [[_flat(x, len(lengths)) for x in best]]})

    def alone(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return one(0, key, own, ())

    def visited(number: int):
        def run(key: tuple, own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
            return one(number, key, own, came["elites"])

        return run

    elites = stored(spread.groupBy("block", "island").applyInPandas(alone, schema), "elites")
    for number in range(1, epochs):
        # the best of an island stay there and go to the next one as well
        moved = elites.withColumn("island", F.explode(F.array(F.col("island"), ((F.col("island") + 1) % islands).cast("int"))))
        elites = stored(spread.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInPandas(visited(number), schema), "elites")

    def best(key: tuple, own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pid")
        lengths = own["length"].tolist()
        packings = [_bins(list(x)) for e in came["elites"] for x in e]
        bins = max(packings, key=lambda x: fitness(lengths, x, capacity)) if packings else []
        out = pd.DataFrame({"block": key[0], "pid": own["pid"], "bin": -1, "offset": 0, "fill": 0})
        where, offset, fill = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                where[i], offset[i] = k, at
                at += lengths[i]
            fill[b] = at
        return out.assign(bin=where, offset=offset, fill=fill)

    return items.groupBy("block").cogroup(elites.groupBy("block")).applyInPandas(best, "block long, pid long, bin long, offset long, fill long")


# ---- documents ----------------------------------------------------------------------------------------------------
def cut_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, kind: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """What cut() makes of batches (doc_id, text); texts are taken out of them a few at a time."""
    encode = bpe.encoder(vocabulary, kind).encode
    end = int(end_id).to_bytes(4, "little")
    for part in in_parts(batches):
        rows = []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids = encode(text) + end
            n = len(ids) // 4
            a, piece = 0, 0
            b = n % capacity or min(n, capacity)
            while a < n:
                rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                a, b, piece = b, b + capacity, piece + 1
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)


def cut(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of all documents. Only documents of over capacity ids are cut; the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_batches(batches, vocabulary, kind, end_id, capacity)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024, block_size: int = 4096, open_below: float = 0.98) -> DataFrame:
    """Pack all documents into sequences of at most capacity ids.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts have
    end_id alone; documents with a null or a repeated doc_id are documents like others; an empty table gives no rows;
    further columns of docs are ignored. Pieces of full length are a sequence each, without shuffle.
    """
    with small_batches(docs.sparkSession):  # beside the encoders' caches
        pieces = stored(cut(docs, vocabulary, kind, end_id, capacity).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("pid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < capacity).select("pid", "length")

    def dealt(items: DataFrame, n: int) -> DataFrame:
        return items.withColumn("block", F.pmod(F.xxhash64("pid"), F.lit(max(1, -(-n // block_size)))))

    first = stored(pack_blocks(dealt(short, short.count()), capacity), "packed")
    poor = first.filter(F.col("fill") < open_below * capacity).join(short, "pid").select("pid", "length")
    second = pack_blocks(dealt(poor, poor.count()), capacity)
    number = lambda kind: ((F.col("block") * (1 << 24) + F.col("bin")) * 4 + kind).alias("sequence_id")
    where = first.filter(F.col("fill") >= open_below * capacity).select("pid", number(1), "offset").unionAll(second.select("pid", number(2), "offset"))
    packed = pieces.filter(F.col("length") < capacity).join(where, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return full.unionAll(packed)
