"""SimHash near-duplicates: fingerprints of word shingles, linked exactly within a Hamming radius.

Links are found by comparing tiles of fingerprints with numpy exclusive-or and bit counts; tile pairs whose population
counts differ by more than the radius can't hold a link and are skipped. Which fingerprints can meet in a tile is narrowed
without loss: cut into radius + 3 pieces, two fingerprints within the radius agree in three pieces at least. So each goes to
a table for each choice of three pieces (20 tables of 32 bits or so at radius 3), and meets those that agree there: some
twenty in 10^11 fingerprints, where a single piece would bring together a share of all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import all_but_first, components
from .shared import rows_told_apart, stored, without_rows


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> list[int]:
    """XXH64 of the text's word shingles, repeats included. A-Z are lower-cased; fewer words make one shingle, none make none."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not parts:
        return []
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for a text without words."""
    return simhash_of(np.array(shingle_hashes(text, words, seed), dtype="<u8"))


def simhash_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as signed 64-bit number) for each row of docs (doc_id, text), and others, columns of long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([simhash(t if isinstance(t, str) else None, words, seed) for t in batch["text"]], dtype=np.uint64)
            yield batch.drop(columns="text").assign(fp=fps.view(np.int64))

    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *others, F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, ", ".join(["doc_id string", *(f"{c} long" for c in others), "fp long"])).withColumn("doc_id", F.col("doc_id").cast("long"))


# ---- tiles --------------------------------------------------------------------------------------------------------
def tile_links(a: np.ndarray, b: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of a and b (uint64, both sorted by population count) at most radius bits apart."""
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    pa, pb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    for s in range(0, len(a), tile):
        e = min(len(a), s + tile)
        # population counts are sorted, so the tiles of b within reach are one stretch
        lo, hi = np.searchsorted(pb, pa[s] - radius, "left"), np.searchsorted(pb, pa[e - 1] + radius, "right")
        for t in range(lo, hi, tile):
            u = min(hi, t + tile)
            i, j = np.nonzero(np.bitwise_count(a[s:e, None] ^ b[None, t:u]) <= radius)
            out_i.append(i + s)
            out_j.append(j + t)
    return np.concatenate(out_i), np.concatenate(out_j)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.right = 0

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def meet(left: np.ndarray, right: np.ndarray, radius: int, union: _Union, told) -> None:
    """told(i, j) for each pair of places (of fingerprints sorted by population count) that joins what wasn't connected."""
    for s in range(0, len(left), 512):
        i, j = tile_links(left[s : s + 512], right, radius)
        for x, y in zip((i + s).tolist(), j.tolist(), strict=True):
            if union.join(x, y + union.right):
                told(x, y)


def inside_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, first fingerprint of its component) for what is linked within a block sorted by population count."""
    union = _Union(len(fps))
    meet(fps, fps, radius, union, lambda x, y: None)
    root = np.array([union.root(k) for k in range(len(fps))])
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def cross_links(left: np.ndarray, left_roots: np.ndarray, right: np.ndarray, right_roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks sorted by population count that connect what isn't connected inside them.

    What is connected inside comes as roots, so no pair inside a block is compared again, and a dense group cut into many
    blocks gives few links for each pair.
    """
    union = _Union(len(left) + len(right))
    for at, roots in ((0, left_roots), (len(left), right_roots)):
        _, first, own = np.unique(roots, return_index=True, return_inverse=True)
        for k, f in enumerate(first[own].tolist()):
            union.join(at + k, at + f)
    union.right = len(left)
    out: list[tuple[int, int]] = []
    meet(left, right, radius, union, lambda x, y: out.append((x, y)))
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return left[i], right[j]


def small_links(unit: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within units, for many small units at once: rows sorted by unit and population count meet at growing distance."""
    count, out = np.bitwise_count(fps).astype(np.int64), []
    at = np.arange(len(fps))
    step = 1
    while True:
        at = at[at + step < len(fps)]
        at = at[(unit[at] == unit[at + step]) & (count[at + step] - count[at] <= radius)]  # sorted: beyond the radius, all later ones are too
        if not len(at):
            break
        out.append((hit := at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius], hit + step))
        step += 1
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (np.zeros(0, np.int64),) * 2


#: Units up to this size are compared many at a time.
SMALL = 16


def tables(radius: int, bits: int = 64) -> list[int]:
    """Masks of three of radius + 3 pieces; two numbers at most radius bits apart agree under one of them."""
    pieces = radius + 3
    cuts = [k * bits // pieces for k in range(pieces + 1)]
    whole = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(three) for three in itertools.combinations(whole, 3)]


def whole_units(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by keys, in frames that hold all rows of each key they have."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        told = rest[keys].to_numpy()
        before = np.flatnonzero((told != told[-1]).any(axis=1)) if len(told) else []
        if len(before):
            cut = before[-1] + 1
            yield rest.iloc[:cut].reset_index(drop=True)
            rest = rest.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def unit_numbers(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    told = rows[keys].to_numpy()
    return np.concatenate(([0], np.cumsum((told[1:] != told[:-1]).any(axis=1))))


def links(distinct: DataFrame, radius: int = 3, block: int = 4096) -> DataFrame:
    """distinct (fp) -> a, b: links that connect what is connected by pairs at most radius bits apart (not all pairs).

    Groups of more than block fingerprints that agree under a mask are dealt to blocks. Each block is compared within itself
    once, then each pair of blocks across, so no task holds more than two blocks.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for k, m in enumerate(tables(radius))))
    rows = distinct.select("fp", F.explode(masks).alias("g")).select("fp", "g.mask", "g.bits")
    sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    rows = rows.join(sizes, ["mask", "bits"]).select("mask", "bits", blocks.alias("blocks"), F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int").alias("own"), "fp")
    rows = stored(rows, "fingerprint-groups")
    key = ["mask", "bits", "own"]

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit_rows in whole_units(batches, key):
            unit, fps = unit_numbers(unit_rows, key), unit_rows["fp"].to_numpy().view(np.uint64)
            small = (np.bincount(unit) <= SMALL)[unit] & (unit_rows["blocks"] == 1).to_numpy()
            i, j = small_links(unit[small], fps[small], radius)
            at = np.flatnonzero(small)
            yield pd.DataFrame({"a": fps[small][i].view(np.int64), "b": fps[small][j].view(np.int64), **{k: unit_rows[k].to_numpy()[at[i]] for k in key}})
            for u in np.unique(unit[~small]):
                lo, hi = np.searchsorted(unit, [u, u + 1])
                a, b = inside_links(fps[lo:hi], radius)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), **{k: unit_rows[k].iloc[lo] for k in key}})

    units = rows.repartition(*key).sortWithinPartitions(*key, F.bit_count("fp")).select(*key, "blocks", "fp")
    within = stored(units.mapInPandas(inside, "a long, b long, mask int, bits long, own int"), "links")
    once = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]  # a pair may be met under several masks
    hot = rows.filter("blocks > 1")
    if not hot.limit(1).count():
        return within.select(*once).distinct()

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit_rows in whole_units(batches, ["mask", "bits", "i", "j"]):
            for _, own in unit_rows.groupby(["mask", "bits", "i", "j"], sort=False):
                fps, root, side = own["fp"].to_numpy().view(np.uint64), own["root"].to_numpy(), (own["own"] == own["j"]).to_numpy()
                a, b = cross_links(fps[~side], root[~side], fps[side], root[side], radius)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    rooted = hot.join(within.withColumnRenamed("a", "fp"), [*key, "fp"], "left").withColumn("root", F.coalesce("b", "fp"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))
    pairs = F.transform(others, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    units = rooted.select("mask", "bits", "own", "fp", "root", F.explode(pairs).alias("p")).select("mask", "bits", "p.i", "p.j", "own", "fp", "root")
    units = units.repartition("mask", "bits", "i", "j").sortWithinPartitions("mask", "bits", "i", "j", F.bit_count("fp"))
    return within.select("a", "b").unionAll(units.mapInPandas(across, "a long, b long")).select(*once).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach) for each row of docs (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id each get a row; a null
    doc_id is never a component_id unless its component holds no other. Other columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, words, seed), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(nodes.select("fp"), radius))
    rooted = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id")
    out = prints.join(known, "fp")  # a hot fingerprint is split by adaptive execution's skew join
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component stays, the one with the smallest doc_id (null last; of several the first by place).

    Rows are told apart by their place, so null and repeated doc_ids are judged like any other. Other columns stay as they
    are; an empty table stays empty.
    """
    told, *name = rows_told_apart(docs)
    rows = stored(fingerprints(told, words, others=tuple(name)).withColumnRenamed("fp", "node"), "fingerprints")
    edges = links(rows.select(F.col("node").alias("fp")).distinct(), radius)
    return without_rows(told, all_but_first(rows, edges, *name), *name).select(docs.columns)
