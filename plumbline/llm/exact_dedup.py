"""Exact deduplication over an extendible-hash index on shared files, in DataFrame functions only.

Texts are equal when they are identical without white space. Each text has a 64-bit key. The directory of the index has
2^depth slots, one for each prefix of depth bits; a bucket that holds more keys than its capacity is split by one more bit
and the directory doubles when no spare bit is left. Owner tasks hold contiguous slot ranges and write their buckets to the
shared folder. A row finds its entry by its slot, the slot's bucket and its key there. A key that several rows share is a
chain: only the texts of such rows are read again and moved; they are compared byte by byte with the best row of the chain,
what differs starts the next link, and so on until no row is left, so that a collision of keys never merges two texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, new_path, rows_told_apart, stored, without_rows

#: The directory starts with slots enough for full buckets and doubles at most so often; keys that still agree in all of a
#: slot's bits lengthen their bucket's chain, which only a key that isn't mixed well can bring about.
MOST_DOUBLINGS = 16
#: Bits of the filter that says which texts may share a key: 16 for each shared key, 32 MB to each task at most. Where there
#: are more keys than that, more texts than need be are moved and joined; the result is the same.
MOST_FILTER_BITS = 1 << 28
#: The white space that doesn't count, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """keys (h, one row each) -> slots (slot, bucket, local_depth), stored, and the directory's depth.

    A bucket's number is its first slot at full depth. Keys are counted by prefix, summed up before the shuffle; only the
    keys of overfull buckets are counted again when the directory doubles. Nothing but the depth reaches the driver.
    """
    start = max(0, -(-keys.count() // capacity) - 1).bit_length()
    depth, left, done = start, keys, None
    while True:
        counted = stored(left.groupBy(prefix(F.col("h"), depth).alias("p")).agg(F.count("*").alias("n")), "buckets")
        last = depth in (64, start + MOST_DOUBLINGS)
        fit = (counted if last else counted.filter(F.col("n") <= capacity)).select("p", F.lit(depth).alias("local_depth"))
        done = fit if done is None else done.unionAll(fit)
        full = counted.filter(F.col("n") > capacity).select(F.col("p").alias("full"))
        if last or not full.limit(1).count():
            break
        left = left.join(full, prefix(F.col("h"), depth) == F.col("full"), "left_semi")
        depth += 1  # the directory doubles
    slots = done.withColumn("bucket", F.expr(f"shiftleft(p, {depth} - local_depth)")).withColumn("slot", F.explode(F.expr(f"sequence(bucket, bucket + shiftleft(1L, {depth} - local_depth) - 1)")))
    return stored(slots.select("slot", "bucket", "local_depth"), "directory"), depth


@dataclass
class HashIndex:
    """slots: the directory. entries: h, bucket and what is known of each key, written in owner order."""

    path: str
    depth: int
    slots: DataFrame
    entries: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> HashIndex:
        depth = spark.read.parquet(f"{path}/depth").first()["depth"]
        return HashIndex(path, depth, spark.read.parquet(f"{path}/directory"), spark.read.parquet(f"{path}/buckets"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (h, ...) with the bucket that their slot points to. A directory of few slots goes to every task."""
        if not self.depth:
            return rows.withColumn("bucket", F.lit(0).cast("long"))
        slots = self.slots.select(F.col("slot").alias("own_slot"), "bucket")
        small = (1 << self.depth) <= BROADCAST_ROWS
        return rows.join(F.broadcast(slots) if small else slots, prefix(F.col("h"), self.depth) == F.col("own_slot")).drop("own_slot")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows (h, ...) with their entries; a hot key's rows are split by adaptive execution."""
        return self.placed(rows).join(self.entries, ["bucket", "h"])


def build_index(keys: DataFrame, capacity: int = 4096) -> HashIndex:
    """keys (h, ...), one row for each h -> the index in the shared folder."""
    spark = keys.sparkSession
    slots, depth = directory(keys.select("h"), capacity)
    path = new_path(spark, "hash-index")
    slots.write.parquet(f"{path}/directory")
    spark.range(1).select(F.lit(depth).alias("depth")).write.parquet(f"{path}/depth")
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = HashIndex(path, depth, slots, keys).placed(keys)
    routed.repartitionByRange(owners, "bucket", "h").sortWithinPartitions("bucket", "h").write.parquet(f"{path}/buckets")
    return HashIndex.load(spark, path)


def may_share(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows whose h is in shared (h), and a few others, without a shuffle of rows: a bitmap by h goes to every task."""
    wanted = 16 * shared.count()
    bits = min(MOST_FILTER_BITS, max(1 << 15, 1 << wanted.bit_length()))
    at = F.pmod(F.col("h"), F.lit(bits))
    block, bit = F.shiftright(at, 15), at.bitwiseAND(F.lit((1 << 15) - 1))
    bitmap = shared.groupBy(block.alias("own_block")).agg(F.bitmap_construct_agg(bit).alias("own_bits"))  # 4 kB for each 2^15 bits
    byte = F.conv(F.hex(F.substring(F.col("own_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(bitmap), block == F.col("own_block")).filter(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("own_block", "own_bits")


def judged(rows: DataFrame, capacity: int, key) -> DataFrame:
    """rows (doc_id, text, ...) -> doc_id, the other columns, keep_id, group_size, kept, text_sha256."""
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    raw = F.coalesce("text", F.lit(""))
    # the order in which rows stay, as a number that a hash aggregate can keep: code points, then small doc_id, then a
    # hash of the text as it stands
    wide = lambda c: c.cast("decimal(38,0)")
    power = lambda k: wide(F.lit(str(1 << k)))
    order = wide(wide(F.length(raw)) * power(95) + wide(wide(F.lit((1 << 63) - 1)) - wide(F.coalesce("doc_id", F.lit((1 << 63) - 1)))) * power(31) + wide(F.pmod(F.xxhash64(raw), F.lit(1 << 31))))
    keyed = rows.withColumn("order", order).withColumn("norm", normal(F.col("text"))).withColumn("h", key(F.col("norm")))
    light = stored(keyed.select("doc_id", "order", "h", F.unhex(F.sha2("norm", 256)).alias("digest"), F.monotonically_increasing_id().alias("row"), *others), "keys")

    summed = [F.count("*").alias("group_size"), F.max_by("doc_id", "order").alias("keep_id"), F.max_by("row", "order").alias("keep_row"), F.max("order").alias("best")]
    index = build_index(stored(light.groupBy("h").agg(*summed), "key-groups"), capacity)
    answer = index.lookup(light)

    # chains: only rows whose key is shared carry their bytes on. The joins with one row for each key are split by
    # adaptive execution where a key is hot; no step gathers a key's rows in one task
    shared = index.entries.filter("group_size > 1").select("h", "best")
    chain = stored(may_share(keyed.select("h", "norm", "order"), shared).join(shared, "h"), "chain")
    # heads are stored, as a join with an aggregate isn't split where a key is hot
    heads = stored(chain.filter(F.col("order") == F.col("best")).groupBy("h").agg(F.max("norm").alias("first")), "heads")
    moved = None
    while True:
        # rows equal to the first row of this link leave the chain; the best of the others heads the next link
        chain = stored(chain.join(heads, "h").filter("norm <> first").select("h", "norm", "order"), "chain")
        if not chain.limit(1).count():
            break
        heads = stored(chain.groupBy("h").agg(F.max(F.struct("order", "norm")).alias("b")).select("h", F.col("b.norm").alias("first")), "heads")
        apart = heads.select("h", F.unhex(F.sha2("first", 256)).alias("digest"))
        moved = apart if moved is None else moved.unionAll(apart)
    columns = ["doc_id", *others, "keep_id", "group_size", "row", "keep_row", "digest"]
    if moved is not None:  # keys with several texts: their rows are summed up by text
        several = stored(moved.select("h").distinct(), "collisions")
        mixed = light.join(several, "h")
        own = stored(mixed.groupBy("h", "digest").agg(*summed), "collided")
        answer = answer.join(several, "h", "left_anti").select(columns).unionAll(mixed.join(own, ["h", "digest"]).select(columns))
    kept = F.col("row") == F.col("keep_row")
    return answer.select("doc_id", *others, "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, capacity: int = 4096, key=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    Of equal texts the one with the most code points stays, then the smallest doc_id (null after all numbers). A null text
    counts as empty; all empty texts are one group. Every row counts and gives a row, also those with a null or a repeated
    doc_id; in each group exactly one row is kept, of rows that agree in doc_id and code points one by a hash of its text.
    Other columns are ignored; an empty table gives no rows. key: Column -> long; a weak one only makes longer chains.
    """
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), capacity, key)


def drop_copies(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep: of each group of equal texts one row stays, with all its columns.

    Rows are told apart by their place, not by doc_id, so null and repeated doc_ids lose nothing but copies.
    """
    told, *name = rows_told_apart(docs)
    found = judged(told.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *name), capacity, F.xxhash64)
    gone = stored(found.filter("not kept").select(*name), "copies")
    return without_rows(told, gone, *name).select(docs.columns)
