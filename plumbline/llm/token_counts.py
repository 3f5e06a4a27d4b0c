"""Token-count rollups that are maintained by signed deltas, in DataFrame functions.

A batch of inserts, deletes and revisions is summed up by source, language and tokenizer version and committed once under
its id: the summed delta is written beside the store and renamed into it. A batch that is sent again changes nothing.
Totals are the sum of all deltas; compaction replaces deltas by one snapshot of their sum.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def with_counts(docs: DataFrame, tokenizers: Mapping[str, tuple[str, str]]) -> DataFrame:
    """doc_id, source, lang of docs (doc_id, text, source, lang) and a column of tokens by each tokenizer.

    tokenizers: column -> (vocabulary file, kind as in bpe). Counts are of whole texts, without special tokens; a null or
    empty text has none. Every row gives a row; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoders = {name: bpe.encoder(*which) for name, which in tokenizers.items()}
        for batch in batches:
            for name, e in encoders.items():
                batch[name] = [len(e.encode(t if isinstance(t, str) else None)) // 4 for t in batch["text"]]
            yield batch.drop(columns="text")

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    out = rows.mapInPandas(run, ", ".join(["doc_id string, source string, lang string", *(f"`{name}` long" for name in tokenizers)]))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/deltas/{batch}")
        return fs.exists(p)

    def batches(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/deltas")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: source, lang, tokenizer, op (insert, delete or revise), tokens, old_tokens (revise only).

        Returns whether the batch was new. Null keys are a group of their own; null counts are 0; null or unknown ops fail.
        """
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
        new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("tokens", "old_tokens"))
        rows = changes.select(*(F.col(k).cast("string").alias(k) for k in KEYS), sign.cast("long").alias("docs"), F.when(F.col("op") == "revise", new - old).otherwise(new * sign).alias("tokens"))
        delta = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        delta.write.parquet(aside)
        fs, target = self._fs(f"{self.path}/deltas/{batch}")
        fs.mkdirs(target.getParent())
        source = self._fs(aside)[1]
        if fs.exists(target) or not fs.rename(source, target):  # another driver was first
            fs.delete(source, True)
            return False
        nested = self._fs(f"{self.path}/deltas/{batch}/aside-{aside.rpartition('aside-')[2]}")[1]
        if fs.exists(nested):  # some stores move into a folder that appeared meanwhile
            fs.delete(nested, True)
            return False
        return True

    def _snapshot(self) -> str | None:
        """The newest one. A snapshot is renamed into its place whole and never changed."""
        fs, p = self._fs(f"{self.path}/snapshots")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return f"{self.path}/snapshots/{names[-1]}" if names else None

    def _summed(self, batches: list[str], snapshot: str | None) -> DataFrame:
        """Totals of these batches exactly, with the help of a snapshot of some of them."""
        paths = [f"{self.path}/deltas/{b}" for b in batches]
        if snapshot:
            done = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{snapshot}/batches").collect()}  # a name for each commit since
            paths = [f"{self.path}/deltas/{b}" for b in batches if b not in done] + [f"{snapshot}/totals"]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; groups that all deltas cancel are left out."""
        snapshot = self._snapshot()  # before the batches: what it has is among them
        return self._summed(self.batches(), snapshot)

    def compact(self) -> None:
        """Sum up the deltas committed so far. Their folders stay as the record of batch ids.

        The batches are listed once, and exactly these are summed up and noted: one that is committed meanwhile is left to
        readers. The snapshot before this one stays for those who read it; older ones go.
        """
        before = self._snapshot()
        aside, done = f"{self.path}/aside-{uuid.uuid4().hex}", self.batches()
        self._summed(done, before).write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(b,) for b in done], "batch string").coalesce(1).write.parquet(f"{aside}/batches")
        fs, target = self._fs(f"{self.path}/snapshots/{len(done):012d}-{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        fs.rename(self._fs(aside)[1], target)
        for old in sorted(x.getPath().toString() for x in fs.listStatus(target.getParent()))[:-2]:
            fs.delete(self._fs(old)[1], True)
