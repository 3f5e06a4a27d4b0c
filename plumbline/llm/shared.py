"""The folder that the driver and all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

#: Rows of two numbers that may go to every task (some 60 bytes each there); more are joined by shuffle.
BROADCAST_ROWS = 1 << 18
#: Rows that a Python worker gets and holds at a time under small_batches().
BATCH_ROWS = 1000
#: The paths that scratch() will remove.
_made: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset (tests in local mode) a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is stored inside is removed at the end, but for paths taken off the list: only for work whose result is written by then."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.pop()
        for path in made:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later steps survive lost executors without running df again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_told_apart(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns of long that name each row, and the columns' names: its file and its place there.

    doc_ids may be null or repeat, so they can't name rows. A table read from Parquet files needs no work: a row's file
    (as 64-bit hash of its path) and number in it stay the same however often and wherever it is read. What isn't plainly
    such a table (made in memory, joined, with several formats) is written to the shared folder first.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    file, place = (next(n for k in range(len(docs.columns) + 1) if (n := f"{base}{k}") not in {c.lower() for c in docs.columns}) for base in ("row_file", "row_place"))
    if node.nodeName() != "LogicalRelation" or not node.toString().rstrip().endswith("] parquet"):
        path = new_path(docs.sparkSession, "rows")
        docs.write.parquet(path)
        docs = docs.sparkSession.read.schema(docs.schema).parquet(path)
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)), file, place


def without_rows(docs: DataFrame, gone: DataFrame, *names: str) -> DataFrame:
    """docs without the rows named in gone, whose columns names are no others; few go to every task, many are joined."""
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, list(names), "left_anti")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Tables of texts that run inside reach Python rows at a time, where Spark takes 10,000: some 60 MB of documents, held by
    the JVM and by the worker of each task. The same rows arrive; the session's own number holds again at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def in_parts(batches, rows: int = 256):
    """Arrow batches cut into parts, so that a worker holds what it makes of few texts at a time.

    What Arrow keeps of batches that are done goes back to the system: it would stay with the worker until that ends."""
    import pyarrow as pa

    for batch in batches:
        pa.default_memory_pool().release_unused()
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def where_text(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs whose text judge() accepts, as they are; judge: () -> function of a text (None for null) -> bool.

    judge() is called once for each task, where what it holds is loaded. Encoders that an earlier step left in the worker go."""

    def run(batches):
        import pyarrow as pa

        bpe.forget()
        accepts = judge()
        for part in in_parts(batches):
            yield part.filter(pa.array([accepts(t) for t in part.column(column).to_pylist()], pa.bool_()))

    column = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
