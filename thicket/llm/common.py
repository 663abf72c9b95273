"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, in Java's and Python's regex syntax.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Name used for the row identity that operators add; doc_id may be null or repeated.
UID = "_uid"


class Remembered(dict):
    """What make gives for each word; a Python worker keeps up to `most` short words."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        got = self.make(word)
        if len(self) < self.most and len(word) <= 64:
            self[word] = got
        return got


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="thicket-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Removes an execution's shuffle files at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Queries made and run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Parquet looks at its sizes after each row, not after a hundred: pages of 1 MB and row groups of 4, so that neither writing nor
#: reading holds many large rows at once.
LARGE_ROWS = {"parquet.block.size": 4 << 20} | {f"parquet.{x}.size.row.check.{end}": 1 for x in ("page", "block") for end in ("min", "max")}


def stored(df: DataFrame, options: dict | None = None) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, written with options; smaller than a checkpoint where rows hold texts.

    Its shuffle files go with the write, for nothing reads them afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Deletes a stored table that nothing will read again."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("table-"):
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def with_uid(df: DataFrame) -> DataFrame:
    """df with a unique row number; checkpoint the result before using it twice."""
    return df.withColumn(UID, F.monotonically_increasing_id())


def lower_ascii(text):
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def code_points(texts: pa.Array, most: int = 1 << 20, overlap: int = 0):
    """Blocks of about `most` code points of whole texts, in order.

    Yields (first row, bounds, codes): bounds has the start of each row's part in codes, and the end of the last.
    A text longer than `most` comes in several blocks of its own, each repeating the last `overlap` codes of the one before.
    """
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    row, n = 0, len(texts)
    while row < n:
        if lengths[row] > most:
            codes = np.frombuffer(texts[row].as_py().encode("utf-32-le"), dtype=np.uint32)
            for at in range(0, len(codes), most):
                part = codes[max(0, at - overlap) : at + most]
                yield row, np.array([0, len(part)]), part
            row += 1
            continue
        last, total = row, 0
        while last < n and lengths[last] <= most and total + lengths[last] <= most:
            total += lengths[last]
            last += 1
        joined = "".join(texts.slice(row, last - row).to_pylist())
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        yield row, np.concatenate([[0], np.cumsum(lengths[row:last])]), codes
        row = last


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Gives Python workers batches of 8 MB at most, or of another size, for rows that hold much."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed, and give them texts in modest batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
