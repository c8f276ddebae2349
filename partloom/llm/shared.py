"""Helpers that the operators of this subpackage share: tables in the cluster's shared folder, rows, files, words."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None

#: ASCII upper case to lower case; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a few numbers that may be sent to all tasks.
SENT_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where none is set and the master is local."""
    global _own_dir
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="partloom-")
        folder = f"file://{_own_dir}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/partloom-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, sent to all tasks if it has no more than ``SENT_ROWS`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def file_row() -> Column:
    """For tables that are read from files as they are: which file and which row of it, the same however often it is read."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def numbered(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, which tells rows apart and stays the same however often it is read, and doc, with all columns of docs, whatever
    their names. Without a column for row, such as ``file_row()``, docs is written once with numbers."""
    rows = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.struct("*").alias("doc"))
    return stored(rows, "numbered") if row is None else rows


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows but those in gone (row): texts stay where they are unless too many rows go."""
    return rows.join(bounded(stored(gone.select("row"), "gone")), "row", "left_anti")


def field(name: str) -> Column:
    return F.col("doc").getField(name)


def kind_of(df: DataFrame, column: str) -> str:
    """A column's type, to pass it through a function."""
    return df.select(column).schema[0].dataType.simpleString()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """For tasks that write or read files of their own format: local, HDFS or object store by the path's scheme."""
    return pafs.FileSystem.from_uri(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def white_space_words(c: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
