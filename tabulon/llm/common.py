"""Shared ground of the operators: written tables instead of long lineages, hashing, batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tabulon-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: All tables of this process lie below one folder of the shared one.
RUN = f"tabulon-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{RUN}/{uuid.uuid4().hex}/{name}"


#: Settings while a table is written: shuffle files of a query go once it is over, and Python workers get batches of few bytes.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a committed Parquet table in the shared folder, read again: cuts the lineage and survives lost executors.

    Shuffle files that only served to make it go at once.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned; all that was made of them must be written itself."""
    for t in tables:
        _delete(t.sparkSession, t.written_at.rpartition("/")[0])


def clear_written(spark: SparkSession) -> None:
    """Removes all tables that this process wrote to the shared folder; results not yet collected or written are lost with them."""
    _delete(spark, f"{shared_dir(spark)}/{RUN}")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, UPPER, LOWER)


def hash128(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def word_count(c: Column) -> Column:
    """Number of runs of characters that are no white space; null counts as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def arrow(table: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(table[f.name], f.type) if not isinstance(table[f.name], pa.Array) else table[f.name].cast(f.type) for f in schema], schema=schema)
