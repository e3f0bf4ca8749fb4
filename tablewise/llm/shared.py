"""What the operators of this subpackage share: settings, intermediate tables, size-checked broadcasts, bounded batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: long texts fill memory before short ones fill a batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: A side is broadcast up to so many rows of a few long columns each (about 60 MB as a hash table); beyond it is shuffled.
BROADCAST_ROWS = 500_000
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a local master, where there is just one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("tablewise.shared.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    own = tempfile.mkdtemp(prefix="tablewise-shared-")
    spark.conf.set("tablewise.shared.dir", own)
    return own


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when the counted rows stay under the bound; otherwise the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def aside(df: DataFrame, names: set[str]) -> tuple[DataFrame, list[Column]]:
    """df with the columns whose names an operator needs for itself renamed, and the columns that give df back as it was."""
    moved = {c: f"_aside_{i}" for i, c in enumerate(df.columns) if c.lower() in names}
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return df.withColumnsRenamed(moved), [F.col(quoted(moved.get(c, c))).alias(c) for c in df.columns]


def texts_of(column) -> pa.Array:
    """A batch's text column as one array without nulls; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def word_count(c) -> F.Column:
    """Words of a text on the JVM; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
