"""Reading tables, bounded Arrow batches and tables written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subvox.session import checkpoint_dir, ship_package

#: Word of the near-duplicate and mixing contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch, so that a task holds a bounded number of texts.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; the session is made ready for Python workers."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again.

    Cuts the lineage and outlives lost executors. The files stay until the folder is expired.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Number of words of ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
