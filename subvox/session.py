"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators count on. AQE converts joins to broadcast only after it
#: has seen the real size of a side, and splits skewed partitions of plain joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Samples are dense work: a task for every 256 KB rather than the default megabyte.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(master: str | None = None, app: str = "subvox", **conf: str) -> SparkSession:
    """A session with the settings above; ``master=None`` keeps the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives Python workers this package, as ``--py-files`` would; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="subvox-")) / "subvox"), "zip", root, "subvox")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode a fresh folder where it is unset."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current and (shared is None or current.split(":", 1)[-1].startswith(shared.split(":", 1)[-1])):
        return current
    if shared is None and not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="subvox-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
