"""Session settings every job of the package relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans at run time; all of them may be set on a live session.
RUNTIME_CONF = {
    # every timestamp in the package is UTC; naive Parquet timestamps are read as UTC instants
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows go to Python in small batches, by number and by bytes, so a worker's memory does not follow the length of texts
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    # a retried partition overwrite replaces only the partitions it writes
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # stream state lives off-heap and is checkpointed as changelogs
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings; cluster sizing stays with the submitter."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else has built."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once; functions that run there import it."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(context, "_tidemark_shipped", False) or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    # the runner that asks a stateful operator for its state schema starts on the driver and sees this path only
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (str(target), context.environment.get("PYTHONPATH")) if p)
    context._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's checkpoint dir, or a local one where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        base = configured
    elif spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="tidemark-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder, for the files of one job."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs start from files, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
