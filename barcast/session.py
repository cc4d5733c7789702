"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_REQUIRED = {
    # Stored instants are UTC; calendar fields convert explicitly.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Ids in folder names are text: "007" stays "007".
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and benches; on a cluster the submitter supplies it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barcast")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in {**_REQUIRED, **extra}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every function here relies on."""
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the session.

    Only a local session without ``spark.checkpoint.dir`` gets a folder of its
    own; a cluster session without one is an error, since a machine-local
    folder would be lost with its executor.
    """
    root, chosen = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if root:
        if not chosen:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if chosen:
        return chosen.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="barcast-")
    spark.sparkContext.setCheckpointDir(root)
    return root


_owner: ContextVar[str] = ContextVar("owner", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Own the intermediate tables of a job: all that is stored inside the block is removed at its end.

    Results that are still lazy must be written before that.
    """
    folder = f"{shared_root(spark)}/barcast/job-{uuid.uuid4().hex}"
    token = _owner.set(folder)
    try:
        yield folder
    finally:
        _owner.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    folder = _owner.get() or f"{shared_root(spark)}/barcast"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts lineage durably (survives executor loss), gives the optimizer true
    sizes for its join choices and lets later filters and projections reach
    the Parquet scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
