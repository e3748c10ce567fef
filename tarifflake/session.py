"""Session defaults. On a cluster the submitted configuration wins; only unset values are filled in."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(app: str = "tarifflake", cpus: int | str = 8, partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench on one machine."""
    cpus = cpus or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints: the cluster's own setting, or a scratch folder where none is set
    (a single machine, as in tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        folder = configured
    else:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tarifflake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's setting by which an action's shuffle files go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Actions and streams started inside have these settings; then they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stage(df, folder: str | None = None):
    """A table several outputs read: written once to the checkpoint folder, so no output works it out again and a
    lost executor costs only its own reads. Columns are compressed: checkpoints of rows are several times as large. What
    was moved to work the table out is dropped when it is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    with settings(spark, {DROP_SHUFFLES: "true"}):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
