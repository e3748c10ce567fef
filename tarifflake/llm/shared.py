"""What several operators share: ordered buckets, reliable checkpoints and files in the shared folder."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

LOWEST = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame) -> DataFrame:
    """Written once to ``spark.checkpoint.dir``: later readers do not run the plan again, and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, kind: str) -> str:
    """An empty folder below the shared one, as a URI that pyarrow's file systems open on any executor."""
    base = checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    fs, inside = filesystem(path)
    fs.create_dir(inside, recursive=True)
    return path


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a URI or an absolute path."""
    if "://" not in path:
        path = f"file://{os.path.abspath(path.removeprefix('file:'))}"
    return pafs.FileSystem.from_uri(path)


def order_key(c: Column) -> Column:
    """An integer id for ordering; null comes first."""
    return F.coalesce(c.cast("bigint"), F.lit(LOWEST))


def cut_points(df: DataFrame, key: Column, n: int) -> list[int]:
    """At most ``n`` ascending values of ``key`` that cut the rows into ranges of about equal counts; the first is the
    smallest value. The result is bounded by ``n``, whatever the rows."""
    row = df.select(F.percentile_approx(key, [i / n for i in range(n)], 20 * n).alias("c"), F.min(key).alias("m")).first()
    return sorted({*(row["c"] or []), *([] if row["m"] is None else [row["m"]])})


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """The number of the range that holds ``key``."""
    points = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    return F.greatest(F.size(F.filter(points, lambda c: c <= key)) - 1, F.lit(0))
