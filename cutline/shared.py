"""The folder that driver and executors share, cut lineage, names that are free, sides small enough to broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many counted rows (tens of MB).
BROADCAST_ROWS = 500_000


def fresh(df: DataFrame, name: str, *besides: str) -> str:
    """A column name that is neither df's nor one of `besides`, made of `name`."""
    taken = {c.lower() for c in (*df.columns, *besides)}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> None:
    """Sees to it that checkpoints go to spark.checkpoint.dir; a folder of our own only in local mode, where that is unset."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="cutline-"))


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder, so that later steps neither recompute nor lose them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, kept as Parquet in the shared folder: for many rows of which columns repeat, a fraction of what stored() takes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows, counted here, are within the limit; else Spark shuffles it. Give a stored or cheap df."""
    return F.broadcast(df) if df.count() <= limit else df
