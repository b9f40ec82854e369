"""Session and staging helpers shared by the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a dataset directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly over all cores: small rows whose files are few, before work that takes long for each."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
        path = getattr(shared_dir, "_own", None) or tempfile.mkdtemp(prefix="docloom-")
        shared_dir._own = path
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(df: DataFrame, key: str, most: int = 2000) -> list[DataFrame]:
    """df cut by a hash of key into parts of about most rows, small enough to broadcast one by one; all of df is in one of them."""
    n = max(1, -(-df.count() // most))
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]
