"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "loomgraph") -> SparkSession:
    """A local session with the settings that the library expects: UTC, adaptive execution, few shuffle partitions."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder only in local runs where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """df dealt by keys over as many tasks as the session has shuffle partitions, or so many times as many.

    For small rows that much is made of: a table of few bytes is read by few tasks, and would be put together into few again without a given number.
    """
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read again; removed when the program ends.

    So loops don't grow their plans, lost executors cost no recomputing, and the planner knows the size of what it joins. A
    reliable checkpoint would compute df twice and hide its size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
