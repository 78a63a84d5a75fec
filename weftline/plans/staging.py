"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary one, if everything runs on this machine; a cluster's executors wouldn't share it, so
    there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def staged(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The result has no lineage before the files, so a lost executor costs a re-read, not a recomputation, and a later
    loop step plans over a scan. Schema and rows are those of df; row order isn't kept. by: columns whose values get
    folders of their own, so a read of one value leaves the others alone; they come last.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    jvm = spark.sparkContext._jvm
    for folder in {m[0] for f in df.inputFiles() if (m := re.match(r".*?/weftline-[^/]*-[0-9a-f]{32}", f))}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
