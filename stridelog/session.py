"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings the results depend on: every timestamp is read and shown in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stridelog_scratch"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under one folder for each Spark application.

    `clear_scratch` removes that folder once the application needs no intermediate tables any more.
    """
    return f"{_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stridelog-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that were read from them end, too."""
    remove(spark, _scratch(spark))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df, label: str):
    """`df` written once to the shared folder and read back.

    Cuts the lineage and fixes values such as a partition number that a rerun could change.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
