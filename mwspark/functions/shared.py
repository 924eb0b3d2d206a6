"""Tables in the folder that all executors share: they end a plan's lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_USED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; where that is unset, in the warehouse, which is shared, too."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "mwspark-tables")
    folder = f"{place.rstrip('/')}/mwspark-{spark.sparkContext.applicationId}"
    if folder not in _USED:
        _USED[folder] = spark
        if len(_USED) == 1:
            atexit.register(drop_tables)
    return folder


def write_shared(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{uuid.uuid4().hex}", df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_tables() -> None:
    """Deletes all shared tables of this process's applications: when nothing that was made from them is read any more, at the latest at exit."""
    for folder, spark in list(_USED.items()):
        sc = spark.sparkContext
        if sc._jsc is not None and sc._gateway is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        del _USED[folder]
