"""Session settings and lineage cuts.

Iterative jobs write their state between rounds as Parquet under the folder the
cluster names in ``spark.checkpoint.dir``.  A written table survives lost executors,
is column-pruned when it is read back, and gives Catalyst exact sizes for its next
join decision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is hinted as broadcast only when its counted cells stay below this.
BROADCAST_CELL_LIMIT = 4_000_000


def build_session(app: str = "callweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs expect; an existing cluster conf wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        # Keys of long streams live on disk, not in the heap.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, else a folder of the warehouse, which all executors share as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate").rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds all intermediate tables of this application."""
    return f"{shared_dir(spark)}/callweave/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the folder of this run that nothing else uses."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_run(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result needs them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "state", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)



def release(*frames: DataFrame) -> None:
    """Delete the files behind ``materialize`` tables that no later step reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
