"""Session helpers shared by every layer: the shared folder and written cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, named by ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one process (tests) is a folder made here; on a cluster its absence is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    made = getattr(spark.sparkContext, "_massloom_shared", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="massloom-")
        spark.sparkContext._massloom_shared = made
    return made


#: Bytes of the batches that Python workers get; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES``, so that rows of long texts fill neither the JVM's buffers nor the workers.

    A bound that the session or the cluster already sets, in whatever unit, stays as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/massloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not the recomputation of the whole plan.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
