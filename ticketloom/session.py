"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def local_session(cores: int | str = 8, app: str = "ticketloom") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the session runs in one process (tests, laptops) a fresh temporary folder
    is made; executors of a cluster could not see it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    The copy lies in the shared folder, so it cuts the lineage and outlives a
    lost executor, and its real size guides the joins that follow.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame to every row (a broadcast of one row)."""
    key = "_one"
    right = F.broadcast(one_row.limit(1).withColumn(key, F.lit(1)))
    return df.withColumn(key, F.lit(1)).join(right, key).drop(key)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small configuration table that lives in the plan itself.

    Unlike a table made from driver rows its size is known to the optimizer, so
    joins with it are broadcast by Spark's own size check and facts stay put.
    """
    struct = T._parse_datatype_string(schema)
    items = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, struct.fields)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*items)))
