"""Tables between jobs, in the folder that all executors share; and numbering of rows in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and has no executors of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="stratum-"))
    return _own[0]


def durable(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs a read and not
    the work before it. Tables go to a folder per application, which
    ``purge`` removes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stratum-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete every table that ``durable`` wrote in this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/stratum-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """``df`` with the place of each row in ``order``, from ``first``.

    Rows are sorted by ranges and numbered within each; the driver sums the
    ranges' sizes, so no task holds all rows.
    """
    held = durable(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = sorted((r["p"], r["n"]) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    base, at = [], first
    for p, n in sizes:
        base.append((p, at))
        at += n
    bases = df.sparkSession.createDataFrame(base, "_p long, _base long")  # a row for each range
    row = F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1)
    return held.withColumn("_p", part).join(F.broadcast(bases), "_p").withColumn(name, row).drop("_p", "_m", "_base")
