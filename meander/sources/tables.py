"""Intermediate tables in the shared folder, and the graph that the sample tables hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Only a local session may do without: it gets one of its own."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meander-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/meander-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """df from a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, col: str) -> DataFrame:
    """df from a table in the shared folder that lies in sorted buckets by a column: joins on it leave the table where it is."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, col).write.bucketBy(n, col).sortBy(col).option("path", path).saveAsTable(name, format="parquet")
    table = spark.table(name)
    table.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): the part of an order's line and that of its next line, duplicates and self loops included."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return line.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst")


def supplier_part_edges(spark: SparkSession, sf_dir: str, shift: int = 1_000_000) -> DataFrame:
    """(src, dst): supplier and part, both ways; part ids are shifted clear of the suppliers'. Suppliers are hubs."""
    one = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + shift).alias("dst")).distinct()
    return one.union(one.select("dst", "src"))
