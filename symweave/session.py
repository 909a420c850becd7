"""Session helpers: tables, the shared scratch folder and staged intermediate results."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    A session on one machine (master ``local``) without that setting gets a temporary folder; on a cluster it is an error, as each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` below this application's part of the shared folder, which :func:`release` removes."""
    return f"{shared_dir(spark)}/symweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove everything that operators of this application have written to the shared folder; results not read yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/symweave-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Levels:
    """The results of the rounds of an iteration, each written below one shared folder, which is read as one table with a column ``level``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, scratch(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next round and read it back."""
        path = f"{self.folder}/level={self.count}"
        df.write.option("compression", "zstd").parquet(path)
        self.schema, self.count = df.schema, self.count + 1
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("level", IntegerType())])).parquet(self.folder)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions, which sets the number of tasks that operators plan for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions in tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for f in sorted(root.rglob("*.py")):
            archive.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions to use all cores: a small scan of few files is shared out, a large one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
