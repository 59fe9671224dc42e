"""CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.merge import union_all
from gridloom.sources import schemas as S


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_strategies(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Pairs of all strategies whose file is there, with the strategy's name; none is an error."""
    return union_all([read_csv(spark, p, S.PAIRS).withColumn("strategy", F.lit(s)) for s, p in paths.items() if exists(spark, p)])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; one written without the date columns is refused."""
    head = spark.read.csv(path, header=True).limit(0)
    S.demand(head, S.DATE_COLUMNS, "the manifest")
    return read_csv(spark, path, S.MANIFEST)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Overwrites, also with an empty result: no earlier run's rows stay. ``single`` writes one ordered file, for small relations."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')
