"""Library tables as Parquet: typed reads, staged writes, upserts and JSON documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.overrides import upserted


class Library:
    """Tables under a folder, each in versioned subfolders; the newest complete version counts.

    A write goes to a version of its own, which Spark's committer completes with a marker, so readers see all of it or none
    and an interrupted write leaves the table as it was. There is one writer.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> list[str]:
        """Names of complete versions, oldest first; listed through Spark's filesystems, so any store works."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        where = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not where.exists(path):
            return []
        found = [x.getPath() for x in where.listStatus(path)]
        return sorted(p.getName() for p in found if where.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        versions = self._versions(table)
        if not versions:
            return schema.empty(self.spark, table)
        return self.spark.read.schema(schema.TABLES[table]).parquet(f"{self.root}/{table}/{versions[-1]}")

    def replace(self, table: str, rows: DataFrame) -> None:
        n = len(self._versions(table))
        schema.conform(rows, table).write.parquet(f"{self.root}/{table}/{n:08d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, table: str, rows: DataFrame) -> None:
        self.replace(table, upserted(self.read(table), schema.conform(rows, table), schema.KEYS[table][0]))

    def problems(self) -> DataFrame:
        return schema.violations({t: self.read(t) for t in schema.TABLES})


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row, nulls left out."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "true"}).alias("value"))


def parsed(df: DataFrame, ddl: str, text: str = "value") -> DataFrame:
    """The documents of a text column as columns, and ``problem``, which holds a text that does not parse."""
    x = df.withColumn("_d", F.from_json(text, f"{ddl}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return x.select("_d.*").withColumnRenamed("_corrupt", "problem")
