"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import itertools
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
_names = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the one that the session names.

    Where none is named, a local session gets a temporary one, any other a folder in the warehouse, which is shared too.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if not context.getCheckpointDir():
        local = context.master.startswith("local")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that a lost executor costs no recomputation of its lineage."""
    spark = df.sparkSession
    shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def own_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{os.getpid()}-{next(_names)}-{os.urandom(4).hex()}"


def word_count(text):
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, rows: int = 400_000) -> DataFrame:
    """df (small rows, cut off before) marked for a broadcast if it has at most ``rows`` rows, else left to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def once(df: DataFrame, **columns) -> DataFrame:
    """df with more columns, each computed once a row: as a generator's output they are not merged into later expressions,
    where a lambda function would compute them again for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bound(value, body):
    """body(value), with value computed once though body uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that placed() folds together.
FOLD = 64


def placed(items, start, step, moved):
    """The array ``out`` of a fold over items whose state is (at, out); ``step`` counts places from 0, moved(x, by) shifts one.

    A fold copies its array at each step, so it is made for FOLD items at a time, and each block is then moved by the place
    that the blocks before it end at.
    """

    def blocks(items):
        last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / FOLD).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(items, k * FOLD + 1, F.lit(FOLD)), start, step))

    def offsets(parts):
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(parts, none, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def joined(parts):
        return bound(offsets(parts), lambda o: F.flatten(F.transform(parts, lambda x, k: F.transform(x["out"], lambda s: moved(s, F.get(o, k))))))

    return bound(items, lambda p: bound(blocks(p), joined))
