"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so that it is evaluated once a row."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that tell texts apart; null equals the empty text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2")]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session, as in tests, gets a temporary folder; a cluster is refused, as its executors
    would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str, rebalance: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage at files that survive the loss of executors, and gives the planner true sizes. ``rebalance``
    is for small rows made of large ones: they are put together into files of the advisory size, not one a task.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if rebalance else df
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/tidemark-{spark.sparkContext.applicationId}/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def boxed(df: DataFrame) -> DataFrame:
    """``df`` with its columns in one struct ``__row``, where no computed name can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def unboxed(df: DataFrame, *more: Column) -> DataFrame:
    """The columns that ``boxed`` put away, then ``more``; where names are equal, the latter take the former's place."""
    made = {name.lower(): column for name, column in zip(df.select(*more).columns, more, strict=True)} if more else {}
    own = [made.pop(c.lower(), F.col(f"__row.`{c}`").alias(c)) for c in df.schema["__row"].dataType.names]
    return df.select(*own, *made.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
