"""What the operators share: row keys, written intermediate tables, the words of a text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_hash(text: Column) -> Column:
    """With doc_id the identity of a row: rows that agree in both are one document, read twice."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of (doc_id, th), which Spark still plans as an equi-join."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. One of our own, on this machine, only where the session names
    none and runs on this machine alone; a cluster without one is refused, since rows would be lost."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, cut off from its lineage: written to the shared folder and read again; removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(schema).parquet(path)


def local_path(path: str) -> str | None:
    """A path that Python's open() takes; None for a file system that it doesn't know."""
    bare = path.removeprefix("file://").removeprefix("file:")
    return bare if bare.startswith("/") else None


def computed(df: DataFrame) -> DataFrame:
    """df, behind a generator that filters aren't pushed through.

    A filter that the optimiser moves below a projection takes the projection's expressions along; where one stands
    inside a lambda, it is then evaluated again for every element.
    """
    one = df.select(F.explode_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("one"))
    return one.select(*[F.col("one").getField(c).alias(c) for c in df.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
