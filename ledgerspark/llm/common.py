"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Words are runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a new one of our own, on a local master only: on a cluster executors couldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """(the folder's file system, the path in it) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table written to the shared folder and read again: it cuts the lineage, and a lost executor costs nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got.written_at = path
    return got


def forget(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing will read again."""
    fs, at = _file_system(df.sparkSession, df.written_at)
    fs.delete(at, True)


def shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Puts a small file into the shared folder; its address."""
    fs, at = _file_system(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}")
    out = fs.create(at)
    out.write(bytearray(content))
    out.close()
    return fs.makeQualified(at).toString()


def with_columns(fields: Iterable[StructField], more: str) -> StructType:
    """A schema of these fields, of whatever names, and more, which are given as text."""
    return StructType([*fields, *_parse_datatype_string(more)])


def unit(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the keys and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
