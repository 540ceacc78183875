"""Reading and publishing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType


def read_raw(spark: SparkSession, path: str, header: list[str], columns: list[str] | None = None, *, line_breaks: bool = False) -> DataFrame:
    """A CSV file with a header, all strings: ids and ZIP codes keep their zeros. Columns that aren't asked for aren't parsed; quoted texts may hold doubled quotes.

    Spark cuts a file between lines, so a file of any size is read by many tasks. With line_breaks, quoted texts may hold
    line breaks too; such a file can only be read by one task, so its rows are dealt out again for what follows.
    """
    df = spark.read.schema(StructType([StructField(c, StringType()) for c in header])).option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    df = df.select(*columns) if columns else df
    return df.repartition(spark.sparkContext.defaultParallelism) if line_breaks else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, n: int | None = None) -> DataFrame:
    df = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    if missing := [c for c in columns or [] if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    df = df.select(*columns) if columns else df
    return df.limit(n) if n is not None else df


def export_samples(tables: dict[str, DataFrame], folder: str, n: int = 100) -> None:
    """The first n rows of each table as one CSV file."""
    for name, df in tables.items():
        df.limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def conformed(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the columns and types of a schema, or an error."""
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return df.to(schema)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.exists(at(path))


def publish(df: DataFrame, path: str, schema: StructType | None = None, key: str | None = None) -> None:
    """Parquet that is visible when it is complete: it is written beside its place and moved in; what was there before goes only then, and comes back if the move fails. With schema, columns are cast to it and put in its order, or it is an error. With key, files hold ranges of it in its order and filters of its values, so that lookup() reads a few row groups."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    at, fs = _hadoop(spark, path)
    new, old = f"{path.rstrip('/')}_new-{mark}", f"{path.rstrip('/')}_old-{mark}"
    try:
        out = conformed(df, schema) if schema else df
        out = out.repartitionByRange(key).sortWithinPartitions(key) if key else out
        out.write.options(compression="snappy", **({f"parquet.bloom.filter.enabled#{key}": "true"} if key else {})).parquet(new)
        there = fs.exists(at(path))
        if there and not fs.rename(at(path), at(old)):
            raise OSError(f"{path} can't be moved away")
        if not fs.rename(at(new), at(path)):
            if there:
                fs.rename(at(old), at(path))
            raise OSError(f"{path} can't be moved in")
    finally:
        fs.delete(at(new), True)
    fs.delete(at(old), True)


#: Names in a folder of published sets: the folders of its versions, and the file that says which one counts.
VERSIONS, CURRENT = "versions", "current"


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version of a published set that counts, None before the first."""
    path, fs = _hadoop(spark, folder)
    if not fs.exists(path(f"{folder}/{CURRENT}")):
        return None
    stream = fs.open(path(f"{folder}/{CURRENT}"))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the set that counts now. What has been read stays of that version."""
    version = current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{VERSIONS}/{version}/{name}")


def publish_set(tables: dict[str, DataFrame], folder: str, keep: int = 2) -> dict[str, int]:
    """All tables or none, at one moment: a new version is written beside the others and counted again, then a pointer file is replaced by one rename. Whenever a driver is lost, readers see the whole set of before or the whole new one.

    A table keeps the columns and types that it has in the version before (its rows are cast to them, or it is an
    error); an empty table is an error. Of superseded versions the last keep - 1 stay for those who still read them.
    """
    spark = next(iter(tables.values())).sparkSession
    path, fs = _hadoop(spark, folder)
    before = current_version(spark, folder)
    version = f"{int((before or '0').split('-')[0]) + 1:08d}-{uuid.uuid4().hex}"
    at, counts = f"{folder}/{VERSIONS}/{version}", {}
    try:
        for name, df in tables.items():
            was = f"{folder}/{VERSIONS}/{before}/{name}"
            fixed = conformed(df, spark.read.parquet(was).schema) if before and fs.exists(path(was)) else df
            fixed.write.option("compression", "snappy").parquet(f"{at}/{name}")
            counts[name] = spark.read.parquet(f"{at}/{name}").count()
            if not counts[name]:
                raise ValueError(f"{name} is empty")
    except Exception:
        fs.delete(path(at), True)
        raise
    _point(spark, folder, version)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(path(f"{folder}/{VERSIONS}")))
    for old in [v for v in versions if v < version][: -(keep - 1) or None]:
        fs.delete(path(f"{folder}/{VERSIONS}/{old}"), True)
    return counts


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """The pointer file says this version from one moment on."""
    jvm = spark.sparkContext._jvm
    path, fs = _hadoop(spark, folder)
    new = f"{folder}/{CURRENT}-{uuid.uuid4().hex}"
    out = fs.create(path(new))
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    made = fs.makeQualified(path(folder)).toUri()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(made, spark.sparkContext._jsc.hadoopConfiguration()).rename(path(new), path(f"{folder}/{CURRENT}"), options)


def lookup(df: DataFrame, key: str, value) -> dict:
    """Exactly one row, or an error. The value is taken as the key's type, so the filter reaches the files."""
    rows = df.filter(F.col(key) == F.lit(value).cast(df.schema[key].dataType)).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{key} = {value!r}: {'no row' if not rows else 'several rows'}")
    return rows[0].asDict()


#: Seeds of the two 64-bit hashes of a row.
SEEDS = (17, 89)


def fingerprint(df: DataFrame, key: str | None = None, ranges: int = 64) -> DataFrame:
    """rows and digest: one row that changes with any value of the table, its column names and types, and with where a null or a value stands, whatever the order of its rows. With key, a row for each of some ranges of the key's hash, so that two tables show where they differ."""
    value = lambda f: F.to_json(f"`{f.name}`") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
    parts = [x for f in df.schema for x in (value(f).isNull(), value(f))]
    hashes = [F.xxhash64(F.lit(seed), *parts) for seed in SEEDS]
    of = lambda h: (F.sum(h.cast("decimal(38,0)")).cast("string"), F.lpad(F.hex(F.bit_xor(h)), 16, "0"))
    digest = F.sha2(F.concat_ws("|", F.lit(df.schema.simpleString()), F.count("*").cast("string"), *of(hashes[0]), *of(hashes[1])), 256).alias("digest")
    grouped = df.groupBy() if key is None else df.groupBy(F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int").alias("range"))
    return grouped.agg(F.count("*").alias("rows"), digest)


def differing_ranges(a: DataFrame, b: DataFrame, key: str, ranges: int = 64) -> DataFrame:
    """range, rows_a, rows_b of the ranges of the key's hash whose rows differ between two tables; they are told apart by digests, without a join of rows."""
    x, y = (fingerprint(df, key, ranges).withColumnsRenamed({"rows": f"rows_{n}", "digest": f"digest_{n}"}) for df, n in ((a, "a"), (b, "b")))
    return x.join(y, "range", "full").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("range", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))
