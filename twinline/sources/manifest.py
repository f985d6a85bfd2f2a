"""Tables that are committed by a manifest of their files.

The manifest lists each file below a folder with its length, its rows and a digest of its
bytes. It is written after the files, by Spark's own job commit, and counts only with its success marker:
a folder without one holds nothing that was committed. A reader compares files
with the manifest, and need not decode a file to know that it is the one that was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.session import settle
from twinline.sources.paths import check_folder, folder_exists, path_below, qualified

MANIFEST = "_manifest"
FILES = "file string, bytes long, rows long, digest string"


def _place(root: str) -> str:
    return f"{root.rstrip('/')}/{MANIFEST}"


def has_manifest(spark: SparkSession, root: str) -> bool:
    """Whether a manifest of the folder was committed: its success marker comes last."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{_place(root)}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def _files(spark: SparkSession, root: str, folder: str, strict: bool = True) -> DataFrame:
    """``(file, bytes, digest)`` of the data files as they are, without those that cannot be read unless ``strict``.

    A file is hashed where it lies, and not decoded.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    files = reader.option("ignoreCorruptFiles", str(not strict).lower()).load(folder)
    return files.select(path_below("path", qualified(spark, root)).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def write_manifest(spark: SparkSession, root: str, folder: str | None = None) -> None:
    """Commit the Parquet files below ``folder``, by default ``root``, as the table ``root``."""
    folder = folder or root
    name = path_below("path", qualified(spark, root)).alias("file")
    stated = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
    files = _files(spark, root, folder).join(stated.select(name, "rows"), "file", "left")
    files = files.select("file", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), "digest")
    files.write.mode("errorifexists").parquet(_place(root))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(file, bytes, rows, digest)`` of the committed files."""
    if not has_manifest(spark, root):
        raise ValueError(f"{root} has no committed manifest")
    return spark.read.schema(FILES).parquet(_place(root))


def compare_files(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame:
    """``(file, rows, good)`` of every committed file: good when it is there, as long as it was, with the same digest."""
    found = _files(spark, root, folder or root, strict=False).toDF("file", "_bytes", "_digest")
    both = read_manifest(spark, root).join(found, "file", "left")
    good = F.coalesce((F.col("bytes") == F.col("_bytes")) & (F.col("digest") == F.col("_digest")), F.lit(False))
    return settle(both.select("file", F.when(good, F.col("rows")).otherwise(0).alias("rows"), good.alias("good")), "compared")


def commit_table(df: DataFrame, target: str, by: list[str]) -> None:
    """Write ``df`` below ``target`` and commit it; a committed target is never replaced.

    Each try writes into a folder of its own. What a failed try left behind is in no
    manifest, is never read, and does not stand in the way of the next.
    """
    spark = df.sparkSession
    if has_manifest(spark, target):
        raise ValueError(f"{target} is committed already")
    folder = f"{target.rstrip('/')}/data-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder)
    if folder_exists(spark, _place(target)):
        raise ValueError(f"{target} holds a manifest that was not committed; remove {_place(target)}")
    write_manifest(spark, target, folder)


def read_table(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All rows of a committed table. A file that is gone or differs from what was committed stops the read."""
    listed = read_manifest(spark, target)
    parts = listed.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("part")).distinct().limit(2).collect()
    if not parts:
        return spark.createDataFrame([], schema)
    if len(parts) > 1:
        raise ValueError(f"{target} was not written by one commit")
    folder = f"{target.rstrip('/')}/{parts[0].part}"
    check_folder(spark, folder)
    damaged = compare_files(spark, target, folder).filter("not good").orderBy("file").limit(5).collect()
    if damaged:
        raise ValueError(f"{target}: not as committed: {[r.file for r in damaged]}")
    return spark.read.schema(schema).parquet(folder)
