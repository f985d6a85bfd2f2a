"""Shard tables and nested pair tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.operators.filters import quarantine
from twinline.schemas import TRANSLATION, require, require_schema
from twinline.session import settle
from twinline.sources.manifest import commit_table, compare_files, has_manifest, read_table, write_manifest
from twinline.sources.paths import check_folder, folder_exists, path_below, qualified

SPLITS = ("train", "val")
PLACE = [T.StructField("split", T.StringType()), T.StructField("shard_id", T.LongType())]


def read_pairs(
    spark: SparkSession, path: str, fmt: str = "parquet", src: str = "src", tgt: str = "tgt"
) -> DataFrame:
    """Nested ``(id, translation)`` rows from Parquet or JSON, whose sides are named ``src`` and ``tgt`` on disk."""
    schema = f"id string, translation struct<`{src}`: string, `{tgt}`: string>"
    return spark.read.schema(schema).format(fmt).load(path).withColumn("translation", F.col("translation").cast(TRANSLATION))


def scan_pairs(spark: SparkSession, path: str, src: str = "src", tgt: str = "tgt") -> tuple[DataFrame, DataFrame]:
    """Nested pairs of a folder of JSON lines: good rows ``(id, translation)``, and bad ones ``(line, reasons)``.

    A line is ``damaged`` when it is cut, is no JSON object, or holds a value of another type than
    the schema has. A whole line may still have ``no id`` or ``no translation``. Good rows never hold a
    null in place of something that could not be read. Blank lines are no rows.
    """
    parsed = f"id string, translation struct<`{src}`: string, `{tgt}`: string>, _damaged string"
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "line")
    row = F.from_json("line", parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    rows = lines.withColumn("_row", row)
    damaged = F.col("_row").isNull() | F.col("_row._damaged").isNotNull()
    rules = {
        "damaged": damaged,
        "no id": ~damaged & F.col("_row.id").isNull(),
        "no translation": ~damaged & F.col("_row.translation").isNull(),
    }
    good, bad = quarantine(rows, rules)
    return good.select("_row.id", F.col("_row.translation").cast(TRANSLATION).alias("translation")), bad.select("line", "reasons")


def name_sides(df: DataFrame, src: str, tgt: str) -> DataFrame:
    """Name the sides of ``translation`` by their languages, as shared corpora do."""
    return df.withColumn("translation", F.col("translation").cast(f"struct<`{src}`: string, `{tgt}`: string>"))


def write_shards(df: DataFrame, out: str, manifest: bool = False) -> None:
    """Write ``split=…/shard_id=…``, one file per shard, rows in order. Empty shards do not arise.

    With a ``manifest`` of the files, readers need not decode them to verify them.
    """
    require(df, "split", "shard_id")
    order = [c for c in ("row_idx",) if c in df.columns]
    (
        df.repartition("split", "shard_id")
        .sortWithinPartitions("split", "shard_id", *order)
        .write.partitionBy("split", "shard_id")
        .parquet(out)
    )
    if manifest:
        write_manifest(df.sparkSession, out)


def verify_shards(spark: SparkSession, out: str, schema: T.StructType, splits: Sequence[str] = SPLITS) -> DataFrame:
    """``(path, rows, good)`` of every file of the splits; missing splits are skipped.

    A file is good when all its columns decode, checksums included, to as many
    rows as its footer states. A file that fails is read once more, so that a
    passing fault of the store does not condemn it. The result is settled. Where the folder has
    a manifest, a file is good when its length and digest are those in it, and none is decoded;
    files that are not in it are no shards, and files that are gone are not good.
    """
    paths = _split_folders(spark, out, splits)
    if has_manifest(spark, out):
        root = qualified(spark, out)
        wanted = F.regexp_extract("file", "^split=([^/]*)/", 1).isin(list(splits))
        files = compare_files(spark, out).filter(wanted)
        return settle(files.select(F.concat(F.lit(f"{root}/"), "file").alias("path"), "rows", "good"), "verdicts")
    verdicts = _verdicts(spark, out, schema, paths)
    bad = verdicts.filter("not good")
    if not bad.isEmpty():
        again = _verdicts(spark, out, schema, paths, settle(bad.select("path"), "suspects"))
        verdicts = settle(verdicts.filter("good").union(again), "verdicts")
    return verdicts


def _split_folders(spark: SparkSession, out: str, splits: Sequence[str]) -> list[str]:
    check_folder(spark, out)
    found = [p for p in (f"{out.rstrip('/')}/split={s}" for s in splits) if folder_exists(spark, p)]
    if not found:
        raise ValueError(f"no shards of {list(splits)} under {out}")
    return found


def _scan(spark: SparkSession, out: str, schema: T.StructType) -> DataFrameReader:
    fields = [f for f in schema.fields if f.name not in ("split", "shard_id")]
    reader = spark.read.schema(T.StructType([*fields, *PLACE])).option("basePath", out)
    return reader.option("parquet.page.verify-checksum.enabled", "true")


def _verdicts(
    spark: SparkSession, out: str, schema: T.StructType, paths: Sequence[str], only: DataFrame | None = None
) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    rows = _scan(spark, out, schema).option("ignoreCorruptFiles", "true").parquet(*paths)
    path = F.col("_metadata.file_path").alias("path")
    files, rows = files.select(path), rows.select(path, *rows.columns)
    if only is not None:
        files, rows = files.join(only, "path", "left_semi"), rows.join(only, "path", "left_semi")
    # Hashing every column decodes it; counting none of them reads the footers alone.
    decoded = rows.select("path", F.xxhash64(*rows.columns[1:]).alias("hash")).groupBy("path")
    decoded = decoded.agg(F.count("*").alias("rows"), F.bit_xor("hash").alias("hash")).filter("hash is not null")
    stated = rows.select("path").groupBy("path").agg(F.count("*").alias("stated"))
    both = files.join(decoded, "path", "left").join(stated, "path", "left")
    good = F.coalesce(F.col("rows") == F.col("stated"), F.lit(False))
    return settle(both.select("path", F.when(good, F.col("rows")).otherwise(0).alias("rows"), good.alias("good")), "verdicts")


def read_shards(
    spark: SparkSession,
    out: str,
    schema: T.StructType,
    splits: Sequence[str] = SPLITS,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """All rows of the good shard files; a damaged file gives none, whichever columns are read.

    ``verdicts`` is what :func:`verify_shards` returned, which runs first when it
    is not given. The rows themselves are read strictly: an error fails the job.
    """
    if verdicts is None:
        verdicts = verify_shards(spark, out, schema, splits)
    paths = _split_folders(spark, out, splits)
    rows = _scan(spark, out, schema).parquet(*paths)
    # As literals: only then does Spark leave the files unopened. They come from a listing that the driver holds anyway.
    bad = [r.path for r in _left_out(spark, paths, verdicts).collect()]
    return rows.filter(~F.col("_metadata.file_path").isin(bad)) if bad else rows


def _left_out(spark: SparkSession, paths: Sequence[str], verdicts: DataFrame) -> DataFrame:
    """Paths, as scans write them, of all files that are not good: damaged ones, and those that were not committed."""
    path = F.col("_metadata.file_path").alias("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select(path)
    good = verdicts.filter("good").select(_plain("path").alias("_plain"))
    return files.withColumn("_plain", _plain("path")).join(good, "_plain", "left_anti").select("path")


def _plain(path: str) -> Column:
    """A path without scheme and authority, which listings and scans write differently."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def unreadable_shards(verdicts: DataFrame, out: str) -> DataFrame:
    """Paths below ``out`` of the shard files that :func:`read_shards` leaves out."""
    root = qualified(verdicts.sparkSession, out)
    return verdicts.filter("not good").select(path_below("path", root).alias("path"))


def publish(df: DataFrame, target: str, manifest: bool = False) -> None:
    """Write one combined table per split. An existing target is never replaced.

    With a ``manifest`` the table appears at once or not at all, see :func:`read_published`.
    """
    if not target:
        raise ValueError("name a target to publish to")
    require_schema(df, T.StructType(PLACE[:1]))
    if df.isEmpty():
        raise ValueError("no valid rows to publish")
    if manifest:
        commit_table(df.drop("shard_id"), target, ["split"])
    else:
        df.drop("shard_id").write.mode("errorifexists").partitionBy("split").parquet(target)


def read_published(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All rows of a table that :func:`publish` committed with a manifest; nothing of a try that failed."""
    return read_table(spark, target, T.StructType([*(f for f in schema.fields if f.name != "split"), PLACE[0]]))
