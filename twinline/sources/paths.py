"""Look at folders through Spark, so that every file system Spark knows works."""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the characters that stay unquoted in the paths Spark reports.
UNQUOTED = "/:=_-!.~'()*,;$&+@"


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, name)`` of the files under ``root``, empty files included; none is opened.

    ``name`` is the first component below ``root``: the file itself, or the
    folder that holds its parts. No match gives no rows.
    """
    paths = _paths(spark, f"{root.rstrip('/')}/{pattern}") or []
    found = spark.createDataFrame([(p,) for p in paths], "path string")
    return found.withColumn("name", name_below("path", qualified(spark, root)))


def _paths(spark: SparkSession, path: str) -> list[str] | None:
    """The files that Spark's own listing holds for a path; None when there is no such path."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def qualified(spark: SparkSession, root: str) -> str:
    """The full URI of a folder, as its file system writes it, without a slash at the end."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(place).toString().rstrip("/")


def name_below(path: str, root: str) -> Column:
    """The first component of a path below ``root``, a full URI."""
    return F.split_part(path_below(path, root), F.lit("/"), F.lit(1))


def path_below(path: str, root: str) -> Column:
    """A path without the folder ``root``, a full URI.

    Listings write ``file:/x`` and scans ``file:///x``, so scheme and authority are
    cut first, then exactly the root's own path.
    """
    below = quote(unquote(urlparse(root).path.rstrip("/")), safe=UNQUOTED) + "/"
    local = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(F.startswith(local, F.lit(below)), F.substr(local, F.lit(len(below) + 1)))


def check_folder(spark: SparkSession, path: str) -> None:
    """Raise when ``path`` is absent, is not a folder, or holds nothing."""
    paths = _paths(spark, path)
    if paths is None:
        raise FileNotFoundError(f"folder {path} not found")
    if not paths:
        raise ValueError(f"folder {path} is empty")
    if urlparse(paths[0]).path == quote(urlparse(qualified(spark, path)).path, safe=UNQUOTED):
        raise NotADirectoryError(f"{path} is not a folder")


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder with at least one file."""
    try:
        check_folder(spark, path)
    except (FileNotFoundError, NotADirectoryError, ValueError):
        return False
    return True
