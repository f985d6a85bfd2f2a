"""Scan paired line files: line i of ``X.<src>`` belongs to line i of ``X.<tgt>``.

``X.<lang>`` is a text file, or a folder of text parts as Spark writes them; with ``packed``
a packed file may be named ``X.<lang>.gz``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinline.functions.text import strip_text
from twinline.operators.order import index_rows, int_div, part_order
from twinline.operators.pairing import check_even, concat, kept_lines
from twinline.session import settle
from twinline.sources.paths import check_folder, list_files, name_below, qualified


# The endings by which Spark knows packed text, and unpacks it.
ENDINGS = ("gz", "bz2", "deflate", "zst")
PACKED = rf"\.({'|'.join(ENDINGS)})$"


def named(lang: str, packed: bool = False) -> str:
    """The file names of a language."""
    if not packed:
        return f"*.{lang}"
    return "*.{" + ",".join([lang, *(f"{lang}.{ending}" for ending in ENDINGS)]) + "}"


def pair_files(names: DataFrame, src: str, tgt: str, packed: bool = False) -> DataFrame:
    """Zip the source and target names, each in name order: ``(file_pair, src_name, tgt_name)``."""
    plain = F.regexp_replace("name", PACKED, "") if packed else F.col("name")
    side = F.when(F.endswith(plain, F.lit(f".{src}")), "src").when(F.endswith(plain, F.lit(f".{tgt}")), "tgt")
    sides = names.select(side.alias("side"), "name").filter("side is not null").distinct()
    n_src, n_tgt = sides.agg(*[F.count_if(F.col("side") == s) for s in ("src", "tgt")]).first()
    if n_src != n_tgt:
        raise ValueError(f"the numbers of .{src} and .{tgt} files differ: {n_src} and {n_tgt}")
    # All source names come first, so the i-th target name is n_src behind the i-th source name.
    placed = index_rows(sides, ["side", "name"], column="file_pair").withColumn("file_pair", F.col("file_pair") % n_src)
    names_of = [F.max(F.when(F.col("side") == s, F.col("name"))).alias(f"{s}_name") for s in ("src", "tgt")]
    return settle(placed.groupBy("file_pair").agg(*names_of), "file-pairs")


def read_lines(spark: SparkSession, root: str, lang: str, packed: bool = False) -> DataFrame:
    """Lines of all ``.<lang>`` files with the file, the split and the order of reading."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(f"{root.rstrip('/')}/{named(lang, packed)}")
        .select(
            F.col("value").alias("text"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("_seq"),
        )
    )


def count_pairs(lines: DataFrame) -> DataFrame:
    """Number of lines on the source side."""
    return lines.agg(F.count("*").alias("total_pairs"))


@dataclass(frozen=True)
class ParallelText:
    """A folder of paired line files whose lines have been counted.

    ``files`` holds the lines and first row and batch numbers of each file pair,
    ``layout`` the first line number of each file split. Batches are cut inside
    each file, so the last batch of a file may be short.
    """

    spark: SparkSession
    root: str
    src: str
    tgt: str
    batch: int
    files: DataFrame
    layout: DataFrame
    packed: bool = False

    def total_pairs(self) -> DataFrame:
        """Number of source lines, from the counts that are already there."""
        return self.files.agg(F.coalesce(F.sum("n_src"), F.lit(0)).alias("total_pairs"))

    def batch_rows(self) -> DataFrame:
        """``(batch, weight)``: the rows of every batch, from the line counts alone."""
        size = F.least(F.lit(self.batch), F.col("kept") - F.col("i") * self.batch)
        numbers = F.sequence(F.lit(0).cast("long"), int_div(F.col("kept") - 1, self.batch))
        return (
            self.files.filter("kept > 0")
            .select("kept", "batches_before", F.explode(numbers).alias("i"))
            .select((F.col("batches_before") + F.col("i")).alias("batch"), size.cast("long").alias("weight"))
        )

    def pairs(self) -> DataFrame:
        """Stripped pairs ``(file_pair, line_no, row_idx, batch_id, src, tgt)``."""
        src, tgt = (
            self._numbered(lang, self.layout.filter(F.col("side") == side))
            for lang, side in ((self.src, "src"), (self.tgt, "tgt"))
        )
        # Every line that is kept has a partner. Had a file been cut short since it was counted, one would be missing.
        src = src.select("file_pair", "line_no", F.struct("text", "rows_before", "batches_before").alias("_src"))
        both = src.join(tgt.select("file_pair", "line_no", F.struct("text").alias("_tgt")), ["file_pair", "line_no"], "full")
        lost = F.raise_error(F.lit("lines are gone since they were counted")).cast("boolean")
        both = both.filter(F.when(F.col("_src").isNotNull() & F.col("_tgt").isNotNull(), True).otherwise(lost))
        both = both.select("file_pair", "line_no", "_src.rows_before", "_src.batches_before", F.col("_src.text").alias("src"), F.col("_tgt.text").alias("tgt"))
        return both.select(
            "file_pair",
            "line_no",
            (F.col("rows_before") + F.col("line_no")).alias("row_idx"),
            (F.col("batches_before") + int_div("line_no", self.batch)).alias("batch_id"),
            strip_text("src").alias("src"),
            strip_text("tgt").alias("tgt"),
        )

    def verified_pairs(self) -> DataFrame:
        """:meth:`pairs`, written to the shared folder, with every file's lines compared with their count.

        :meth:`pairs` itself stops when a line of one side has lost its partner; here both
        sides may have been cut alike, and a file may be gone.
        """
        pairs = settle(self.pairs(), "pairs")
        read = pairs.groupBy("file_pair").agg(F.count("*").alias("n"))
        short = self.files.filter("kept > 0").join(read, "file_pair", "left").filter("n is null or n <> kept")
        if not short.isEmpty():
            raise ValueError(f"lines are gone since they were counted, for example in {short.first().asDict()}")
        return pairs

    def _numbered(self, lang: str, layout: DataFrame) -> DataFrame:
        """Lines of one side with their line numbers, without those that the ragged rule drops.

        Both passes must split the files alike. Had the splits moved, some position
        would fall outside its split, and the job stops instead of numbering wrongly.
        """
        at = F.col("_seq") - F.col("first_seq")
        moved = F.raise_error(F.lit("file splits moved between the passes; fix spark.sql.files.minPartitionNum"))
        inside = F.col("first_seq").isNotNull() & at.between(0, F.col("n") - 1)
        return (
            read_lines(self.spark, self.root, lang, self.packed)
            .join(layout.drop("side", "name"), ["path", "block"], "left")
            .withColumn("line_no", F.when(inside, F.col("lines_before") + at).otherwise(moved))
            .filter(F.col("line_no") < F.col("kept"))
            .select("file_pair", "line_no", "text", "rows_before", "batches_before")
        )


def open_parallel_text(
    spark: SparkSession,
    root: str,
    src: str = "en",
    tgt: str = "ko",
    ragged: str = "drop_batch",
    batch: int = 32,
    packed: bool = False,
) -> ParallelText:
    """Pair the files and count the lines of every file split.

    From the counts follow, for each split, its first line, row and batch
    number; the reading pass only adds the position inside the split. No rows
    are sorted to number them.
    """
    if src == tgt:
        raise ValueError("the two languages must differ")
    check_folder(spark, root)
    names = concat([list_files(spark, root, named(lang, packed)) for lang in (src, tgt)])
    pairs = pair_files(names, src, tgt, packed)
    if pairs.isEmpty():
        raise ValueError(f"no .{src} and .{tgt} files under {root}")

    sides = F.expr("stack(2, 'src', src_name, 'tgt', tgt_name) as (side, name)")
    splits = settle(concat([_splits(spark, root, src, "src", packed), _splits(spark, root, tgt, "tgt", packed)]), "splits")
    splits = splits.withColumn("name", name_below("path", qualified(spark, root)))
    splits = splits.join(pairs.select("file_pair", sides), ["side", "name"])
    of_side = {side: F.sum(F.when(F.col("side") == side, F.col("n"))) for side in ("src", "tgt")}
    # Pairs of two empty files have no splits and no lines, so nothing is lost without them.
    counts = splits.groupBy("file_pair").agg(of_side["src"].alias("n_src"), of_side["tgt"].alias("n_tgt")).fillna(0)

    # One row per file pair: a file listing, which the driver holds anyway.
    before = W.orderBy("file_pair").rowsBetween(W.unboundedPreceding, -1)
    batches = F.ceil(F.col("kept") / batch)
    files = kept_lines(counts, ragged, batch).withColumns(
        {
            "rows_before": F.coalesce(F.sum("kept").over(before), F.lit(0)),
            "batches_before": F.coalesce(F.sum(batches).over(before), F.lit(0)),
        }
    )
    files = settle(files, "files")
    check_even(files, ragged)
    earlier = W.partitionBy("side", "file_pair").orderBy(part_order("path"), "block")
    earlier = earlier.rowsBetween(W.unboundedPreceding, -1)
    layout = settle(
        splits.join(files.drop("n_src", "n_tgt"), "file_pair").withColumn(
            "lines_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))
        ),
        "layout",
    )
    return ParallelText(spark, root, src, tgt, batch, files, layout, packed)


def read_parallel_text(
    spark: SparkSession,
    root: str,
    src: str = "en",
    tgt: str = "ko",
    ragged: str = "drop_batch",
    batch: int = 32,
    packed: bool = False,
) -> DataFrame:
    """Stripped pairs ``(file_pair, line_no, row_idx, batch_id, src, tgt)`` of a folder of line files."""
    return open_parallel_text(spark, root, src, tgt, ragged, batch, packed).pairs()


def _splits(spark: SparkSession, root: str, lang: str, side: str, packed: bool) -> DataFrame:
    """Lines and first sequence number of every file split of one side."""
    return (
        read_lines(spark, root, lang, packed)
        .groupBy("path", "block")
        .agg(F.count("*").alias("n"), F.min("_seq").alias("first_seq"))
        .withColumn("side", F.lit(side))
    )

