"""Inputs for the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.functions.text import make_pairs
from twinline.operators.order import index_rows, prefix_sum, sum_files
from twinline.session import new_path, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn: ``(conv_id, turn, src, tgt)``."""
    said = table(spark, sf_dir, "conversations")
    user = said.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    answer = said.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return user.join(answer, ["conv_id", "turn"])


def numbered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a dense row number: ``(row_idx, conv_id, turn, src, tgt)``."""
    return index_rows(turns(spark, sf_dir), ["conv_id", "turn"])


def numbered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a nested corpus: ``(row_idx, id, translation)``."""
    rows = numbered_turns(spark, sf_dir).withColumn("id", F.col("row_idx").cast("string"))
    return make_pairs(rows).select("row_idx", "id", "translation")


def every(n: int) -> Column:
    """A flag that is set for one in ``n`` turns, used to derive edge cases in place."""
    return (F.col("conv_id") + F.col("turn")) % n == 0


def spaced_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of which some carry Unicode whitespace at their ends."""
    wide = lambda c: F.when(every(3), F.concat(F.lit("　\t\x1c"), F.col(c), F.lit("\x85  \n"))).otherwise(F.col(c))
    return turns(spark, sf_dir).withColumns({"src": wide("src"), "tgt": wide("tgt")})


def with_blanks(df: DataFrame) -> DataFrame:
    """Turns of which some have an empty source, an empty target or no target."""
    return df.withColumns(
        {
            "src": F.when(every(11), F.lit("")).otherwise(F.col("src")),
            "tgt": F.when(every(13), F.lit(None)).when(every(7), F.lit("")).otherwise(F.col("tgt")),
        }
    )


def arrow_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training texts of which some hold further arrows and some hold none: ``(conv_id, turn, text)``."""
    text = (
        F.when(every(5), F.col("tgt"))
        .when(every(3), F.concat("src", F.lit(" => "), "tgt", F.lit(" => "), "src"))
        .when(every(2), F.concat("src", F.lit("=>"), "tgt"))
        .otherwise(F.concat("src", F.lit(" => 　"), "tgt", F.lit("\t")))
    )
    return turns(spark, sf_dir).select("conv_id", "turn", text.alias("text"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents: ``(doc_id, lang, pos, text)``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def numbered_lines(
    spark: SparkSession, sf_dir: str, by: str | None = None, langs: tuple[str, ...] | None = None
) -> DataFrame:
    """All document lines with a row number, per ``by`` when given: ``(row_idx, doc_id, file, text)``.

    Documents get the number of their first line from a prefix sum of their line
    counts, so lines are not sorted; over all documents it follows the layout of their files.
    ``langs`` keeps the documents of some languages.
    """
    docs = table(spark, sf_dir, "documents")
    if langs:
        docs = docs.filter(F.col("lang").isin(*langs))
    file = F.concat_ws(".", "source", "lang").alias("file")
    if by is None:
        rows = sum_files(docs.select("doc_id", file, "text"), F.size(F.split("text", "\n")), "first", ["doc_id"])
        lines = rows.select("first", "doc_id", "file", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        return lines.select((F.col("first") + F.col("pos")).alias("row_idx"), "doc_id", "file", "text")
    counts = docs.select("doc_id", file, F.size(F.split("text", "\n")).alias("n"))
    first = settle(prefix_sum(counts, "doc_id", F.col("n"), "first", by), "first-lines")
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines")).join(first, "doc_id")
    lines = lines.select("first", "doc_id", "file", F.posexplode("lines").alias("pos", "text"))
    return lines.select((F.col("first") + F.col("pos")).alias("row_idx"), "doc_id", "file", "text")


def side_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """English and French lines as the two ragged sides of one file pair per source."""
    lines = numbered_lines(spark, sf_dir, by="file", langs=("en", "fr"))
    parts = F.split("file", "[.]")
    sides = lines.select(
        parts[0].alias("file_pair"), parts[1].alias("lang"), F.col("row_idx").alias("line_no"), "text"
    )
    return tuple(sides.filter(F.col("lang") == lang).drop("lang") for lang in ("en", "fr"))


def line_files(spark: SparkSession, sf_dir: str) -> str:
    """Turns as two pairs of line files, for even and odd conversations; returns their folder.

    Each file is a folder of parts. The rows are range-sorted, so the parts of
    a folder follow each other in row order.
    """
    root = new_path(spark, "lines")
    sides = turns(spark, sf_dir).selectExpr("conv_id", "turn", "stack(2, 'src', src, 'tgt', tgt) as (side, text)")
    name = F.concat(F.when(F.col("conv_id") % 2 == 0, "even.").otherwise("odd."), "side")
    lines = sides.select(name.alias("file"), "conv_id", "turn", F.translate("text", "\r\n", "  ").alias("text"))
    lines.sort("file", "conv_id", "turn").select("file", "text").write.partitionBy("file").text(root)
    return root


def eval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts as references, and without every fifth word as predictions: ``(id, hyp, ref)``."""
    said = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    words = F.filter(F.split("text", " "), lambda w, i: (i + 1) % 5 != 0)
    return said.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.array_join(words, " ").alias("hyp"), F.col("text").alias("ref")
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged steps of runs: ``(run, step, value, ts)``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value", "ts"
    )
