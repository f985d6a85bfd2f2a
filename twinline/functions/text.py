"""Column functions on text. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The texts the templates put around a sentence.
TASK_PREFIX = "translate {src} to {tgt}: "
SFT_HEAD = "Translate {src} to {tgt}: "
ARROW = " => "
BARE_ARROW = "=>"


def strip_text(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends. Plain ``trim`` removes only U+0020."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def make_pairs(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Replace two text columns by one ``translation`` struct."""
    pair = F.struct(F.col(src).alias("src"), F.col(tgt).alias("tgt"))
    return df.withColumn("translation", pair).drop(*({src, tgt} - {"translation"}))


def split_sides(df: DataFrame) -> DataFrame:
    """Replace the ``translation`` struct by two text columns."""
    return df.withColumns(
        {"src": F.col("translation.src"), "tgt": F.col("translation.tgt")}
    ).drop("translation")


def prompt_prefix(c: Column | str, src_name: str = "English", tgt_name: str = "Korean") -> Column:
    """Put the task sentence in front of the source text."""
    return F.concat(F.lit(TASK_PREFIX.format(src=src_name, tgt=tgt_name)), _col(c))


def sft_text(
    src: Column | str, tgt: Column | str, src_name: str = "English", tgt_name: str = "Korean"
) -> Column:
    """One training text holding the task, the source and the answer."""
    return F.concat(F.lit(SFT_HEAD.format(src=src_name, tgt=tgt_name)), _col(src), F.lit(ARROW), _col(tgt))


def blank_answer(c: Column | str, sep: str = ARROW) -> Column:
    """Cut everything after the first separator and leave an empty answer line."""
    return F.concat(F.substring_index(_col(c), sep, 1), F.lit(sep + "\n"))


def extract_reference(c: Column | str, sep: str = BARE_ARROW) -> Column:
    """The stripped piece between the first and second separator; NULL when there is none."""
    c = _col(c)
    return F.when(F.contains(c, F.lit(sep)), strip_text(F.split_part(c, F.lit(sep), F.lit(2))))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
