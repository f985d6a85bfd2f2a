"""The mteval 13a word tokenizer as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinline.functions.text import WHITESPACE

# Plain replacements, then pattern replacements, both in this order.
REPLACEMENTS = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
PATTERNS = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def words_13a(c: Column) -> Column:
    """Array of words; empty for empty text."""
    for old, new in REPLACEMENTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, new in PATTERNS:
        c = F.regexp_replace(c, pattern, new)
    return F.filter(F.split(c, f"[{WHITESPACE}]+"), lambda w: w != "")
