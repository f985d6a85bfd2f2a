"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from labelled texts.
A text is encoded with every dictionary, and the language whose dictionary makes
it smallest is its prediction; the margin to the runner-up is the score, and a
narrow margin rejects the text. A tie goes to the language learnt from more rows.
Letters alone are encoded, in lower case, with single spaces between words.

The dictionaries come from at most ``SAMPLE`` labelled rows per language, those
with the smallest hashes of their keys, and hold at most ``DICTIONARY`` bytes
each: every sampled text gives an equal share, as ``SLICES`` slices spread over the whole of it, so
that no common heading fills a dictionary and few rows fill it as well as many. At most
``LANGUAGES`` languages, the most frequent, are learnt: a bound on labelled rows, ``SAMPLE`` times ``LANGUAGES``. Whole
texts are encoded, in equal blocks of at most ``BLOCK`` bytes that each start from the
dictionary alone, and the sizes of all blocks are added: so a dictionary's share in the
size, and with it the margin, does not shrink with the length of the text.

Rows: a null text, or one without a letter, is ``und`` with score 0 and
rejected; rows with a null language are never learnt from; repeated rows are
predicted each; where nothing can be learnt every text is ``und``.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 128
DICTIONARY = 1 << 16
LANGUAGES = 256
SLICES = 4
LEVEL = 9
BLOCK = 1 << 12
MARGIN = 0.01  # share of the smallest size by which the next must be larger
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def spread(text: str, size: int, slices: int = SLICES) -> str:
    """About ``size`` characters of a text: all of it, or slices at equal distances."""
    if len(text) <= size:
        return text
    each = max(1, size // slices)
    starts = [(len(text) - each) * i // max(1, slices - 1) for i in range(slices)]
    return " ".join(text[a : a + each] for a in starts)[:size]


def fit(
    docs: DataFrame,
    learn: Column,
    lang: str = "lang",
    text: str = "text",
    key: str = "doc_id",
    sample: int = SAMPLE,
    size: int = DICTIONARY,
    languages: int = LANGUAGES,
) -> dict[str, bytes]:
    """Dictionaries by language, the commonest language first, from the rows where ``learn`` holds."""
    rows = docs.filter(learn).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(key, text).alias("hash")
    )
    rows = rows.filter("lang is not null and text is not null and trim(text) <> ''")
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    first = W.partitionBy("lang").orderBy("hash")
    # Only hashes are ranked: at most ``languages`` x ``sample`` of them. The texts are then fetched whole.
    ranked = rows.select("lang", "hash").distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample)
    counted = ranked.groupBy("lang").agg(F.count("*").alias("rows"))
    ranked = ranked.join(F.broadcast(common), "lang").join(F.broadcast(counted), "lang")

    @F.pandas_udf("string")
    def sliced(texts, share):
        return texts.combine(share, lambda x, n: spread(letters(x), int(n)))

    chosen = rows.join(F.broadcast(ranked), ["lang", "hash"]).dropDuplicates(["lang", "hash"])
    chosen = chosen.select("lang", "count", "rank", sliced("text", F.floor(size / F.col("rows"))).alias("text"))
    found = chosen.orderBy(F.desc("count"), "lang", F.desc("rank")).collect()
    by_language: dict[str, list[bytes]] = {}
    for row in found:
        by_language.setdefault(row.lang, []).append(row.text.encode("utf-8", "replace"))
    return {lang: b" ".join(texts)[-size:] for lang, texts in by_language.items()}


def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list:
    made = []
    for _, content in dictionaries:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        made.append(
            zstandard.ZstdCompressor(dict_data=known, level=level, write_checksum=False, write_content_size=False, write_dict_id=False)
        )
    return made


def blocks(content: bytes, block: int = BLOCK) -> list[bytes]:
    """The bytes cut into as few blocks of nearly equal size as ``block`` allows."""
    count = max(1, -(-len(content) // block))
    cuts = [len(content) * i // count for i in range(count + 1)]
    return [content[a:b] for a, b in zip(cuts, cuts[1:])]


def predict(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = LEVEL, margin: float = MARGIN
) -> DataFrame:
    """All rows as ``(_row, lang_pred, score, accepted)``; ``_row`` is the row itself, the score is between 0 and 1."""
    learnt = tuple(dictionaries.items())

    # The compressors are a task's own: a worker outlives its job, and what is kept in it lies beside all later tables.
    @F.pandas_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(learnt, level)
        for texts in batches:
            rows = []
            for x in texts:
                content = letters(x)
                if not compressors or not any(map(str.isalpha, content)):  # signs that count as digits or words are no letters
                    rows.append((UNKNOWN, 0.0, False))
                    continue
                parts = blocks(f" {content} ".encode("utf-8", "replace"))
                sizes = np.array([sum(len(c.compress(part)) for part in parts) for c in compressors], dtype=float)
                best = int(sizes.argmin())
                gap = (np.delete(sizes, best).min() - sizes[best]) / sizes[best] if len(sizes) > 1 else 1.0
                rows.append((learnt[best][0], min(1.0, float(gap)), bool(gap >= margin)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "accepted"])

    scored = docs.select(F.struct("*").alias("_row"), classify(F.col(text).cast("string")).alias("_scored"))
    return scored.select("_row", "_scored.*")
