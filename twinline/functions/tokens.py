"""Token arrays. The default tokenizer is the byte scheme published for ByT5.

Every expression here is built in. Text is cut to its budget before it becomes
an array, so the work per row is bounded by ``max_length``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids of the byte scheme. Byte b has the id b + 3.
PAD, EOS, UNK = 0, 1, 2
BYTE_SHIFT = 3
VOCAB = 259
IGNORE = -100


def token_count(c: Column | str, eos: bool = True) -> Column:
    """Number of tokens, with or without the end mark, without building them."""
    return F.octet_length(_col(c)) + F.lit(1 if eos else 0)


def token_ids(c: Column | str, max_length: int | None = None) -> Column:
    """Ids of the text followed by the end mark, which a cut keeps."""
    raw = F.encode(_col(c), "UTF-8")
    if max_length is not None:
        raw = F.substring(raw, 1, max_length - 1)
    return F.concat(byte_ids(raw), F.array(F.lit(EOS)))


def byte_ids(raw: Column) -> Column:
    """Ids of bytes, without an end mark.

    Reading the bytes as Latin-1 gives one character per byte, so one split
    yields all bytes in linear time.
    """
    ids = F.transform(F.split(F.decode(raw, "ISO-8859-1"), ""), lambda x: F.ascii(x) + F.lit(BYTE_SHIFT))
    return F.when(F.octet_length(raw) == 0, F.array().cast("array<int>")).otherwise(ids)


def _fill(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def pad_fixed(ids: Column | str, m: int, value: int = PAD) -> Column:
    """Fill up to ``m`` ids. Longer rows must have been cut by :func:`token_ids`."""
    return _fill(_col(ids), F.lit(m), value)


def label_pad(ids: Column | str, m: Column | int, value: int = IGNORE) -> Column:
    """Fill labels with the value that the loss ignores."""
    return _fill(_col(ids), F.lit(m) if isinstance(m, int) else m, value)


def attention_mask(ids: Column | str, m: Column | int) -> Column:
    """Ones for real tokens and zeros for the fill up to ``m``. ``ids`` are unpadded."""
    ones = F.array_repeat(F.lit(1), F.size(_col(ids)))
    return _fill(ones, F.lit(m) if isinstance(m, int) else m, 0)


def clamp_ids(ids: Column | str, vocab: int = VOCAB, unk: int = UNK) -> Column:
    """Replace ids outside the vocabulary, which a decoder would fail on."""
    return F.transform(_col(ids), lambda x: F.when((x >= 0) & (x < vocab), x).otherwise(F.lit(unk)))


def unmask_labels(ids: Column | str, pad: int = PAD) -> Column:
    """Replace the ignored value by the pad id."""
    return F.transform(_col(ids), lambda x: F.when(x == IGNORE, F.lit(pad)).otherwise(x))


def decode_ids(ids: Column | str) -> Column:
    """Text of the byte ids, without special ids. A cut character is replaced, not raised on."""
    data = F.filter(_col(ids), lambda x: (x >= BYTE_SHIFT) & (x < VOCAB))
    letters = F.array_join(F.transform(data, lambda x: F.chr(x - BYTE_SHIFT)), "")
    return F.make_valid_utf8(F.encode(letters, "ISO-8859-1").cast("string"))


def nonpad_count(ids: Column | str, fill: int = PAD) -> Column:
    """Number of ids that are not fill."""
    return F.size(F.filter(_col(ids), lambda x: x != fill))


def nonpad_counts(df: DataFrame, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Add the numbers of real input and label tokens."""
    return df.withColumns({"n_input": nonpad_count(ids), "n_label": nonpad_count(labels, IGNORE)})


def roundtrip_audit(df: DataFrame, column: str) -> DataFrame:
    """Count rows and tokens by whether text -> ids -> text gives the text back."""
    same = decode_ids(token_ids(column)) == F.col(column)
    return (
        df.select(same.alias("same"), token_count(column, eos=False).alias("n"))
        .groupBy("same")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"))
    )


def ids_with(
    df: DataFrame, column: str, fn: Callable[[list[str]], list[list[int]]], out: str = "ids"
) -> DataFrame:
    """Add ids from a user's batch tokenizer, and its error in ``<out>_error``; only the text column goes to Python.

    A text the tokenizer fails on gets NULL and the error, so that
    :func:`quarantine` can keep it apart. When it fails on every text of a batch, or
    cannot be loaded, or memory runs out, the tokenizer itself is at fault and the job stops.
    """

    def one(text: str) -> tuple[list[int] | None, str | None]:
        try:
            return list(fn([text])[0]), None
        except (ImportError, MemoryError):
            raise
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    @F.pandas_udf("struct<ids:array<int>,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        given = [t for t in texts if t is not None]
        try:
            found = [(list(ids), None) for ids in fn(given)]
        except (ImportError, MemoryError):
            raise
        except Exception as error:
            found = [one(text) for text in given]
            if len(given) > 1 and all(ids is None for ids, _ in found):
                raise RuntimeError("the tokenizer failed on every text of a batch") from error
        rest = iter(found)
        rows = [next(rest) if t is not None else (None, None) for t in texts]
        return pd.DataFrame(rows, columns=["ids", "error"])

    tokenized = df.withColumn("_tokenized", run(F.col(column)))
    return tokenized.select(*df.columns, F.col("_tokenized.ids").alias(out), F.col("_tokenized.error").alias(f"{out}_error"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
