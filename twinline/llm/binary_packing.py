"""Packing by power-of-two decomposition.

Each document's ids, with one end id, are cut into whole sequences of the
longest length and then into the binary parts of the rest, longest first. Every
piece is a sequence of its own, so no sequence crosses documents and none needs
padding; sequences of equal length share a bucket and can be batched together.

Rows: a null text is an empty one and gives its end id alone; a null key is
kept; repeated rows are packed each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.llm.bpe import default_path, encoder

LONGEST = 2048
END_ID = 1
SLICE = 1 << 20  # ids gathered before a batch of pieces is passed on
_PIECES = pa.schema(
    [
        ("key", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
    ]
)


def decompose(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that sum to ``n``, longest first, none above ``longest``."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def _pieces(batches: Iterable[pa.RecordBatch], path: str, longest: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, special=True)
    for batch in batches:
        columns, held = [[] for _ in _PIECES], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(encode(text.as_py() or "").astype("<u4"), np.uint32(end_id))
            start = 0
            for length in decompose(len(ids), longest):
                row = key, start, length, ids[start : start + length].tobytes(), len(ids)
                for column, value in zip(columns, row):
                    column.append(value)
                start += length
            held += len(ids)
            if held >= SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)
                columns, held = [[] for _ in _PIECES], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    longest: int = LONGEST,
    end_id: int = END_ID,
) -> DataFrame:
    """Sequences ``(<key>, start, length, ids, doc_tokens, sequence_id, offset, bucket)``; bucket b holds those of 2 ** b ids.

    ``ids`` holds little-endian unsigned 32-bit ids. ``path`` is the vocabulary
    file, the installed public one by default. The rows come straight from the
    scan, so ``sequence_id``, a number per task and row, is the same again when
    a lost task is repeated.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    path = path or default_path()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    pieces = rows.mapInArrow(
        lambda batches: _pieces(batches, path, longest, end_id),
        "key long, start long, length long, ids binary, doc_tokens long",
    )
    return pieces.select(
        F.col("key").alias(key),
        "start",
        "length",
        "ids",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.round(F.log2("length")).cast("int").alias("bucket"),
    )


def ids_crc32() -> Column:
    return F.crc32("ids").cast("long")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences to one folder per bucket, ready for batches without padding."""
    pieces.write.partitionBy("bucket").parquet(path)
