"""Token counts by a separator scan of flat token files.

A flat token file is nothing but ids, end-of-document ids among them: no index
and no lengths. It is scanned in blocks. Each block is searched for the
separator by one vectorised comparison; a document that runs over block borders
is stitched from a prefix scan over the blocks' lengths, separator counts and
last separators. The scan runs in two levels, chunks of blocks and blocks of a
chunk, so that one very large file is no burden to one task.

Rows: a null text is an empty document of no tokens; null and repeated keys are
kept; ids after a file's last separator are a document that is not ``closed``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinline.llm.bpe import END_OF_TEXT, default_path, encoder
from twinline.session import new_path, settle

BLOCK = 1 << 18  # ids in a block
CHUNK = 1 << 10  # blocks in a chunk
_FLAT = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("ids", pa.binary()), ("first", pa.int64()), ("names", pa.list_(pa.int64()))]
)
_FOUND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])


def _flatten(batches: Iterable[pa.RecordBatch], path: str, block: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), np.array([END_OF_TEXT], "<u2")
    file, written, waiting, held, first = f"{TaskContext.get().partitionId():08d}", 0, [], 0, 0

    def row(block_no, ids, at, names):
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip((file, block_no, ids, at, names), _FLAT)], schema=_FLAT
        )

    for batch in batches:
        names = batch.column(0).to_pylist()
        for text in batch.column(1):
            ids = encode(text.as_py() or "")
            waiting += [ids, end]
            held += len(ids) + 1
            if held >= block:
                stream = np.concatenate(waiting)
                for at in range(0, held - block + 1, block):
                    yield row(written, stream[at : at + block].tobytes(), None, None)
                    written += 1
                waiting = [stream[held - held % block :]]
                held %= block
        yield row(None, None, first, names)
        first += len(names)
    if held:
        yield row(written, np.concatenate(waiting).tobytes(), None, None)


def write_flat(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Tokenize documents into flat token files in the shared folder, one per task, and read them back.

    A file is stored as its blocks ``(file, block, ids)``, little-endian unsigned
    16-bit ids cut without regard to documents. Beside them the table has the keys
    of a file's documents in order, ``(file, first, names)``, and nothing else.
    """
    path, spark = path or default_path(), docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    flat = rows.mapInArrow(
        lambda batches: _flatten(batches, path, block),
        "file string, block long, ids binary, first long, names array<long>",
    )
    target = new_path(spark, "flat")
    flat.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(flat.schema).parquet(target)


def read_files(spark: SparkSession, path: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Blocks of raw token files, shards of at most 2 GB each, whose ids take ``width`` bytes."""

    def cut(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = content.as_buffer().to_pybytes() if content.is_valid else b""
                for number, at in enumerate(range(0, len(view), block * width)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]), pa.array([number]), pa.array([view[at : at + block * width]])],
                        names=["file", "block", "ids"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cut, "file string, block long, ids binary")


def _search(batches: Iterable[pa.RecordBatch], separator: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(x.as_py(), f"<u{width}") for x in batch.column(2)]
        ends = [np.flatnonzero(x == separator) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, _FOUND.field("ends").type)],
            schema=_FOUND,
        )


def _earlier(blocks: DataFrame, how, value: Column, column: str) -> DataFrame:
    """Add ``how`` of ``value`` over a file's earlier blocks, null where there is none."""
    blocks = blocks.withColumn("_value", value)
    chunks = blocks.groupBy("file", "chunk").agg(how("_value").alias("_total"))
    before = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("file", "chunk", how("_total").over(before).alias("_chunks"))
    inside = W.partitionBy("file", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.join(chunks, ["file", "chunk"]).withColumn("_blocks", how("_value").over(inside))
    if how is F.max:
        both = F.greatest("_chunks", "_blocks")
    else:
        both = F.coalesce("_chunks", F.lit(0)) + F.coalesce("_blocks", F.lit(0))
    return blocks.withColumn(column, both).drop("_value", "_chunks", "_blocks")


def scan(blocks: DataFrame, separator: int = END_OF_TEXT, width: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Documents of flat token files: ``(file, ordinal, start, n_tokens, closed)``.

    ``blocks`` is ``(file, block, ids)`` with blocks counted from 0 per file.
    """
    found = settle(
        blocks.select("file", "block", "ids").mapInArrow(
            lambda batches: _search(batches, separator, width), "file string, block long, n long, ends array<long>"
        ),
        "separators",
    )
    rows = found.select(
        "file",
        "block",
        F.floor(F.col("block") / chunk).alias("chunk"),
        "n",
        F.size("ends").cast("long").alias("found"),
        F.try_element_at("ends", F.lit(-1)).alias("last"),
    )
    rows = _earlier(rows, F.sum, F.col("n"), "offset")
    rows = _earlier(rows, F.sum, F.col("found"), "before")
    rows = settle(_earlier(rows, F.max, F.col("offset") + F.col("last"), "carry"), "stitched")
    at = found.filter(F.size("ends") > 0).join(rows.select("file", "block", "offset", "before", "carry"), ["file", "block"])
    start = F.expr(
        "transform(ends, (e, i) -> named_struct('start', IF(i = 0, coalesce(carry + 1, 0), offset + ends[i - 1] + 1), 'end', offset + e))"
    )
    closed = at.select("file", "before", F.posexplode(start).alias("i", "doc")).select(
        "file",
        (F.col("before") + F.col("i")).alias("ordinal"),
        F.col("doc.start").alias("start"),
        (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    files = rows.groupBy("file").agg(
        F.sum("n").alias("size"),
        F.sum("found").alias("ordinal"),
        F.coalesce(F.max(F.col("offset") + F.col("last")) + 1, F.lit(0)).alias("start"),
    )
    rest = files.select(
        "file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.union(rest.filter("n_tokens > 0"))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Tokens of each document, found in the flat files again: ``(<key>, n_tokens, file, ordinal, start)``."""
    flat = write_flat(docs, key, text, path, block)
    names = flat.filter("names is not null").select("file", "first", F.posexplode("names").alias("i", key))
    names = names.select("file", (F.col("first") + F.col("i")).alias("ordinal"), key)
    return scan(flat.filter("ids is not null")).join(names, ["file", "ordinal"]).select(key, "n_tokens", "file", "ordinal", "start")
