"""A user's own code over batches of rows, with a declared result."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Rows = dict[str, list]

ERROR, INPUT = "_error", "_input"


def tokenize_with(
    df: DataFrame, fn: Callable[[Rows], Rows], schema: T.StructType | str, columns: Sequence[str] | None = None, batch: int = 1000
) -> DataFrame:
    """Rows that ``fn`` makes of the rows of ``df``, and the rows that it fails on.

    ``fn`` takes lists by column name, of at most ``batch`` rows, and returns lists by
    the names of ``schema``, of any one length: rows may be dropped or added. What it
    makes of a row must not depend on the other rows of the batch. Only ``columns``, by
    default all, go to it.

    A batch that it fails on, or whose result does not have the declared columns and
    types, is halved until the failing rows stand alone. Such a row has NULL in all
    columns of ``schema``, its error in ``_error`` and itself in ``_input``; see :func:`made`
    and :func:`failed`. So the result does not depend on how rows fall into batches. When
    code cannot be loaded or memory runs out, the job stops.
    """
    given = df.select(*(columns or df.columns))
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    clash = {ERROR, INPUT} & set(declared.names)
    if clash:
        raise ValueError(f"{sorted(clash)} are names of this function's own columns")
    out = T.StructType([*declared, T.StructField(ERROR, T.StringType()), T.StructField(INPUT, given.schema)])
    arrow = to_arrow_schema(out)
    names = declared.names

    def called(rows: pa.RecordBatch) -> pa.RecordBatch:
        result = fn(rows.to_pydict())
        if set(result) != set(names):
            raise ValueError(f"columns {sorted(result)} instead of {sorted(names)}")
        lengths = {len(result[name]) for name in names}
        if len(lengths) > 1:
            raise ValueError("columns of different lengths")
        n = lengths.pop() if lengths else 0
        columns = [pa.array(list(result[name]), arrow.field(name).type) for name in names]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.string()), pa.nulls(n, arrow.field(INPUT).type)], schema=arrow)

    def halved(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        waiting = [rows]
        while waiting:
            part = waiting.pop()
            try:
                yield called(part)
            except (ImportError, MemoryError):
                raise
            except Exception as error:
                if part.num_rows == 1:
                    said = f"{type(error).__name__}: {error}"
                    own = pa.array(part.to_pylist(), arrow.field(INPUT).type)
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, arrow.field(n).type) for n in names), pa.array([said]), own], schema=arrow)
                else:
                    middle = part.num_rows // 2
                    waiting += [part.slice(middle), part.slice(0, middle)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                yield from halved(rows.slice(at, batch))

    return given.mapInArrow(run, out)


def made(mapped: DataFrame) -> DataFrame:
    """The rows that the user's code made."""
    return mapped.filter(F.col(ERROR).isNull()).drop(ERROR, INPUT)


def failed(mapped: DataFrame) -> DataFrame:
    """The rows it failed on, with ``error``."""
    return mapped.filter(F.col(ERROR).isNotNull()).select(f"{INPUT}.*", F.col(ERROR).alias("error"))
