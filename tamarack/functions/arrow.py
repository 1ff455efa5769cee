"""Rows made from texts in Arrow batches, where a computation is sequential."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of made rows that are held before they are sent on.
SEND = 4 << 20
#: Rows and bytes that cross to Python at once; those of the training-data operators.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of texts, however many and long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def rows_of_texts(df: DataFrame, text_col: str, make: Callable[[str], Iterable[tuple]], schema: str, size_at: int) -> DataFrame:
    """df's other columns with each row that ``make`` gives for the text; none for a null text.

    ``size_at``: the place of the row's longest text, by which rows are sent on.
    """
    short_batches(df.sparkSession)
    rest = [c for c in df.columns if c != text_col]
    made = T.StructType.fromDDL(schema)
    out = T.StructType([*(df.schema[c] for c in rest), *made])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows, held = [], [], 0

            def packed() -> pa.RecordBatch:
                at = pa.array(owners, pa.int64())
                own = [batch.column(c).take(at).cast(kinds.field(c).type) for c in rest]
                fresh = [pa.array([r[k] for r in rows], kinds.field(f.name).type) for k, f in enumerate(made)]
                return pa.RecordBatch.from_arrays([*own, *fresh], schema=kinds)

            for i, text in enumerate(batch.column(text_col).to_pylist()):
                for row in make(text) if text is not None else ():
                    owners.append(i)
                    rows.append(row)
                    held += len(row[size_at])
                    if held >= SEND:
                        yield packed()
                        owners, rows, held = [], [], 0
            if rows:
                yield packed()

    return df.select(*rest, text_col).mapInArrow(run, out)
