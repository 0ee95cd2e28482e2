"""Small pieces of Arrow batches, so that a Python worker holds few rows as objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 500


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def keep_batches_small(spark) -> None:
    """Rows of whole texts are handed to Python workers a few hundred at a time; the default of 10,000 holds tens of MB a task, twice."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
