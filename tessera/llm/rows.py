"""Arrow row streams: the one way in which the corpus operators call Python.

``map_rows`` projects the input to the columns that a function reads (so extra or
clashing columns never reach it), streams Arrow batches through it in slices of
bounded size, and yields Arrow batches of the declared schema. A task holds one
slice at a time whatever the size of its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and text bytes of a slice at most (a single longer row is a slice of its own).
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(SLICE_ROWS, SLICE_BYTES // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_rows(frame: DataFrame, columns: list[str], ddl: str, make: Callable[[], Callable[[list], Iterable[tuple]]]) -> DataFrame:
    """Run ``make()`` once per task and its result on every slice.

    The inner function gets one list per column and yields result tuples in the
    order of ``ddl``.
    """
    schema = schema_of(ddl)

    def run(batches):
        arrow = to_arrow_schema(schema)
        work = make()
        for piece in slices(batches):
            out = list(work(*[piece.column(i).to_pylist() for i in range(piece.num_columns)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return frame.select(*columns).mapInArrow(run, schema)
