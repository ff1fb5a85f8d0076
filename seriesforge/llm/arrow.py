"""Arrow tasks that add one column and leave the others alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seriesforge.llm import text as tx

_LIST_VALUES = 400_000


def _pieces(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Bounded slices: by bytes for texts, by values for lists."""
    for batch in batches:
        column = batch.column(place)
        if pa.types.is_list(column.type):
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(column), 0)).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(ends.searchsorted(before + _LIST_VALUES, "right")))
                yield batch.slice(start, stop - start)
                start = stop
        else:
            yield from tx.blocks([batch], batch.schema.names[place])


def with_column(df: DataFrame, source: str, out: str, kind: T.DataType, compute: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """`df` with column `out` = compute(column `source`), which runs on bounded Arrow slices."""
    kept = [name for name in df.columns if name != out]
    schema = T.StructType([df.schema[name] for name in kept] + [T.StructField(out, kind)])
    used = df.select(*[f"`{name}`" for name in kept]) if out != source else df
    place = used.columns.index(source)
    places = [used.columns.index(name) for name in kept]

    def run(batches):
        for piece in _pieces(batches, place):
            yield pa.RecordBatch.from_arrays([piece.column(i) for i in places] + [compute(piece.column(place))], [*kept, out])

    return used.mapInArrow(run, schema)
