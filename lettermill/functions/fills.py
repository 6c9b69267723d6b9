"""Sequential fills: rows of a writer in order, each placed by what came before it, with constant memory a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A fill's state is a tuple; a step takes it and a size, and gives the next state and the row's values.
Step = Callable[[tuple, int], tuple[tuple, tuple]]


def filled(records: DataFrame, order: str, size: str, writer: str, made: str, start: tuple, step: Step) -> DataFrame:
    """``writer, order, size`` and the columns ``made`` (names and types, all long): a writer's rows in order, step by step.

    A writer's rows are sorted within one partition, which Spark spills where it must; only the state is kept.
    """
    rows = records.select(writer, order, F.col(size).cast("long").alias(size)).repartition(writer).sortWithinPartitions(writer, order)
    fields = T.StructType.fromDDL(made).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, begun = start, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.zeros((batch.num_rows, len(fields)), np.int64)
            for i, (name, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not begun or name != now:
                    state, now, begun = start, name, True
                state, out[i] = step(state, n or 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, k]) for k in range(len(fields)))], [*batch.schema.names, *(f.name for f in fields)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))
