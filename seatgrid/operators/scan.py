"""One ordered pass over the rows of bounded groups, for decisions that depend on the ones before them.

Rows are dealt by group, sorted inside the partitions and streamed in Arrow batches through a small Python class that holds only
the current group's state, so no group is gathered. Whoever calls bounds the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_pass(df: DataFrame, group: str, order: Sequence[Column], read: Sequence[str], state: Callable[[], object], answer: str,
                 answer_type: str) -> DataFrame:
    """df with ``answer`` added: ``state()`` is made anew for each group, its ``see(*row)`` gives every row's answer in order.
    ``read`` names the columns that it sees."""
    place = df.columns.index(group)
    seen = [df.columns.index(c) for c in read]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{answer}` {answer_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            out = []
            rows = zip(batch.column(place).to_pylist(), *[batch.column(i).to_pylist() for i in seen], strict=True)
            for g, *row in rows:
                if held is None or g != now:
                    now, held = g, state()
                out.append(held.see(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, answer])

    return df.repartition(F.col(group)).sortWithinPartitions(F.col(group), *order).mapInArrow(run, schema)
