"""Many small ordered groups in few Arrow batches.

applyInPandas pays for a frame with every group. Here rows are sorted inside partitions and
a whole batch is cut into groups by numpy; a group that spans batches is carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_groups(df: DataFrame, group: list[str], order: list[str], fn: Callable[[tuple, dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """fn(group values, columns as arrays in the given order) -> rows of schema, for each
    group. All columns of df must be free of nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = df.columns
    target = to_arrow_schema(StructType.fromDDL(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def cut(whole: pa.Table, last: bool) -> tuple[list[tuple], pa.Table | None]:
            columns = {n: whole.column(n).to_numpy(zero_copy_only=False) for n in names}
            n = whole.num_rows
            change = np.zeros(max(n - 1, 0), bool)
            for g in group:
                change |= columns[g][1:] != columns[g][:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
            stop = len(starts) - 1 if last else len(starts) - 2
            out: list[tuple] = []
            for a, b in zip(starts[:stop].tolist(), starts[1 : stop + 1].tolist()):
                out += fn(tuple(columns[g][a] for g in group), {k: v[a:b] for k, v in columns.items()})
            return out, None if last else whole.slice(int(starts[-2]))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows, rest = cut(pa.concat_tables(held), False)
            held = [rest]
            if rows:
                yield table(rows)
        if held:
            rows, _ = cut(pa.concat_tables(held), True)
            if rows:
                yield table(rows)

    # A number of partitions keeps adaptive execution from gathering costly rows in few tasks.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
