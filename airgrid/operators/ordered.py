"""Rows that must be taken in order, one after another, with something carried along.

Spark sorts (and spills); Python sees one Arrow batch at a time and keeps a state of bounded size.
Rows of one key are in one task, as each depends on those before it; ``runs`` cuts keys at silent gaps
first, over range partitions, so that a key with very many rows is spread over tasks wherever its rows
do not depend on each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import settled


def _table(out: list[tuple], schema: T.StructType, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=schema.names)


def walked(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], fields: str, begin: Callable, step: Callable, end: Callable | None = None) -> DataFrame:
    """What ``step`` tells of the rows of each key in order; ``fields``: its columns (DDL).

    ``begin(key)`` makes a state, ``step(state, *columns)`` gives rows (tuples) for one more row and may change the
    state, ``end(state)`` those for the end of the key.
    """
    schema = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    taken = list(dict.fromkeys([*keys, *order, *columns]))
    ready = rows.select(*taken).repartition(*keys).sortWithinPartitions(*keys, *order)

    def work(batches) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: list[tuple] = []
            key_rows = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for key, values in zip(key_rows, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if state is None or key != last:
                    if state is not None and end is not None:
                        out.extend(end(state))
                    last, state = key, begin(*key)
                out.extend(step(state, *values))
            yield _table(out, schema, kinds)
        if state is not None and end is not None:
            yield _table(list(end(state)), schema, kinds)

    return ready.mapInArrow(work, schema)


def runs(rows: DataFrame, key: str, at: str, tie: str, gap: int, name: str = "run") -> DataFrame:
    """``rows`` with ``name``: rows of one key that follow each other within ``gap`` of ``at`` (a number) have the same, the ``tie`` of their first row.

    ``tie`` is unique and a long.  Sorted over range partitions; only the first and last row of each partition are looked at
    together, so a key of any size is cut by many tasks.
    """
    kind = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField(name, T.LongType())])
    ranged = rows.repartitionByRange(key, at, tie).sortWithinPartitions(key, at, tie).withColumn("_part", F.spark_partition_id())

    def work(batches) -> Iterator[pa.RecordBatch]:
        before, run = None, None
        for batch in batches:
            found = []
            for k, t, i in zip(*(batch.column(c).to_pylist() for c in (key, at, tie)), strict=True):
                if before is not None and (k != before[0] or t - before[1] > gap):
                    run = i
                before = (k, t)
                found.append(run)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=kind.names)

    marked = settled(ranged.mapInArrow(work, kind), "runs")
    place = F.struct(key, at, tie)
    edges = marked.groupBy("_part").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max_by(name, place).alias("run")).orderBy("_part").collect()  # one row for each partition
    open_: list[tuple[int, int]] = []
    before, run = None, None
    for e in edges:
        if before is None or e.a[0] != before[0] or e.a[1] - before[1] > gap:
            run = e.a[2]
        open_.append((e["_part"], run))
        run, before = (run if e.run is None else e.run), e.b
    carried = rows.sparkSession.createDataFrame(open_, "_part int, _open long")
    return marked.join(F.broadcast(carried), "_part").withColumn(name, F.coalesce(name, "_open")).drop("_part", "_open")
