"""Running sums over rows in a global order, worked out in many tasks at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobfacts.llm.common import mapped, written

PART, AMOUNT, GROUP, LOCAL = "running part", "running amount", "running group", "running before"


def _segments(batch: pa.RecordBatch, held: tuple | None) -> np.ndarray:
    """Where a new group begins; `held` is the group of the row before the batch."""
    column = batch.column(batch.schema.get_field_index(GROUP))
    codes = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[0] = held is None or held[0] != column[0].as_py()
    return new


def running_sums(rows: DataFrame, group: Column, order: list[Column], amount: Column, modulus: int) -> DataFrame:
    """`rows` with before: the sum of `amount` over the earlier rows of the row's group, modulo `modulus`.

    `order` orders all rows and must keep a group together; amounts are whole numbers from 0 to 4 * modulus, a modulus
    is at most 2^40. Ranges of the order are summed in a task each, and the sums of the ranges before are added after;
    a group that holds most rows is just many ranges. Rows equal in the whole order are one range. Null is a group of
    its own. The rows are written once, sorted.
    """
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carry = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _segments(batch, held)
            amounts = batch.column(batch.schema.get_field_index(AMOUNT)).to_numpy()
            until = np.cumsum(amounts) - amounts
            starts = np.flatnonzero(new)
            base = np.full(len(new), -carry)  # up to the first new group what was carried over goes on
            if len(starts):
                base[starts[0] :] = np.repeat(until[starts], np.diff(np.append(starts, len(new))))
            before = (until - base) % modulus
            held = (batch.column(batch.schema.get_field_index(GROUP))[-1].as_py(),)
            carry = int(before[-1] + amounts[-1]) % modulus
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, LOCAL])

    marked = rows.withColumns({GROUP: group, AMOUNT: amount.cast("long")})
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField(LOCAL, T.LongType())])
    local = written(mapped(dealt, run, schema), "running")
    sums = local.groupBy(PART, GROUP).agg((F.sum(F.col(AMOUNT).cast("decimal(38,0)")) % modulus).cast("long").alias("sum"))
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col(PART).alias("to part"), F.col(GROUP).alias("to group"), F.coalesce(F.sum("sum").over(earlier) % modulus, F.lit(0)).alias("offset")
    )
    same = (F.col(PART) == F.col("to part")) & F.col(GROUP).eqNullSafe(F.col("to group"))
    return local.join(sums, same).select(*kept, ((F.col(LOCAL) + F.col("offset")) % modulus).alias("before"))
