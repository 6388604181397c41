"""Ranks and running sums over all rows of a table, without one task that holds them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from codeatlas.plans.lineage import saved


def running_sum(rows: DataFrame, value: Column, *order: Column, out: str = "total") -> DataFrame:
    """The sum of ``value`` (nulls count nothing) over each row and all before it in order.

    Rows are dealt in ranges of the order and written once, so that a range's number is data and
    not taken anew by a lost task; each range sums its own, and one row a range says what lies
    before it. The order should be unique: rows that are equal in it get sums in any order."""
    dealt = rows.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(*order)
    dealt = saved(dealt.withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    # one row a range
    before = ranges.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_own", F.sum("_value").over(within))
    kind = summed.schema["_own"].dataType
    return summed.join(F.broadcast(before), "_range").withColumn(out, (F.col("_before") + F.col("_own")).cast(kind)).drop("_value", "_range", "_own", "_before")


def rank(rows: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """0-based places in order, as long."""
    return running_sum(rows, F.lit(1), *order, out=out).withColumn(out, F.col(out) - 1)


_STEPS = ArrayType(StructType([StructField(x, DoubleType()) for x in ("unit", "even", "odd")]))


def _steps(v: np.ndarray, start: float, off: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What adding ``v`` in order does to a sum that is within ``off`` of ``start``, and so on to the end:
    steps (unit, even, odd). While a sum stays between two powers of two it is a whole number of
    units, and each value adds a whole number of them: that next to it, or where it ends in a half, that
    which makes the sum even. So such a run adds ``even`` or ``odd`` units, as the sum was before.
    Values next to a power of two stay as they are, with unit 0."""
    near = start + np.concatenate([[0.0], np.cumsum(v)])
    (low, power), high = np.frexp(np.abs(near) - off), np.frexp(np.abs(near) + off)[1]
    side = np.where((low > 0) & (power == high) & (power > -900) & (power < 1000), np.where(near < 0, -1, 1), 0)
    inside = (side[1:] != 0) & (side[1:] == side[:-1]) & (power[1:] == power[:-1])
    cuts = np.concatenate([[0], np.flatnonzero(~inside[1:] | ~inside[:-1]) + 1, [len(v)]])
    unit, even, odd = np.zeros(len(cuts) - 1), v[cuts[:-1]].copy(), v[cuts[:-1]].copy()
    for i in np.flatnonzero(inside[cuts[:-1]]):
        a, b = cuts[i], cuts[i + 1]
        unit[i] = 2.0 ** (int(power[a]) - 53)
        q = v[a:b] / unit[i]
        half = np.flatnonzero(np.abs(q - np.trunc(q)) == 0.5)
        whole = np.rint(q)
        whole[half] = np.floor(q[half])
        total = np.cumsum(whole.astype(np.int64))
        at = total[half]
        up = int((np.diff(at) & 1).sum())  # after a half the sum is even
        even[i], odd[i] = (total[-1] + up + (int(at[0] + was) & 1 if len(half) else 0) for was in (0, 1))
    return unit, even, odd


def sum_in_order(rows: DataFrame, key: str, order: list[str], value: str, out: str = "total", size: int = 1 << 14) -> DataFrame:
    """Doubles of each key added one by one in order, to the last digit: (key, out). The last of ``order``
    is a whole number that few rows of a key share, as a row's place in its file. Each ``size`` of them are
    a range; ranges answer beside each other what they add to the sum about where they start, and a
    key's answers, a few numbers a range, are put together in order."""
    ranges = [*order[:-1], "_range"]
    rows = rows.where(F.col(value).isNotNull()).select(key, *order, F.floor(F.col(order[-1]) / size).alias("_range"), F.col(value).alias("_v"))
    parts = rows.groupBy(key, *ranges).agg(F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.sum(F.abs("_v")).alias("_size"))
    w = Window.partitionBy(key).orderBy(*ranges)  # one row a range
    start, upto = F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), w.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select(key, *ranges, F.coalesce(start, F.lit(0.0)).alias("_start"), (F.sum("_n").over(upto) * F.sum("_size").over(upto) * 2.0**-51).alias("_off"))
    parts = parts.toDF(*parts.columns)  # columns of their own, not those of the rows
    number = order[-1]

    def answer(some: pa.Table, part: pa.Table) -> pa.Table:
        v = some.sort_by([(number, "ascending"), ("_v", "ascending")])["_v"].to_numpy()
        found = [pa.array(x) for x in _steps(v, part["_start"][0].as_py(), part["_off"][0].as_py())]
        steps = pa.StructArray.from_arrays(found, ["unit", "even", "odd"])
        return part.drop_columns(["_start", "_off"]).append_column("_steps", pa.ListArray.from_arrays(pa.array([0, len(steps)], pa.int32()), steps))

    schema = rows.select(key, *ranges).schema.add("_steps", _STEPS)
    steps = rows.groupBy(key, *ranges).cogroup(parts.groupBy(key, *ranges)).applyInArrow(answer, schema)
    in_order = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*ranges, "_steps"))), lambda p: p["_steps"]))

    def add(sofar, step):
        units = sofar / step["unit"]
        return F.when(step["unit"] == 0, sofar + step["even"]).otherwise((units + F.when(F.abs(units) % 2 == 0, step["even"]).otherwise(step["odd"])) * step["unit"])

    return steps.groupBy(key).agg(F.aggregate(in_order, F.lit(0.0), add).alias(out))
