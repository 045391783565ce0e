"""Running values over the order of a whole table, or of groups of any size, without one window over all rows.

``in_ranges`` deals the rows to ranges of the order and writes them. Windows then run inside each range, and one row for
each range brings in what the ranges before it add: as many rows as there are shuffle partitions, so they are broadcast.
A group that fills many ranges is split like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragbench.sources.shared import written

#: The number of a row's range; ranges ascend in the order.
RANGE = "range_no"


def in_ranges(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows, written, with the number of their range. Nulls come first; equal rows of the order lie in one range."""
    return written(rows.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), name)


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Rows of ``in_ranges`` with, by name, the sum over the rows of the group up to and with this one.

    The group's columns must be the first of the order, and the order must leave no ties whose places matter. A sum
    over nothing but nulls is null, as in a window of Spark.
    """
    group = group or []
    key = F.struct(*group) if group else F.lit(0)
    inside = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(RANGE).agg(F.min(key).alias("first_group"), F.max(key).alias("last_group"))
    last = rows.join(F.broadcast(ends), RANGE).where(key.eqNullSafe(F.col("last_group")))
    totals = last.groupBy(RANGE).agg(F.first("last_group").alias("of"), *(F.sum(v).alias(f"total_{n}") for n, v in sums.items()))
    asked = ends.select(RANGE, F.col("first_group").alias("of"), *(F.lit(None).cast(totals.schema[f"total_{n}"].dataType).alias(f"total_{n}") for n in sums), F.lit(True).alias("asks"))
    before = Window.partitionBy("of").orderBy(RANGE).rangeBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("asks", F.lit(False)).unionByName(asked).select(RANGE, "of", "asks", *(F.sum(f"total_{n}").over(before).alias(f"carry_{n}") for n in sums)).where("asks").drop("asks")
    own = rows.withColumns({f"own_{n}": F.sum(v).over(inside) for n, v in sums.items()})
    met = own.join(F.broadcast(carried.withColumnRenamed(RANGE, "carry_range")), (F.col(RANGE) == F.col("carry_range")) & key.eqNullSafe(F.col("of")), "left")
    value = lambda n: F.coalesce(F.col(f"own_{n}") + F.col(f"carry_{n}"), F.col(f"own_{n}"), F.col(f"carry_{n}"))
    return met.select(*rows.columns, *(value(n).alias(n) for n in sums))


def last_values(rows: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows of ``in_ranges`` with, by name, the last value that isn't null among the rows up to and with this one."""
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"own_{n}": F.last(v, ignorenulls=True).over(inside) for n, v in values.items()})
    place = F.struct(*order)
    ends = rows.groupBy(RANGE).agg(*(F.max_by(F.struct(v.alias("v")), F.when(v.isNotNull(), place)).alias(f"end_{n}") for n, v in values.items()))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(RANGE).alias("carry_range"), *(F.last(f"end_{n}", ignorenulls=True).over(before).getField("v").alias(f"carry_{n}") for n in values))
    met = own.join(F.broadcast(carried), F.col(RANGE) == F.col("carry_range"), "left")
    return met.select(*rows.columns, *(F.coalesce(f"own_{n}", f"carry_{n}").alias(n) for n in values))


def next_values(rows: DataFrame, order: list[str], group: list[str], values: list[str], prefix: str = "next_") -> DataFrame:
    """Rows of ``in_ranges`` with the values of the next row of their group (null after its last row).

    Group and values are columns of the order, which has no ties.
    """
    inside = Window.partitionBy(RANGE).orderBy(*order)
    place = F.struct(*order)
    firsts = rows.groupBy(RANGE).agg(F.min(place).alias("first_row")).select(F.col(RANGE).alias("carry_range"), F.lead("first_row").over(Window.orderBy(RANGE)).alias("beyond"))
    met = rows.withColumn("follows", F.lead(place).over(inside)).join(F.broadcast(firsts), F.col(RANGE) == F.col("carry_range"), "left").withColumn("after", F.coalesce("follows", "beyond"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col("after").getField(g))
    return met.select(*rows.columns, *(F.when(same, F.col("after").getField(v)).alias(f"{prefix}{v}") for v in values))
