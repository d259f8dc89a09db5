"""Joins on keys of which a few may hold most rows: hot keys are cut into a grid of cells."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys are counted by hash bucket, so that the table of counts never has more rows than this.
BUCKETS = 1 << 16
#: Rows of either side that one cell should hold.
CELL = 20_000
#: Rows that one task should sort at once.
ROWS = 100_000


def grid_sides(left: DataFrame, right: DataFrame, on: list[str], spread: tuple[str, str], cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join with _row_cell and _col_cell to join on as well.

    A bucket with l rows on the left and r on the right becomes ceil(l / cell) x ceil(r / cell) cells. A
    left row goes to one row of cells, drawn from its column ``spread[0]``, and stands in each of that row's
    cells; right rows likewise by columns of cells. Every pair of rows meets in exactly one cell, no cell
    depends on how large its key is, and rows whose bucket is empty on the other side go before the
    shuffle. At most BUCKETS rows of counts are broadcast.
    """
    bucket = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int"))
    left, right = bucket(left), bucket(right)
    counts = left.groupBy("_bucket").agg(F.count("*").alias("_l")).join(right.groupBy("_bucket").agg(F.count("*").alias("_r")), "_bucket")
    shape = F.broadcast(counts.select("_bucket", F.ceil(F.col("_l") / cell).cast("int").alias("_rows"), F.ceil(F.col("_r") / cell).cast("int").alias("_cols")))
    own = lambda col, n: F.pmod(F.xxhash64(F.col(col), F.lit(31)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(shape, "_bucket").withColumn("_row_cell", own(spread[0], "_rows")).withColumn("_col_cell", every("_cols"))
    b = right.join(shape, "_bucket").withColumn("_col_cell", own(spread[1], "_cols")).withColumn("_row_cell", every("_rows"))
    return a.drop("_bucket", "_rows", "_cols"), b.drop("_bucket", "_rows", "_cols")


def grid_join(left: DataFrame, right: DataFrame, on: list[str], spread: tuple[str, str], cell: int = CELL) -> DataFrame:
    """Inner equi-join on ``on`` by ``grid_sides``; the result doesn't depend on ``cell``.

    Neither side goes through the driver: their rows are many more than Spark makes out from the tables they come from.
    """
    a, b = grid_sides(left, right, on, spread, cell)
    return a.hint("merge").join(b, [*on, "_row_cell", "_col_cell"]).drop("_row_cell", "_col_cell")


def met_sides(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without rows whose keys' hash bucket is empty on the other side; at most BUCKETS rows are broadcast."""
    bucket = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int"))
    left, right = bucket(left), bucket(right)
    seen = F.broadcast(left.select("_bucket").distinct().join(right.select("_bucket").distinct(), "_bucket"))
    return left.join(seen, "_bucket").drop("_bucket"), right.join(seen, "_bucket").drop("_bucket")


def dealt(df: DataFrame, rows: int, *on: str | Column) -> DataFrame:
    """Rows by key in as many partitions as ``rows`` of them need, so that a task's share doesn't grow with the input.

    Repetitive rows shrink much when they are shuffled, so that partitions merged by their shuffled size
    hold far more once sorted.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / ROWS)), *on)
