"""Results per key when a handful of keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_by_key(df: DataFrame, key: str, amount: str, moment: str) -> DataFrame:
    """Rows, sum of ``amount`` and latest ``moment`` for every value of ``key``.

    Every aggregate is algebraic, so Spark combines it on the map side: each task folds its rows into a hash table of at
    most one state per key (spilling to sorted runs when it is full), and only those states are shuffled. A key with a
    third of all rows therefore costs the reducer one row a task, not a third of the data; no salt is needed.

    A null key is a group of its own, as are '' and every other spelling. Null amounts and moments are left out of sum
    and maximum; a key with none but nulls has null. A sum beyond 64 bits is null. An empty table gives no rows.
    """
    total = F.sum(F.col(amount).cast("decimal(19,0)"))
    return df.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        total.try_cast("bigint").alias("sum_amount"),
        F.max(moment).alias("latest"),
    ).withColumnRenamed("key", key)


def heavy_values(df: DataFrame, key: str, one_in: int = 50, usable: Column | None = None) -> DataFrame:
    """Values of ``key`` that hold at least one in ``one_in`` of all rows (null keys count among all rows).

    The total is a scalar subquery over a scan without columns (row counts of the Parquet footers).
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    counted = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    kept = counted.where(F.col("key").isNotNull() if usable is None else usable)
    return kept.where(F.col("n_rows") * one_in >= total).withColumnRenamed("key", key)
