"""Deduplication and membership with a defined survivor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.session import small, written


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Of rows with equal keys, the first in order; keys are hashed into the shuffle as they are, NULL being a key of its own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_ignore(existing: DataFrame, new: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Rows of ``new`` that an insert-ignore would add: first of each key, key not in ``existing``."""
    have = existing.select(key.alias("_k")).distinct()
    return first_wins(new, [key], order).withColumn("_k", key).join(have, "_k", "left_anti").drop("_k")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Existing rows, replaced by the last new row of the same key; other new rows are added."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(first_wins(new, [F.col(key)], order))


def overlap_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(n): distinct keys that stand on both sides."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def lookup(keys: DataFrame, stored: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Rows of several tables by (table_name, id), in one join for each table; columns a table lacks are NULL.

    Only tables of ``stored`` may be named: another name is an error. Repeated keys give one row, unknown ids none.
    """
    wanted = written(keys.select("table_name", id_col).distinct())
    unknown = wanted.where(~F.col("table_name").isin(*stored) | F.col("table_name").isNull()).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown table {unknown[0]['table_name']!r}")
    parts = []
    for name, rows in stored.items():
        mine = wanted.where(F.col("table_name") == name).select(id_col)
        parts.append(rows.join(small(mine), id_col, "left_semi").withColumn("table_name", F.lit(name)))
    return union_all(parts)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of the frames; a column that a frame lacks is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
