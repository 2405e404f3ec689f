"""Row numbers and group joins that do not put a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimento.session import cut

HOT_ROWS = 200_000
MAX_HOT = 100_000


def hot_keys(rows: DataFrame, keys: list[str], least: int = HOT_ROWS, counted: str | None = None) -> DataFrame | None:
    """keys, parts__: keys with more than `least` rows and into how many parts to cut them; None if there are none.

    With counted, a column, rows already hold one row a key and this many rows stand behind it. Only the MAX_HOT largest
    keys are taken, so the list can be broadcast at any size of the data; as there are at most MAX_HOT keys with more than
    rows / MAX_HOT rows, every key left out has at most max(least, rows / MAX_HOT).
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("n__")) if counted is None else rows.select(*keys, F.col(counted).alias("n__"))
    top = n.where(F.col("n__") > least).orderBy(F.desc("n__"), *keys).limit(MAX_HOT)
    top = top.select(*keys, F.ceil(F.col("n__") / least).cast("int").alias("parts__"))
    found = top.collect()
    return rows.sparkSession.createDataFrame(found, top.schema) if found else None


def salted(rows: DataFrame, hot: DataFrame | None, keys: list[str], row_id: str | Column) -> DataFrame:
    """rows with salt__: 0, but for hot keys a part of the key, chosen by row_id."""
    if hot is None:
        return rows.withColumn("salt__", F.lit(0))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("salt__", F.pmod(F.xxhash64(row_id), F.coalesce("parts__", F.lit(1))).cast("int")).drop("parts__")


def copied(groups: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """groups with salt__: once for each part of its key; keys that aren't hot stay as they are."""
    if hot is None:
        return groups.withColumn("salt__", F.lit(0))
    return groups.join(F.broadcast(hot), keys, "left").withColumn("salt__", F.explode(F.sequence(F.lit(0), F.coalesce("parts__", F.lit(1)) - 1))).drop("parts__")


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with rn (from 1, in the given order inside each group) and n (rows of the group).

    Rows are range-partitioned by group and order, numbered inside their partition, and moved on by the counts of the
    group's earlier partitions: a group of a third of all rows spans many tasks. Without `by` all rows are one group.
    """
    keys = [F.col(c) for c in by]
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("pid__", F.spark_partition_id()))
    g = [*by, "pid__"]
    counts = ranged.groupBy(*g).agg(F.count("*").alias("c__"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("c__").over(w.orderBy("pid__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before__", before).withColumn("n", F.sum("c__").over(w)).select(*[F.col(c).alias(f"{c}__r") for c in g], "before__", "n")
    inside = ranged.withColumn("in__", F.row_number().over(Window.partitionBy(*g).orderBy(*order)))
    on = None
    for c in g:
        same = inside[c].eqNullSafe(counts[f"{c}__r"])
        on = same if on is None else on & same
    return inside.join(counts, on).withColumn("rn", F.col("before__") + F.col("in__")).drop("before__", "in__", "pid__", *[f"{c}__r" for c in g])


def looked_up(rows: DataFrame, values: DataFrame, key: str, row_id: str | Column) -> DataFrame:
    """Left join of rows with values (one row a key): broadcast if they are counted to be few, else hot keys are spread."""
    if values.count() <= MAX_HOT:
        return rows.join(F.broadcast(values), key, "left")
    hot = hot_keys(rows, [key])
    return salted(rows, hot, [key], row_id).join(copied(values, hot, [key]), [key, "salt__"], "left").drop("salt__")


def attach(rows: DataFrame, groups: DataFrame, key: str, row_id: str | Column, least: int = HOT_ROWS, counted: str | None = None) -> DataFrame:
    """Inner join of rows with groups (one row a key); only keys with more than `least` rows are spread over parts.

    With counted, a column of groups, that is how many rows a key has; else they are counted.
    """
    hot = hot_keys(rows if counted is None else groups, [key], least, counted)
    groups = groups.drop(counted) if counted else groups
    return salted(rows, hot, [key], row_id).join(copied(groups, hot, [key]), [key, "salt__"]).drop("salt__")
