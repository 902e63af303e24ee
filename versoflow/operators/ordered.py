"""Order-dependent operators that stay parallel when one document holds a large share of all rows.

A document's rows are cut into blocks of consecutive positions. Windows run inside blocks; one small row a block
carries what passes from block to block (its sum, its last value, its last rows), and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block.
BLOCK = 4096


def _blocked(df: DataFrame, position: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.coalesce(F.col(position), F.lit(0)) / block))


def forward_fill(df: DataFrame, key: str, position: str, values: list[str], tie: list[str] = [], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """``values`` replaced by the last non-null value at or before each row; null before the first."""
    df = _blocked(df, position, block)
    order = [F.col(position), *[F.col(t) for t in tie]]
    upto = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.select("*", *[F.last(v, ignorenulls=True).over(upto).alias(f"__in_{v}") for v in values])
    # the last non-null value of each block: the greatest position that has one
    best = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"__at_{v}") for v in values]
    ends = df.groupBy(key, "__block").agg(*best)
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), *[F.last(f"__at_{v}", ignorenulls=True).over(before).alias(f"__from_{v}") for v in values])
    joined = inside.join(carried, inside[key].eqNullSafe(carried["__k"]) & (inside["__block"] == carried["__b"]), "left")
    rest = [c for c in df.columns if c not in values and c != "__block"]
    return joined.select(*[joined[c] for c in rest], *[F.coalesce(f"__in_{v}", f"__from_{v}").alias(v) for v in values])


def running_sum(df: DataFrame, key: str, position: str, value: Column, name: str, tie: list[str] = [], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """``name``: sum of the values of a document's rows up to and with each row. Null values count nothing."""
    df = _blocked(df.withColumn("__v", F.coalesce(value, F.lit(0))), position, block)
    upto = Window.partitionBy(key, "__block").orderBy(position, *tie).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumn("__in", F.sum("__v").over(upto))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "__block").agg(F.sum("__v").alias("__t"))
    carried = totals.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__from"))
    joined = inside.join(carried, inside[key].eqNullSafe(carried["__k"]) & (inside["__block"] == carried["__b"]), "left")
    return joined.withColumn(name, F.col("__in") + F.col("__from")).drop("__v", "__in", "__from", "__k", "__b", "__block")


def row_numbers(df: DataFrame, key: str, position: str, name: str, tie: list[str] = [], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """``name``: place of each row within its document, from 1."""
    return running_sum(df, key, position, F.lit(1).cast("bigint"), name, tie, block)


def preceding(df: DataFrame, key: str, position: str, value: Column, n: int, name: str, tie: list[str] = [], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """``name``: array of the values of up to n rows before each row, oldest first (nulls are kept as nulls).

    Each block is given the last n rows before it as a halo, so that windows need not cross blocks.
    """
    df = _blocked(df.withColumn("__v", F.struct(value.alias("v"))), position, block)
    order = [F.col(position), *[F.col(t) for t in tie]]
    rank = F.row_number().over(Window.partitionBy(key, "__block").orderBy(*[c.desc() for c in order]))
    tails = df.select(F.col(key), "__block", F.col(position), *tie, "__v").withColumn("__r", rank).where(F.col("__r") <= n)
    tails = tails.groupBy(key, "__block").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("__v")))).alias("__rows"))
    # what comes over: the last n rows of the n blocks before, since a block may have fewer rows than n
    over = Window.partitionBy(key).orderBy("__block").rowsBetween(-n, -1)
    gathered = F.flatten(F.collect_list("__rows").over(over))
    kept = F.slice(gathered, F.greatest(F.lit(1), F.size(gathered) - n + 1), F.lit(n))
    halo = tails.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), F.transform(kept, lambda r: r["__v"]).alias("__halo"))
    inside = F.collect_list("__v").over(Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(-n, -1))
    joined = df.withColumn("__in", inside)
    joined = joined.join(halo, joined[key].eqNullSafe(halo["__k"]) & (joined["__block"] == halo["__b"]), "left")
    both = F.concat(F.coalesce("__halo", F.array().cast(joined.schema["__in"].dataType)), F.col("__in"))
    last = F.slice(both, F.greatest(F.lit(1), F.size(both) - n + 1), F.lit(n))
    return joined.withColumn(name, F.transform(last, lambda r: r["v"])).drop("__v", "__in", "__halo", "__k", "__b", "__block")
