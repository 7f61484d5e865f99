"""Ordered operators: latest per key, runs, pages and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The last row of each key by ``order``."""
    return last_n(rows, keys, 1, *order).drop("place")


def last_n(rows: DataFrame, keys: list[str], n: int, *order: str | Column) -> DataFrame:
    """The last ``n`` rows of each key, newest first (``place`` from 1)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def gap_runs(rows: DataFrame, keys: list[str], *, time: str, tie: str, member: Column, gap: int) -> DataFrame:
    """``rows`` with ``run``: a new one starts where more than ``gap`` passed since the row before, or after a row that is no member."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    before = F.lag(F.struct(F.col(time).alias("t"), member.alias("m"))).over(w)
    fresh = before.isNull() | (F.col(time) - before["t"] > gap) | ~before["m"]
    return rows.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def closed_runs(rows: DataFrame, keys: list[str], *, time: str, tie: str, member: Column, closer: Column, gap: int) -> DataFrame:
    """Runs of members that a closing row ends: keys, closing_id, members, first and last member.

    Any row that is no member ends a run; a gap before it, too. Only a closing row emits it, if it has members.
    """
    runs = gap_runs(rows, keys, time=time, tie=tie, member=member, gap=gap)
    ended = runs.groupBy(*keys, "run").agg(
        F.max(F.when(~member & closer, F.col("id"))).alias("closing_id"), F.count_if(member).alias("members"),
        F.min(F.when(member, F.col("id"))).alias("first_id"), F.max(F.when(member, F.col("id"))).alias("last_id"),
    )
    return ended.filter("closing_id IS NOT NULL AND members > 0").drop("run")


def tied(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keys whose rows can't be ordered: several of them without distinct ``seq``."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(seq).alias("distinct"))
    return found.filter("n > 1 AND distinct < n")


def adjacent_pairs(rows: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    """Neighbours with equal ``key`` taken two at a time: (group, key, batch, first, second or null)."""
    w = Window.partitionBy(*group).orderBy(order)
    changed = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("_run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*group, "_run").orderBy(order)) - 1
    rows = rows.withColumn("_pair", F.floor(place / 2))
    return rows.groupBy(*group, "_run", "_pair").agg(
        F.min(key).alias(key), F.min(order).alias("first"), F.when(F.count("*") == 2, F.max(order)).alias("second")
    ).drop("_run", "_pair")


def suffix_sum(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """``rows`` with ``left``: the sum of this and all later rows of the key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("left", F.sum(value).over(w))


def page(rows: DataFrame, *order: str | Column, size: int, number: int) -> DataFrame:
    """One page by offset, with the total and whether more follow. Sorted with a limit, so no task sorts the whole table."""
    total = rows.agg(F.count("*").alias("total"))
    end = size * (number + 1)
    part = rows.orderBy(*order).offset(size * number).limit(size)
    return part.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > end)  # the total is one row


def keyset_page(rows: DataFrame, key: str, *, after: int, size: int) -> DataFrame:
    """The next ``size`` rows whose key is above ``after``, with whether more follow."""
    part = rows.filter(F.col(key) > after).orderBy(key).limit(size + 1)
    place = F.row_number().over(Window.orderBy(key))  # of size + 1 rows at most
    part = part.withColumn("_n", place)
    more = F.max("_n").over(Window.partitionBy(F.lit(1))) > size
    return part.withColumn("has_more", more).filter(F.col("_n") <= size).drop("_n")


def fail_closed(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Rows of keys within the limit; a key over it gives nothing, not a prefix."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_n") <= limit).drop("_n")


def get_many(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``wanted`` (pos and ``key``) with the row of each key, in any number and order; a key without a row fails the whole call."""
    found = wanted.join(rows.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no row with {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.filter(F.when(F.col("_there"), True).otherwise(missing.cast("boolean"))).drop("_there")
