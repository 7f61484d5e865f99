"""Allocation, quality, readiness and report aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.windows import last_n

PACKAGED = ("submitted", "reimbursed")


def active_expenses(expenses: DataFrame, *, order: str = "seq") -> DataFrame:
    """The first occurrence of each id among rows that are not deleted, merged, cancelled, returned or archived.

    The filter comes first, so a later live row stands in for an earlier dead one.
    """
    dead = F.col("status").isin("deleted", "merged", "cancelled", "returned", "archived")
    first = Window.partitionBy("id").orderBy(order)
    return expenses.filter(~F.coalesce(dead, F.lit(False))).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def person_allocation(expenses: DataFrame) -> DataFrame:
    """Per owner: items, cents, and the cents that are packaged, ready or pending by stage."""
    part = lambda test: F.sum(F.when(test, F.col("cents")).otherwise(F.lit(0).cast("bigint")))
    packaged, ready = F.col("stage").isin(*PACKAGED), F.col("stage") == "ready"
    return expenses.groupBy("owner").agg(
        F.count("*").alias("items"), F.sum("cents").alias("cents"), part(packaged).alias("packaged"),
        part(~packaged & ready).alias("ready"), part(~packaged & ~ready).alias("pending"),
    )


def zero_filled(people: DataFrame, allocation: DataFrame) -> DataFrame:
    """One row per person and one unassigned (blank) row; without items all numbers are 0."""
    everyone = people.select("owner").distinct().union(people.sparkSession.createDataFrame([("",)], "owner string"))
    numbers = [c for c in allocation.columns if c != "owner"]
    named = allocation.withColumn("owner", F.coalesce("owner", F.lit("")))
    return everyone.join(named, "owner", "left").select("owner", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers])


def correction_rate(seen: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per (field, source): ids that were corrected among all that were observed or corrected."""
    every = seen.select("field", "source", "id").union(corrections.select("field", "source", "id"))
    total = every.groupBy("field", "source").agg(F.countDistinct("id").alias("observed"))
    wrong = corrections.groupBy("field", "source").agg(F.countDistinct("id").alias("corrected"))
    joined = total.join(wrong, ["field", "source"], "left").withColumn("corrected", F.coalesce("corrected", F.lit(0)))
    return joined.withColumn("rate", F.col("corrected") / F.col("observed"))


def normal_text(text: Column) -> Column:
    """Text for comparison: without white space, lower case."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def recognition_quality(rows: DataFrame) -> DataFrame:
    """Per (type, field) of (type, field, gold, predicted): eligible, extracted, correct, accuracy, coverage.

    Rows with a blank gold value don't count. Accuracy is correct of extracted, coverage extracted of eligible;
    both are null, not 0, where nothing is below.
    """
    filled = lambda c: F.coalesce(normal_text(F.col(c)), F.lit("")) != ""
    counts = rows.groupBy("type", "field").agg(
        F.count_if(filled("gold")).alias("eligible"), F.count_if(filled("gold") & filled("predicted")).alias("extracted"),
        F.count_if(filled("gold") & (normal_text(F.col("gold")) == normal_text(F.col("predicted")))).alias("correct"),
    )
    return counts.withColumns({
        "accuracy": F.try_divide(F.col("correct"), F.col("extracted")), "coverage": F.try_divide(F.col("extracted"), F.col("eligible")),
    })


def readiness(expenses: DataFrame) -> DataFrame:
    """Per project: verified items and cents (ready and beyond), and how many are pending."""
    done = F.col("stage") != "draft"
    return expenses.groupBy("project").agg(
        F.count_if(done).alias("verified"), F.sum(F.when(done, F.col("cents")).otherwise(F.lit(0).cast("bigint"))).alias("verified_cents"),
        F.count_if(~done).alias("pending"),
    )


def room_capacity(rooms: DataFrame, *, arriving: int, beds_per_extra: int = 4) -> DataFrame:
    """Per group of (hotel, room, room_type, occupants, override, exclusive): capacity, vacancies and extra rooms.

    A room counts once; a second row for it is an issue, as is an unknown capacity, unknown occupants, or more
    occupants than beds. Any issue leaves the estimates null.
    """
    first = Window.partitionBy("hotel", "room").orderBy("seq")
    rows = rooms.withColumn("n", F.row_number().over(first))
    beds = F.when(F.col("exclusive"), F.lit(1)).otherwise(
        F.coalesce("override", F.when(F.col("room_type") == "king", 2).when(F.col("room_type") == "twin", 4))
    )
    bad = (F.col("n") > 1) | beds.isNull() | F.col("occupants").isNull() | (F.col("occupants") > beds)
    counted = F.when(F.col("n") == 1, beds)
    out = rows.groupBy("hotel").agg(
        F.count_if(F.col("n") == 1).alias("rooms"), F.count_if(bad).alias("issues"), F.sum(counted).cast("bigint").alias("beds"),
        F.sum(F.when(F.col("n") == 1, beds - F.col("occupants"))).cast("bigint").alias("free"),
    )
    clean = F.col("issues") == 0
    extra = F.ceil(F.greatest(F.lit(0), F.lit(arriving) - F.col("free")) / beds_per_extra).cast("bigint")
    return out.select(
        "hotel", "rooms", "issues", F.when(clean, F.col("beds")).alias("beds"), F.when(clean, F.col("free")).alias("free"),
        F.when(clean, extra).alias("extra_rooms"),
    )


def consensus(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The one value that a group's rows agree on, null if they have none or several."""
    found = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    return found.select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).alias("value"), "n")


def repeated_identities(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The order statistic at ceil(n * share) of each group: exact, not interpolated."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(value)))
    return ranked.filter(F.col("_r") == F.ceil(F.col("_n") * F.lit(share))).select(*keys, F.col(value).alias("value"), F.col("_n").alias("n"))


def report_rows(items: DataFrame, *, first_row: int, last_row: int, order: str) -> DataFrame:
    """Items with the template row of their group: groups take rows in the order in which they first appear, and
    those beyond ``last_row`` share it."""
    seen = items.groupBy("project", "category").agg(F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy("_first", "category"))
    placed = seen.withColumn("row", F.least(rank + (first_row - 1), F.lit(last_row))).drop("_first")
    return items.join(placed, ["project", "category"])


def report_snapshot(items: DataFrame, *, first_row: int = 24, last_row: int = 26, order: str = "id") -> DataFrame:
    """Per (project, row): total cents, items, the categories in the order they first appear, and the first and last id."""
    placed = report_rows(items, first_row=first_row, last_row=last_row, order=order)
    per = placed.groupBy("project", "row", "category").agg(
        F.sum("cents").alias("cents"), F.count("*").alias("items"), F.min(order).alias("low"), F.max(order).alias("high")
    )
    names = F.transform(F.sort_array(F.collect_list(F.struct("low", "category"))), lambda s: s["category"])
    return per.groupBy("project", "row").agg(
        F.sum("cents").alias("cents"), F.sum("items").alias("items"), F.array_join(names, ";").alias("names"),
        F.min("low").alias("first_id"), F.max("high").alias("last_id"),
    )


def lru_keep(entries: DataFrame, *, limit: int, keys: list[str]) -> DataFrame:
    """Entries that stay when the least recently used ones are evicted until each group's size is within ``limit``."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("accessed"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("held", F.sum("size").over(newest)).filter(F.col("held") <= limit)


def period_bounds(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """First and last date of each group, and whether some of its rows have none."""
    return rows.groupBy(*keys).agg(F.min(date).alias("first"), F.max(date).alias("last"), (F.count_if(F.col(date).isNull()) > 0).alias("partial"))


def cross_item_duplicates(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Keys that stand on more than one item."""
    found = rows.groupBy(*keys).agg(F.min(item).alias("low"), F.max(item).alias("high"), F.countDistinct(item).alias("items"))
    return found.filter("items > 1")


def personnel_ledger(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per (day, label): how many rows and which people; an override's label wins over the row's own."""
    label = rows.join(overrides, "person", "left").withColumn("label", F.coalesce("override", "label"))
    return label.groupBy("day", "label").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("person")).cast("array<string>"), ",").alias("people"))


#: Steps of a stage that its timings tell of. A fixed value.
RECENT = 256


def recent_timings(rows: DataFrame, most: int = RECENT) -> DataFrame:
    """(stage, steps, spent, longest, errors) over the last ``most`` steps (stage, second, id, spent, failed) of each stage.

    Spark limits each task's rows of a stage before the shuffle, so a stage that nearly all steps are of sends ``most`` rows a task.
    """
    return last_n(rows, ["stage"], most, "second", "id").groupBy("stage").agg(
        F.count("*").alias("steps"), F.sum("spent").alias("spent"), F.max("spent").alias("longest"), F.count_if(F.coalesce("failed", F.lit(False))).alias("errors")
    )
