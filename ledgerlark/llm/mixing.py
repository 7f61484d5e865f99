"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import WORD, cut, text_or_empty

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 42
#: Slices of a source's seeded order, by which prefix sums stay spread over tasks.
SLICES = 4096


def source_targets(totals: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources from (source, source_size): source, source_size, target.

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum of all sizes.
    A source holds at most ``max_epochs`` times its size; what is above is reshared by weight among the others.
    Clamping the source with the smallest capacity per weight first makes one pass enough: with sources in that
    order, the level after clamping the ones before is (what is left) / (weights that are left), and the sources
    up to the first whose capacity per weight reaches the level are clamped. Only one row per source is sorted
    in one task. A total of nothing gives targets of 0.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double")
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, whole = (
        up.rowsBetween(Window.unboundedPreceding, -1),
        up.rowsBetween(0, Window.unboundedFollowing),
        Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(rest))
    # The level falls no further once a source takes all of its share.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"]
    return ranked.select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target"),
    )


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    slices: int = SLICES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What a mix takes of every row: doc_id, source, size, source_size, target, epochs, extra, taken.

    A source that is taken target / source_size times gives each row its whole repetitions (``epochs``), and the
    rest of the target to the rows that come first in an order seeded by ``seed``: all words (``extra`` = size)
    before the cut, the words up to the cut for the one row on it, none after. So a source's taken words differ
    from its target by less than one word. The order's prefix sums are taken within slices of a source and over
    the slices' sums, so a hot source is spread over tasks.

    Null texts have no words; null sources are one source, the last. Repeated rows count each. An empty table
    gives no rows.
    """
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
        order.alias("_order"),
    )
    rows = cut(rows.withColumn("_slice", F.floor((F.col("_order") / F.lit(2.0**64) + 0.5) * slices).cast("int")))
    sums = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    targets = source_targets(
        sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights=weights, max_epochs=max_epochs
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    shares = targets.withColumn("epochs", epochs.cast("bigint")).withColumn(
        "_cut", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")
    )
    by_slice = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(by_slice), F.lit(0))).drop("_sum")
    starts = starts.alias("s").join(shares.alias("t"), F.expr("s.source <=> t.source")).select("s.*", *[
        F.col(f"t.{c}") for c in ("source_size", "target", "epochs", "_cut")
    ])
    within = Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.alias("r").join(
        starts.alias("s"), F.expr("r.source <=> s.source AND r._slice = s._slice")
    ).select("r.doc_id", "r.source", "r.size", "s.source_size", "s.target", "s.epochs", F.expr("s._start + r._in").alias("_at"), "s._cut")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_cut") - F.col("_at"))).cast("bigint")
    return placed.withColumn("extra", extra).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "extra",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"),
    )


def repeat_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole: a row that is taken in part counts if half of it is.

    Rows that share identifier, source and size are taken alike. Rows without words are taken as often as their
    source is, whole times only. The columns of ``docs`` stay as they are.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    part = F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    keys = taken.groupBy(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")
    ).agg(F.max(F.col("epochs") + part).cast("int").alias("_times"))
    keys = keys.filter("_times > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # so that no name clashes
    row = F.col("_row")
    rows = rows.withColumn("_words", F.regexp_count(F.coalesce(row[text_col], F.lit("")), F.lit(WORD)).cast("bigint"))
    same = (
        row[id_col].cast("bigint").eqNullSafe(F.col("_id"))
        & row[source_col].eqNullSafe(F.col("_source"))
        & (F.col("_words") == F.col("_size"))
    )
    found = rows.join(keys, same).select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return found.select(*[row[c].alias(c) for c in docs.columns])
