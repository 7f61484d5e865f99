"""Exact dedup by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import SPACES, partitions

#: Splitters and sort keys start with so many characters of a text, as whole texts would all go to the driver.
SPLITTER_CHARS = 64
#: Keys that are sampled for each range; the driver sorts them, and they have some 200 bytes.
SAMPLED = 40
SEED = 7
#: Kept for callers of an earlier version, which dealt copies to so many salts; copies are not salted now.
SALTS = 1


def normalised(column: Column) -> Column:
    """The text with each run of ASCII spaces as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), SPACES, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, norm, sha, named, key): ``row`` holds the columns of ``docs``, so that no name clashes.

    Keys order rows by the text's first characters, then its digest (both are ``named``), then the identifier. So copies
    of a text are neighbours, and a text with very many copies can be cut between any two of them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row")).select(
        "row", F.col("row")[id_col].cast("bigint").alias("doc_id"), normalised(F.col("row")[text_col]).alias("norm")
    )
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    rows = rows.withColumn("named", F.concat(F.substr("norm", F.lit(1), F.lit(SPLITTER_CHARS)), F.lit("\n"), "sha"))
    key = F.concat("named", F.coalesce(F.lpad(F.hex("doc_id"), 16, "0"), F.lit(""))).alias("key")
    # A row generator, so that what follows doesn't evaluate these again.
    rows = rows.select("row", F.explode(F.array(F.struct("doc_id", "norm", "sha", "named", key))).alias("k"))
    return rows.select("row", "k.*")


def splitters(docs: DataFrame, ranges: int, *, id_col: str, text_col: str, sampled: int = SAMPLED) -> list[str]:
    """Ascending keys that cut the rows into ``ranges`` parts of about equal length, from some ``sampled`` keys per range."""
    share = min(1.0, sampled * ranges / max(docs.count(), 1))
    sample = docs if share == 1 else docs.sample(share, SEED)
    found = sorted((r[0], r[1]) for r in _keyed(sample, id_col, text_col).select("key", F.length("norm") + 100).collect())
    total, held, cuts = sum(n for _, n in found), 0, []
    for key, n in found:
        held += n
        if held * ranges >= total * (len(cuts) + 1) and len(cuts) < ranges - 1 and (not cuts or cuts[-1] < key):
            cuts.append(key)
    return cuts


def place_of(key: Column, cuts: list[str]) -> Column:
    """How many of the ascending ``cuts`` are below ``key``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    below = lambda at, step: F.coalesce(F.get(F.lit(cuts), at + step - 1) < key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at)) if cuts else F.lit(0)


def _runs(docs: DataFrame, *, id_col: str, text_col: str, sampled: int = SAMPLED) -> DataFrame:
    """(row, doc_id, sha, keep_id, group_size, kept): one row per row of ``docs``, which is in ``row``."""
    cuts = splitters(docs, partitions(docs), id_col=id_col, text_col=text_col, sampled=sampled)
    rows = _keyed(docs, id_col, text_col).withColumn("range", place_of(F.col("key"), cuts))
    run = Window.partitionBy("range", "norm")  # rows are sorted so, and a run ends where neighbours differ
    placed = rows.select("row", "doc_id", "norm", "sha", "range").repartitionById(len(cuts) + 1, "range").select(
        "row", "doc_id", "sha", "range", F.first("doc_id").over(run.orderBy("doc_id")).alias("head"),
        F.row_number().over(run.orderBy("doc_id")).alias("place"), F.count("*").over(run).alias("n"),
    )
    if not cuts:
        return placed.select("row", "doc_id", "sha", F.col("head").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == 1).alias("kept"))
    # Stitching: only a text that a splitter names can be in several ranges. Such texts have one run per range.
    of_splitter = F.lit(False)
    for back in (0, 1):
        splitter = F.get(F.lit(cuts), F.col("range") - back)
        of_splitter = of_splitter | F.coalesce(splitter.startswith(F.col("named")), F.lit(False))
    least = F.min(F.struct("doc_id"))["doc_id"]  # null, too, can be the smallest
    ends = rows.filter(of_splitter).groupBy("range", "sha", "norm").agg(least.alias("head"), F.count("*").alias("n"))
    text = Window.partitionBy("sha", "norm")
    ends = ends.withColumns({"keep_id": F.min(F.struct("head")).over(text)["head"], "group_size": F.sum("n").over(text), "runs": F.count("*").over(text)})
    ends = ends.filter("runs > 1").select("range", "sha", "keep_id", "group_size", F.lit(True).alias("stitched"))
    done = placed.join(F.broadcast(ends), ["range", "sha"], "left")  # two rows per splitter at most
    keep_id = F.when(F.col("stitched"), F.col("keep_id")).otherwise(F.col("head"))
    return done.select(
        "row", "doc_id", "sha", keep_id.alias("keep_id"), F.coalesce("group_size", "n").alias("group_size"),
        ((F.col("place") == 1) & F.col("head").eqNullSafe(keep_id)).alias("kept"),
    )


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sampled: int = SAMPLED) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Sampled splitters cut the rows into as many ranges as there are shuffle partitions; each range is sorted by
    normalised text and identifier, so equal texts are neighbours, and runs end where neighbours, compared in full, differ.
    Range keys end with the identifier, so a text with very many copies is cut where it fills a range; its runs, one per
    range, are then stitched, again by full comparison. Texts go through one shuffle.

    Null texts and empty texts are equal. Rows with equal identifiers and equal texts are one group of which
    one row is kept. A null identifier sorts first, and its group's keep_id is then null. Rows that share text and
    identifier can't be told apart and are in one range. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    runs = _runs(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, sampled=sampled)
    return runs.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sampled: int = SAMPLED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the smallest identifier.

    Of rows that share identifier and text one stays, any of them. Columns may have any names, and an empty table stays empty.
    """
    kept = _runs(docs, id_col=id_col, text_col=text_col, sampled=sampled).filter("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
