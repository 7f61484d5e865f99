"""Joins of expense evidence: rides, renderings, projects and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.evidence import match_reasons


def ride_pairs(trips: DataFrame, invoices: DataFrame) -> DataFrame:
    """(trip, invoice) that are each other's only match.

    ``trips`` (id, provider, cents, ended, sources) and ``invoices`` (id, provider, cents, dated, sources) match by provider and amount,
    with a source in common, if the trip doesn't end after the invoice's date; an unknown date rules nothing out.
    Null providers and amounts match nothing.
    """
    one = trips.select(F.col("id").alias("trip"), "provider", "cents", "ended", F.col("sources").alias("of_trip"))
    two = invoices.select(F.col("id").alias("invoice"), "provider", "cents", "dated", F.col("sources").alias("of_invoice"))
    in_time = F.coalesce(F.col("ended") <= F.col("dated"), F.lit(True))
    pairs = one.join(two, ["provider", "cents"]).filter(in_time & F.arrays_overlap("of_trip", "of_invoice")).select("trip", "invoice")
    return _mutual(pairs, "trip", "invoice")


def _mutual(pairs: DataFrame, left: str, right: str) -> DataFrame:
    counted = pairs.withColumns({"_l": F.count("*").over(Window.partitionBy(left)), "_r": F.count("*").over(Window.partitionBy(right))})
    return counted.filter("_l = 1 AND _r = 1").select(left, right)


def render_pairs(images: DataFrame, documents: DataFrame) -> DataFrame:
    """(image, document) where an image renders exactly one document of its batch, source and project.

    Both have id, batch, source, project, stem, number and conflict; ``documents`` have name, too. They match by the file's stem (an image
    may also have the document's whole name as its stem) or by number. Conflicting numbers rule a row out, and two known numbers that
    differ a pair. Rows without a batch pair with nothing. Each way to match is an equality join.
    """
    images, documents = (df.filter("CAST(batch AS string) <> ''") for df in (images, documents))
    keys = ["batch", "source", "project"]
    left = images.filter("NOT conflict").select(*keys, F.col("id").alias("image"), F.col("stem").alias("image_stem"), F.nullif("number", F.lit("")).alias("image_number"))
    right = documents.filter("NOT conflict").select(*keys, F.col("id").alias("document"), "stem", "name", F.nullif("number", F.lit("")).alias("number"))
    ways = [left.join(right, [*keys, how], "inner") for left, how in (
        (left.withColumn("stem", F.col("image_stem")), "stem"), (left.withColumn("name", F.col("image_stem")), "name"), (left.withColumn("number", F.col("image_number")), "number"),
    )]
    pairs = None
    for joined, how in zip(ways, ("stem", "name", "number"), strict=True):
        fits = joined if how == "number" else joined.filter("image_number IS NULL OR number IS NULL OR image_number = number")
        fits = fits.select("image", "document")
        pairs = fits if pairs is None else pairs.union(fits)
    alone = Window.partitionBy("image")
    return pairs.distinct().withColumn("_n", F.count("*").over(alone)).filter("_n = 1").select("image", "document")


def project_views(projects: DataFrame, metadata: DataFrame, labels: DataFrame) -> DataFrame:
    """Projects (id, name) with what metadata (project_id, display_name, pinned, revision, permanently_deleted) and labels (project_id, status,
    revision) add, or defaults; permanently deleted ones are left out. Both have a row per project at most."""
    meta = metadata.select(F.col("project_id").alias("id"), "display_name", "pinned", F.col("revision").alias("project_revision"), "permanently_deleted")
    label = labels.select(F.col("project_id").alias("id"), F.col("status").alias("reimbursement_status"), F.col("revision").alias("reimbursement_revision"))
    found = projects.join(meta, "id", "left").join(label, "id", "left").filter(~F.coalesce("permanently_deleted", F.lit(False)))
    return found.select(
        "id", F.coalesce(F.nullif("display_name", F.lit("")), "name").alias("name"), F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.coalesce("project_revision", F.lit(0)).alias("project_revision"), F.coalesce("reimbursement_status", F.lit("unreimbursed")).alias("reimbursement_status"),
        F.coalesce("reimbursement_revision", F.lit(0)).alias("reimbursement_revision"),
    )


def with_expense(attempts: DataFrame, expenses: DataFrame) -> DataFrame:
    """Attempts (item_id, ...) with their expense's columns; an attempt whose expense is gone stays, with nulls."""
    return attempts.join(expenses.withColumnRenamed("id", "item_id"), "item_id", "left")


def of_active_projects(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows (project, ...) whose project (id, status) is active and not paused."""
    active = projects.filter("status = 'active' AND NOT coalesce(paused, false)").select(F.col("id").alias("project"))
    return rows.join(active, "project", "left_semi")


def returned_materials(items: DataFrame, events: DataFrame, groups: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Items (id, returned, open, updated_at) with ``is_returned``: said so, or open drafts whose last event (item, id, message) starts with one of
    ``prefixes`` and whose newest group (item, id, status, undone_at) was undone and not overtaken by a later update."""
    last = events.groupBy(F.col("item").alias("id")).agg(F.max_by("message", "id").alias("message"))
    group = groups.groupBy(F.col("item").alias("id")).agg(F.max_by(F.struct("status", "undone_at"), "id").alias("group"))
    found = items.join(last, "id", "left").join(group, "id", "left")
    withdrawn = F.lit(False)
    for prefix in prefixes:
        withdrawn = withdrawn | F.coalesce(F.col("message").startswith(prefix), F.lit(False))
    overtaken = F.coalesce(F.col("updated_at") > F.col("group.undone_at"), F.lit(False))
    undone = F.coalesce(F.col("group.status") == "undone", F.lit(False)) & ~overtaken
    returned = F.coalesce("returned", F.lit(False)) | (F.col("open") & withdrawn & undone)
    return found.select(*items.columns, returned.alias("is_returned"))


def cleanup_candidates(folders: DataFrame, now, days: int = 7) -> DataFrame:
    """Folders (path, changed) that have not changed for ``days`` days at ``now``, by path."""
    if days < 1:
        raise ValueError("at least one day")
    return folders.filter(F.col("changed") <= F.lit(now) - F.make_dt_interval(F.lit(days))).orderBy("path")


def union_by_identity(first: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """Rows of all frames, of those with one key the one of the earliest frame. Each frame has a key once; null keys all stay."""
    rows = first.withColumn("_turn", F.lit(0))
    for turn, other in enumerate(others, 1):
        rows = rows.unionByName(other.withColumn("_turn", F.lit(turn)))
    keep = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("_turn").alias("_turn"))
    return rows.join(keep, [key, "_turn"], "left_semi").unionByName(rows.filter(F.col(key).isNull())).select(*first.columns)


def search_hits(items: DataFrame, mails: DataFrame, *, key: str = "item") -> DataFrame:
    """(item, mail, reasons, place) of mails (``key``, mail, text) that say something of the item (``key``, order, merchant, amount) they were
    found for, best first: those with the order number, then those with more reasons, then by mail. Null keys meet nothing."""
    reasons = match_reasons(F.col("order"), F.col("merchant"), F.col("amount"), F.col("text"))
    hits = items.select(key, "order", "merchant", "amount").join(mails.select(key, "mail", "text"), key)
    hits = hits.select(key, "mail", reasons.alias("reasons")).filter(F.size("reasons") > 0)
    best = Window.partitionBy(key).orderBy(F.array_contains("reasons", "order").desc(), F.size("reasons").desc(), "mail")
    return hits.withColumn("place", F.row_number().over(best))
