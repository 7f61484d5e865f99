"""Row rules: what a material or expense is, what it lacks, and whether it may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that each basis needs, and what a missing one is called. Fixed values.
NEEDS = {
    "payment_only": (("payment", "payment record"),),
    "ride": (("invoice", "invoice"), ("trip_sheet", "trip sheet")),
    "invoice_payment": (("invoice", "invoice"), ("payment", "payment record")),
}
BOARD = {"unused": "unused", "archived": "archived", "deleted": "deleted"}


def board_bucket(status: Column, role: Column) -> Column:
    """Where a queue row is shown: by status first, then vouchers, payments or other by role."""
    out = F.when(role.isin("invoice", "receipt"), "vouchers").when(role == "payment", "payments").otherwise("other")
    for name, bucket in BOARD.items():
        out = F.when(status == name, bucket).otherwise(out)
    return out


def material_board(queue: DataFrame, attached: DataFrame) -> DataFrame:
    """Queue rows on the board: not duplicates, not linked, and with a digest that no expense holds."""
    shown = F.col("status").isin("received", "review", "unused", "archived", "deleted")
    rows = queue.filter(shown & F.col("duplicate_of").isNull()).join(attached.select("digest").distinct(), "digest", "left_anti")
    return rows.withColumn("bucket", board_bucket(F.col("status"), F.col("role")))


def completeness(rows: DataFrame) -> DataFrame:
    """``rows`` (basis, roles, amount_pending, category) with missing, complete and alternative.

    Every pending amount is a gap. ``alternative`` marks material purchases that have a payment but no invoice.
    """
    gaps = F.array().cast("array<string>")
    for basis, needs in NEEDS.items():
        own = F.array_compact(F.array(*[F.when(~F.array_contains("roles", role), F.lit(name)) for role, name in needs]))
        gaps = F.when(F.col("basis") == basis, own).otherwise(gaps)
    gaps = F.when(F.col("amount_pending"), F.array_append(gaps, F.lit("amount"))).otherwise(gaps)
    paid = F.array_contains("roles", "payment") & ~F.array_contains("roles", "invoice")
    return rows.withColumn("missing", gaps).withColumns({
        "complete": F.size("missing") == 0, "alternative": (F.col("category") == "materials") & paid,
    })


def pending(queue: DataFrame, attached: DataFrame) -> DataFrame:
    """Rows to organise: received or in review, nothing decided yet, and not attached."""
    free = F.lit(True)
    for column in ("item_id", "duplicate_of", "person_id"):
        free = free & F.col(column).isNull()
    return queue.filter(F.col("status").isin("received", "review") & free).join(attached.select("digest").distinct(), "digest", "left_anti")


def one_owner(rows: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Per key whether its rows have one owner at most; here a blank counts as an owner of its own."""
    named = F.coalesce(owner, F.lit(""))
    return rows.groupBy(*keys).agg((F.min(named) == F.max(named)).alias("compatible"), F.countDistinct(named).alias("owners"))


def auto_verify(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows`` with the checks that fail and ``eligible``, which needs all of them; an unknown check is not passed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]))
    return rows.withColumn("failed", failed).withColumn("eligible", F.size("failed") == 0)


def conflicting_facts(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return facts.groupBy(*keys).agg(F.countDistinct(value).alias("values")).filter("values > 1")


def merge_fields(rows: DataFrame, *, manual: str, current: str, observed: str) -> DataFrame:
    """``rows`` with the field's value and whether it conflicts: manual wins over a genuine value, which wins over an observation.

    Placeholders (unknown, uncertain, blank) can be replaced; a different observation never overwrites, it conflicts.
    """
    genuine = F.when(~F.lower(F.col(current)).isin("unknown", "uncertain", ""), F.col(current))
    value = F.coalesce(manual, genuine, observed)
    return rows.withColumn("value", value).withColumn("conflict", F.coalesce(F.col(observed) != value, F.lit(False)))


def product_cover(rows: DataFrame) -> DataFrame:
    """Per group of (group, product, record): whether every product can have a record of its own, by augmenting paths."""
    import pandas as pd

    def cover(part: pd.DataFrame) -> pd.DataFrame:
        options = part.groupby("product")["record"].apply(lambda s: sorted(set(s))).to_dict()
        holder: dict = {}

        def place(product, seen):
            for record in options[product]:
                if record not in seen:
                    seen.add(record)
                    if record not in holder or place(holder[record], seen):
                        holder[record] = product
                        return True
            return False

        placed = sum(place(p, set()) for p in sorted(options))
        return pd.DataFrame([(part["group"].iloc[0], len(options), placed)], columns=["group", "products", "placed"])

    return rows.select("group", "product", "record").groupBy("group").applyInPandas(cover, "group bigint, products bigint, placed bigint")


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


# -- Fixed values: what is printed for a category, if nothing else decides it.
PRINTED = {
    "hotel": ("invoice", "payment"), "rail": ("invoice",), "taxi": ("trip", "invoice"), "takeout": ("order", "invoice"), "courier": ("detail", "invoice"),
    "meals": ("invoice", "order", "purchase"), "printing": ("invoice", "receipt", "purchase", "payment"),
}


def selected_attachments(rows: DataFrame) -> DataFrame:
    """``rows`` with ``selected``: the ids of the attachments to print, in order, null where the rows' state allows no choice.

    ``attachments`` has (id, name, role, available), with unique ids; ``support`` the ids of supporting originals; flags are acknowledged,
    complete, trip_required, waybill_required, legacy and alternative. Null flags count as false, null arrays as empty. A legacy row needs exactly one package;
    supporting originals must be there, be no vouchers and be named once. An unknown category gives null.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    attached = F.coalesce("attachments", F.expr("cast(array() as array<struct<id: string, name: string, role: string, available: boolean>>)"))
    placed = F.transform(attached, lambda x, i: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["role"].alias("role"), x["available"].alias("available"), i.alias("at")))
    present = F.filter(placed, lambda x: F.coalesce(x["available"], F.lit(False)))
    ids = lambda found: F.transform(found, lambda x: x["id"])

    def pick(*roles, last=()):
        found = F.filter(present, lambda x: x["role"].isin(*roles))
        return ids(F.array_sort(F.transform(found, lambda x: F.struct(x["role"].isin(*last).alias("late"), x["name"].alias("name"), x["at"].alias("at"), x["id"].alias("id")))))

    named = F.coalesce("support", F.array().cast("array<string>"))
    found = F.filter(present, lambda x: F.array_contains(named, x["id"]) & ~x["role"].isin("invoice", "receipt", "payment", "package"))
    found = F.array_sort(F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["id"].alias("id"))))
    support = F.when((F.size(F.array_distinct(named)) == F.size(named)) & (F.size(found) == F.size(named)), ids(found))
    packages = ids(F.filter(present, lambda x: x["role"] == "package"))
    chosen = (
        F.when(flag("acknowledged") & ~flag("complete"), ids(present))
        .when(F.col("basis") == "payment_only", ids(F.filter(present, lambda x: x["role"] == "payment")))
        .when(flag("trip_required"), pick("trip", "invoice", last=["invoice"]))
        .when(flag("waybill_required"), pick("detail", "invoice", last=["invoice"]))
        .when(F.col("basis") == "invoice_payment", F.concat(pick("invoice", "receipt", "payment", last=["payment"]), support))
        .when(flag("legacy"), F.when(F.size(packages) == 1, packages))
    )
    vouchers = ["invoice", "payment"]
    for category, roles in PRINTED.items():
        chosen = chosen.when(F.col("category") == category, pick(*roles, last=vouchers))
    bought = F.when(flag("alternative"), pick("purchase", "payment", last=vouchers)).otherwise(pick("purchase", "invoice", last=vouchers))
    return rows.withColumn("selected", chosen.when(F.col("category") == "materials", bought))


def category_status(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """(id, status, eligible, pending) of automatic categories.

    ``items`` (id, stage, verified, closed, category, manual, input_key) are left-joined with ``attempts`` (item, status, category,
    managed, input_key), one per item. Only unverified open drafts without a choice made by hand are eligible, if their category is
    ``other`` or was set by an attempt; pending ones have no attempt or one of another input. Null flags count as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    tried = attempts.select(F.col("item").alias("id"), F.struct("status", "category", "managed", "input_key").alias("tried"))
    own = F.col("category")
    by_attempt = ((F.col("tried.status") == "saved") & (F.col("tried.category") == own)) | (F.col("tried.managed") == own)
    open_draft = (F.col("stage") == "draft") & ~flag("verified") & ~flag("closed") & ~flag("manual") & ~F.col("tried.status").eqNullSafe("manual")
    eligible = F.coalesce(open_draft & ((own == "other") | F.coalesce(by_attempt, F.lit(False))), F.lit(False))
    changed = F.col("tried").isNull() | ~F.col("tried.input_key").eqNullSafe(F.col("input_key"))
    status = F.when(flag("manual"), "manual").otherwise(F.col("tried.status"))
    return items.join(tried, "id", "left").select("id", status.alias("status"), eligible.alias("eligible"), (eligible & changed).alias("pending"))
