"""Changes of the ledger as pure functions: tables and commands in, tables and events out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.session import tasks_for

#: Stages that a command leads to, and those it may come from. Fixed values.
MOVES = {"submitted": ("draft", "ready"), "reimbursed": ("submitted",), "cancelled": ("draft", "ready")}


def transition(state: DataFrame, commands: DataFrame) -> DataFrame:
    """``state`` (id, stage, verified, version, merged_into, deleted) after one command per id (id, target, version).

    A command is applied if its version is the row's, the row is neither merged nor deleted, and its stage may lead there;
    ``submitted`` needs a verified row. Otherwise the row stays and ``outcome`` tells why. An applied one adds a version.
    """
    joined = state.join(commands.select("id", "target", F.col("version").alias("_seen")), "id", "left")
    allowed = F.lit(False)
    for target, sources in MOVES.items():
        allowed = allowed | ((F.col("target") == target) & F.col("stage").isin(*sources))
    outcome = (
        F.when(F.col("target").isNull(), "none")
        .when(F.col("deleted") | F.col("merged_into").isNotNull(), "closed")
        .when(F.col("_seen") != F.col("version"), "stale")
        .when(~allowed, "not allowed")
        .when((F.col("target") == "submitted") & ~F.col("verified"), "not verified")
        .otherwise("applied")
    )
    done = F.col("outcome") == "applied"
    return joined.withColumn("outcome", outcome).select(
        "id", F.when(done, F.col("target")).otherwise(F.col("stage")).alias("stage"),
        (F.col("version") + done.cast("int")).alias("version"), "outcome",
    )


def all_or_nothing(commands: DataFrame, batch: str, good: str) -> DataFrame:
    """Commands of batches in which every one is good."""
    whole = F.min(F.col(good).cast("int")).over(Window.partitionBy(batch)) == 1
    return commands.withColumn("_whole", whole).filter("_whole").drop("_whole")


def return_to_review(state: DataFrame, commands: DataFrame, *, most: int = 200) -> DataFrame:
    """``state`` (id, project, stage, ready, version, closed) after batches of returns (batch, id, project, version).

    A batch is applied whole or not at all: it has 1 to ``most`` rows, each with the project and version of an open row that is
    submitted, reimbursed or a ready draft, and no id occurs twice among all commands. Applied rows become unready drafts with ``review``
    set and a higher version. Null flags count as false; commands of unknown ids spoil their batch.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    asked = commands.select("batch", "id", F.col("project").alias("_project"), F.col("version").alias("_seen"))
    once = commands.groupBy("id").agg((F.count("*") == 1).alias("_once"))
    may = F.col("stage").isin("submitted", "reimbursed") | ((F.col("stage") == "draft") & F.col("ready"))
    good = flag(may & (F.col("project") == F.col("_project")) & (F.col("version") == F.col("_seen")) & F.col("_once")) & ~flag(F.col("closed"))
    judged = asked.join(once, "id", "left").join(state, "id", "left").select("batch", "id", good.cast("int").alias("good"))
    whole = judged.groupBy("batch").agg(F.min("good").alias("least"), F.count("*").alias("n")).filter((F.col("least") == 1) & (F.col("n") <= most))
    applied = judged.join(whole.select("batch"), "batch", "left_semi").select("id", F.lit(True).alias("_applied"))
    done = flag(F.col("_applied"))
    return state.join(applied, "id", "left").select(
        "id", "project", F.when(done, "draft").otherwise(F.col("stage")).alias("stage"), (flag(F.col("ready")) & ~done).alias("ready"),
        (F.col("version") + done.cast("int")).alias("version"), done.alias("review"),
    )


def merge_attachments(attachments: DataFrame, merges: DataFrame) -> DataFrame:
    """Attachments (item, digest, role) after merging sources into targets (source, target): what the target has already isn't added."""
    tasks = tasks_for(attachments)
    joined = attachments.repartition(tasks, "item").join(merges.select("source", "target"), F.col("item") == F.col("source"), "left")
    rows = joined.select(F.when(F.col("source").isNull(), F.col("item")).otherwise(F.col("target")).alias("item"), "digest", "role")
    return rows.repartition(tasks, "item").distinct()


def rewrite_owner(rows: DataFrame, people: DataFrame, column: str) -> DataFrame:
    """``rows`` with owners replaced by whom they were merged into (person, root); ``changed`` rows get a new revision."""
    joined = rows.join(people.select(F.col("person").alias(column), "root"), column, "left")
    changed = F.coalesce(F.col("root") != F.col(column), F.lit(False))
    return joined.withColumn("changed", changed).withColumn(column, F.coalesce("root", column)).drop("root")


def delete_for_good(rows: DataFrame, doomed: DataFrame, keys: list[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, digests that are gone): a digest that another row still has isn't gone."""
    stay = rows.join(doomed.select(*keys), keys, "left_anti")
    gone = rows.join(doomed.select(*keys), keys, "left_semi").select(digest).distinct()
    return stay, gone.join(stay.select(digest).distinct(), digest, "left_anti")


def guard_tombstones(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` none of whose ``keys`` is in a tombstone's list (kind, deleted: array of strings)."""
    dead = tombstones.select("kind", F.explode("deleted").alias("value")).distinct()
    for key in keys:
        own = dead.filter(F.col("kind") == key).select(F.col("value").alias("_dead"))
        rows = rows.join(own, F.col(key).cast("string") == F.col("_dead"), "left_anti")
    return rows


def undo(current: DataFrame, after: DataFrame, before: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``current`` with the rows that still equal their after-image put back to their before-image."""
    image = lambda df, tag: df.select(*keys, F.struct(*values).alias(tag))
    joined = current.join(image(after, "_after"), keys, "left").join(image(before, "_before"), keys, "left")
    same = F.struct(*values).eqNullSafe(F.col("_after")) & F.col("_before").isNotNull()
    return joined.withColumn("undone", F.coalesce(same, F.lit(False))).select(
        *keys, *[F.when(F.col("undone"), F.col(f"_before.{v}")).otherwise(F.col(v)).alias(v) for v in values], "undone"
    )


def upsert_max(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Old and new values per key, of which the greater one stays."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


#: Roles that may be archived, states that cards have in the pool, and what a gap may be. Fixed values.
ARCHIVE_ROLES = ("invoice", "payment", "receipt", "purchase", "order", "trip", "trip_sheet", "detail", "other")
IN_POOL = ("received", "review")
MATERIAL_GAPS = (
    "支付凭证", "发票", "行程单", "发票或收据", "付款截图", "购买明细／收据", "发票或微信／支付宝扣费记录", "12306发票", "订单记录或购买明细／收据",
    "订单记录", "运单明细", "发票或收据／购买明细", "微信／支付宝扣费记录",
)


def archive(queue: DataFrame, commands: DataFrame, attached: DataFrame) -> DataFrame:
    """``queue`` after one command per card (id, revision, project, action), with ``outcome``.

    A card is (id, project, role, status, digest, revision, linked, converted, needless, archived_from, deleted_from). ``archive`` takes one out of the
    pool, ``restore`` puts it back into the state that it had, ``delete`` hides an archived one, and ``restore-deleted`` takes it back to the
    archive, never to the pool. ``needless`` cards (payments of rail tickets) are never put back, and may be deleted at once.
    A command has to know the card's revision and its project, if it has one. Cards whose original (``attached`` digests) or self belongs to an
    expense, or that were converted, stay. An applied command adds a revision; null flags count as false.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    asked = commands.select("id", "action", F.col("revision").alias("_seen"), F.col("project").alias("_project"))
    held = attached.select("digest").distinct().withColumn("_held", F.lit(True))
    rows = queue.join(asked, "id", "left").join(held, "digest", "left")
    status, needless = F.col("status"), flag(F.col("needless")) | (F.col("status") == "unused")
    may = (
        F.when(F.col("action") == "archive", status.isin(*IN_POOL) & ~needless)
        .when(F.col("action") == "restore", (status == "archived") & ~needless & flag(F.col("archived_from").isin(*IN_POOL)))
        .when(F.col("action") == "delete", status.isin("archived", "unused") | (needless & status.isin(*IN_POOL)))
        .when(F.col("action") == "restore-deleted", (status == "deleted") & flag(F.col("deleted_from").isin("archived", "unused")))
    )
    foreign = flag((F.col("project") != "") & (F.col("project") != F.coalesce("_project", F.lit(""))))
    outcome = (
        F.when(F.col("action").isNull(), "none").when(~flag(F.col("revision") == F.col("_seen")), "stale").when(foreign, "other project")
        .when(flag(F.col("_held")) | flag(F.col("linked")), "linked").when(flag(F.col("converted")) | (status == "converted"), "converted")
        .when(~F.coalesce("role", F.lit("other")).isin(*ARCHIVE_ROLES), "wrong role").when(~flag(may), "not allowed").otherwise("applied")
    )
    rows = rows.withColumn("outcome", outcome)
    did = lambda action: (F.col("outcome") == "applied") & (F.col("action") == action)
    gone = F.when(needless, "unused").otherwise(status)
    return rows.select(
        "id",
        F.when(did("archive"), "archived").when(did("delete"), "deleted").when(did("restore"), F.col("archived_from")).when(did("restore-deleted"), F.col("deleted_from")).otherwise(status).alias("status"),
        F.when(did("archive"), status).when(~did("restore"), F.col("archived_from")).alias("archived_from"),
        F.when(did("delete"), gone).when(~did("restore-deleted"), F.col("deleted_from")).alias("deleted_from"),
        (F.col("revision") + (F.col("outcome") == "applied").cast("int")).alias("revision"), "outcome",
    )


def move_project(expenses: DataFrame, queue: DataFrame, groups: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expenses, queue and groups after ``moves`` (id, target): each moves whole with what was merged into it, or not at all.

    ``expenses`` (id, project, person, merged_into, match_id, verified, stage), ``queue`` (id, item_id, match_id, project, revision), ``groups`` (match_id, item_id,
    project, undone). An expense with a person of its old project doesn't move, nor one whose group is missing, undone or of another expense, or has
    a card that went elsewhere since. What moves is unverified again and asks for review if it is a draft; its cards get a higher revision.
    ``outcome`` of the moved expenses tells why one stayed.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    tasks = max(tasks_for(expenses), tasks_for(queue))
    dealt = expenses.repartition(tasks, "id")
    asked = moves.repartition(tasks, "id").groupBy("id").agg(F.max("target").alias("target"))
    heads = dealt.join(asked, "id")
    sets = groups.repartition(tasks, "match_id")
    own = sets.select("match_id", F.col("item_id").alias("_owner"), F.col("undone").alias("_undone"))
    # A card of the group that belongs to neither the expense nor its members, or a member's card of another group.
    parts = expenses.select(F.col("id").alias("item_id"), F.coalesce("merged_into", "id").alias("head"))
    strays = queue.filter("match_id IS NOT NULL").repartition(tasks, "item_id").join(parts, "item_id", "left").join(sets.select("match_id", F.col("item_id").alias("_owner")), "match_id")
    strays = strays.filter(~flag(F.col("head") == F.col("_owner"))).select("match_id").repartition(tasks, "match_id").distinct().withColumn("_stray", F.lit(True))
    judged = heads.join(own, "match_id", "left").join(strays, "match_id", "left")
    outcome = (
        F.when(F.col("merged_into").isNotNull(), "merged").when(F.col("person").isNotNull() & (F.col("project") != F.col("target")), "has a person")
        .when(F.col("match_id").isNotNull() & (~flag(F.col("_owner") == F.col("id")) | flag(F.col("_undone"))), "group changed").when(flag(F.col("_stray")), "card changed").otherwise("moved")
    )
    judged = judged.select("id", "target", outcome.alias("outcome"))
    moved = judged.filter("outcome = 'moved'").select(F.col("id").alias("head"), "target")
    whole = parts.repartition(tasks, "head").join(moved, "head").select(F.col("item_id").alias("id"), "target")
    done = F.col("target").isNotNull()
    out = dealt.join(whole, "id", "left").join(judged.select("id", "outcome"), "id", "left").select(
        "id", F.coalesce("target", "project").alias("project"), "merged_into", (flag(F.col("verified")) & ~done).alias("verified"),
        (done & flag(F.col("stage") == "draft")).alias("review"), F.coalesce("outcome", F.when(done, "moved").otherwise("none")).alias("outcome"),
    )
    cards = queue.repartition(tasks, "item_id").join(whole.select(F.col("id").alias("item_id"), "target"), "item_id", "left").select("id", "item_id", F.coalesce("target", "project").alias("project"), (F.col("revision") + done.cast("int")).alias("revision"))
    sets = groups.join(moved.select(F.col("head").alias("item_id"), "target"), "item_id", "left").select("match_id", "item_id", F.coalesce("target", "project").alias("project"))
    return out, cards, sets


def acknowledged(items: DataFrame) -> DataFrame:
    """``items`` with ``acknowledged``: whether what is missing was accepted, for just this state of the expense and its sources.

    An item is (verified, amount_pending, missing, scope, old_scope, sources) and what was accepted: ``ack`` (missing, scope, sources). Gaps may only be of materials;
    the scope is a hash of the expense's own fields, ``old_scope`` that under the names of before a migration; sources are structs of each one's
    id, role and digest, in any order. Anything null says no.
    """
    gaps = F.col("missing")
    may = ~F.coalesce("amount_pending", F.lit(False)) & (F.size(gaps) > 0) & F.forall(gaps, lambda g: g.isin(*MATERIAL_GAPS))
    scope = (F.col("ack.scope") == F.col("scope")) | F.coalesce(F.col("ack.scope") == F.col("old_scope"), F.lit(False))
    same = (F.col("ack.missing") == gaps) & scope & (F.array_sort("ack.sources") == F.array_sort("sources"))
    return items.withColumn("acknowledged", F.coalesce(F.col("verified") & may & same, F.lit(False)))
