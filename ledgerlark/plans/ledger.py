"""Rule and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark import adapters
from ledgerlark.operators import creation, ledger, rules
from ledgerlark.plans.core import register
from ledgerlark.session import keep, table

M = f"m AS ({adapters.MATERIAL_SQL})"
E = f"e AS ({adapters.EXPENSE_SQL})"
QUEUE = f"""q AS (SELECT pool * 100 + rn AS id, number % 3000 AS digest, CASE WHEN cents % 300 = 0 THEN 'trip' ELSE role END AS role,
    CASE number % 9 WHEN 0 THEN 'linked' WHEN 1 THEN 'review' WHEN 2 THEN 'unused' WHEN 3 THEN 'archived' WHEN 4 THEN 'deleted' ELSE 'received' END AS status,
    CASE WHEN rn = 7 THEN pool END AS duplicate_of, CASE WHEN rn = 3 THEN pool END AS item_id, CASE WHEN person = 'R' THEN person END AS person_id FROM m)"""


def queue(spark, sf_dir):
    m, at = adapters.material(spark, sf_dir), F.col("number") % 9
    status = F.when(at == 0, "linked").when(at == 1, "review").when(at == 2, "unused").when(at == 3, "archived").when(at == 4, "deleted").otherwise("received")
    return m.select(
        (F.col("pool") * 100 + F.col("rn")).alias("id"), (F.col("number") % 3000).alias("digest"),
        F.when(F.col("cents") % 300 == 0, "trip").otherwise(F.col("role")).alias("role"), status.alias("status"),
        F.when(F.col("rn") == 7, F.col("pool")).alias("duplicate_of"), F.when(F.col("rn") == 3, F.col("pool")).alias("item_id"),
        F.when(F.col("person") == "R", F.col("person")).alias("person_id"),
    )


def attached(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("digest"))


@register(
    "material_board",
    f"""WITH {M}, {QUEUE} SELECT id, digest, status, role, CASE WHEN status IN ('unused', 'archived', 'deleted') THEN status WHEN role IN ('invoice', 'receipt') THEN 'vouchers'
    WHEN role = 'payment' THEN 'payments' ELSE 'other' END AS bucket FROM q WHERE status <> 'linked' AND duplicate_of IS NULL AND digest NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""",
)
def material_board(spark, sf_dir):
    return rules.material_board(queue(spark, sf_dir), attached(spark, sf_dir)).select("id", "digest", "status", "role", "bucket")


@register(
    "pending_organize",
    f"""WITH {M}, {QUEUE} SELECT id, digest FROM q WHERE status IN ('received', 'review') AND item_id IS NULL AND duplicate_of IS NULL AND person_id IS NULL
    AND digest NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""",
)
def pending_organize(spark, sf_dir):
    return rules.pending(queue(spark, sf_dir), attached(spark, sf_dir)).select("id", "digest")


@register(
    "completeness",
    f"""WITH {M}, r AS (SELECT pool, list(DISTINCT CASE WHEN cents % 300 = 0 THEN 'trip_sheet' ELSE role END) AS roles, max(cents) = 5000 AS amount_pending,
        CASE pool % 3 WHEN 0 THEN 'payment_only' WHEN 1 THEN 'ride' ELSE 'invoice_payment' END AS basis, CASE WHEN pool % 2 = 0 THEN 'materials' ELSE 'other' END AS category FROM m GROUP BY pool),
    g AS (SELECT *, CASE WHEN basis IN ('ride', 'invoice_payment') AND NOT list_contains(roles, 'invoice') THEN 'invoice' END AS a,
        CASE WHEN basis = 'ride' AND NOT list_contains(roles, 'trip_sheet') THEN 'trip sheet' WHEN basis <> 'ride' AND NOT list_contains(roles, 'payment') THEN 'payment record' END AS b,
        CASE WHEN amount_pending THEN 'amount' END AS c FROM r)
    SELECT pool, concat_ws(';', a, b, c) AS missing, a IS NULL AND b IS NULL AND c IS NULL AS complete,
        category = 'materials' AND list_contains(roles, 'payment') AND NOT list_contains(roles, 'invoice') AS alternative FROM g""",
)
def completeness(spark, sf_dir):
    role = F.when(F.col("cents") % 300 == 0, "trip_sheet").otherwise(F.col("role"))
    rows = adapters.material(spark, sf_dir).groupBy("pool").agg(F.collect_set(role).alias("roles"), (F.max("cents") == 5000).alias("amount_pending"))
    at = F.col("pool") % 3
    rows = rows.withColumns({
        "basis": F.when(at == 0, "payment_only").when(at == 1, "ride").otherwise("invoice_payment"),
        "category": F.when(F.col("pool") % 2 == 0, "materials").otherwise("other"),
    })
    return rules.completeness(rows).select("pool", F.array_join("missing", ";").alias("missing"), "complete", "alternative")


@register("one_owner", f"WITH {M} SELECT pool, count(DISTINCT coalesce(nullif(person, 'R'), '')) = 1 AS compatible, count(DISTINCT coalesce(nullif(person, 'R'), '')) AS owners FROM m GROUP BY pool")
def one_owner(spark, sf_dir):
    rows = adapters.material(spark, sf_dir).withColumn("owner", F.nullif("person", F.lit("R")))
    return rules.one_owner(rows, ["pool"], "owner")


@register(
    "auto_verify",
    f"""WITH {E} SELECT id, concat_ws(',', CASE WHEN cents <= 0 OR cents > 20000000 THEN 'amount' END, CASE WHEN stage <> 'ready' THEN 'stage' END, CASE WHEN owner = 'BUILDING' THEN 'owner' END) AS failed,
    cents > 0 AND cents <= 20000000 AND stage = 'ready' AND owner <> 'BUILDING' AS eligible FROM e""",
)
def auto_verify(spark, sf_dir):
    checks = {"amount": F.col("cents").between(1, 20_000_000), "stage": F.col("stage") == "ready", "owner": F.col("owner") != "BUILDING"}
    return rules.auto_verify(adapters.expense(spark, sf_dir), checks).select("id", F.array_join("failed", ",").alias("failed"), "eligible")


@register("typed_conflicts", f"WITH {M} SELECT pool, role, count(DISTINCT person) AS \"values\" FROM m GROUP BY pool, role HAVING count(DISTINCT person) > 1")
def typed_conflicts(spark, sf_dir):
    return rules.conflicting_facts(adapters.material(spark, sf_dir), ["pool", "role"], "person")


@register(
    "field_merge",
    """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'manual' END AS manual, CASE c_custkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN NULL ELSE c_mktsegment END AS current,
        CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'other' END AS observed FROM customer),
    v AS (SELECT id, observed, coalesce(manual, CASE WHEN lower(current) NOT IN ('unknown', 'uncertain', '') THEN current END, observed) AS value FROM r)
    SELECT id, value, coalesce(observed <> value, false) AS conflict FROM v""",
)
def field_merge(spark, sf_dir):
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    rows = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(key % 5 == 0, "manual").alias("manual"), F.when(key % 4 == 0, "Unknown").when(key % 4 != 1, seg).alias("current"),
        F.when(key % 3 != 0, seg).otherwise("other").alias("observed"),
    )
    return rules.merge_fields(rows, manual="manual", current="current", observed="observed").select("id", "value", "conflict")


@register("product_cover")
def product_cover(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("group"), (F.col("l_partkey") % 20).alias("product"), (F.col("l_suppkey") % 15).alias("record"))
    return rules.product_cover(rows)


STATE = """s AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'P' THEN 'ready' ELSE 'draft' END AS stage, o_orderkey % 2 = 0 AS verified, o_orderkey % 4 AS version,
    CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 END AS merged_into, o_orderkey % 13 = 0 AS deleted FROM orders),
    c AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'submitted' WHEN 1 THEN 'reimbursed' ELSE 'cancelled' END AS target, o_custkey % 4 AS seen FROM orders WHERE o_orderkey % 3 <> 0)"""


def state(spark, sf_dir):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(status == "F", "submitted").when(status == "P", "ready").otherwise("draft").alias("stage"), (key % 2 == 0).alias("verified"),
        (key % 4).alias("version"), F.when(key % 11 == 0, key - 1).alias("merged_into"), (key % 13 == 0).alias("deleted"),
    )


@register(
    "stage_transition",
    f"""WITH {STATE}, o AS (SELECT s.id, stage, version, target, CASE WHEN target IS NULL THEN 'none' WHEN deleted OR merged_into IS NOT NULL THEN 'closed' WHEN seen <> version THEN 'stale'
        WHEN NOT ((target = 'submitted' AND stage IN ('draft', 'ready')) OR (target = 'reimbursed' AND stage = 'submitted') OR (target = 'cancelled' AND stage IN ('draft', 'ready'))) THEN 'not allowed'
        WHEN target = 'submitted' AND NOT verified THEN 'not verified' ELSE 'applied' END AS outcome FROM s LEFT JOIN c ON s.id = c.id)
    SELECT id, CASE WHEN outcome = 'applied' THEN target ELSE stage END AS stage, version + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END AS version, outcome FROM o""",
)
def stage_transition(spark, sf_dir):
    at = F.col("o_custkey") % 3
    commands = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("id"), F.when(at == 0, "submitted").when(at == 1, "reimbursed").otherwise("cancelled").alias("target"), (F.col("o_custkey") % 4).alias("version")
    )
    return ledger.transition(state(spark, sf_dir), commands)


@register("batch_confirm", "SELECT o_custkey AS batch, o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P')")
def batch_confirm(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("good"))
    return ledger.all_or_nothing(rows, "batch", "good").select("batch", "id")


@register(
    "merge_duplicates",
    f"""WITH {M}, a AS (SELECT DISTINCT pool AS item, number % 50 AS digest, role FROM m), g AS (SELECT DISTINCT pool AS source, pool - 1 AS target FROM m WHERE pool % 4 = 3),
    k AS (SELECT * FROM a WHERE item NOT IN (SELECT source FROM g)) SELECT * FROM k UNION SELECT target, digest, role FROM a JOIN g ON a.item = g.source""",
)
def merge_duplicates(spark, sf_dir):
    rows = adapters.material(spark, sf_dir)
    items = rows.select(F.col("pool").alias("item"), (F.col("number") % 50).alias("digest"), "role")
    merges = rows.filter("pool % 4 = 3").select(F.col("pool").alias("source"), (F.col("pool") - 1).alias("target")).distinct()
    return ledger.merge_attachments(items, merges)


@register(
    "people_propagation",
    "SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS owner, o_custkey % 10 = 3 AS changed FROM orders",
)
def people_propagation(spark, sf_dir):
    key = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(key.alias("person"), F.when(key % 10 == 3, key - 1).otherwise(key).alias("root"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    return ledger.rewrite_owner(rows, people, "owner").select("id", "owner", "changed")


@register(
    "exclusive_digests",
    f"WITH {M}, d AS (SELECT *, pool % 50 <> 0 AS doomed FROM m) SELECT DISTINCT number FROM d WHERE doomed AND number NOT IN (SELECT number FROM d WHERE NOT doomed)",
)
def exclusive_digests(spark, sf_dir):
    rows = adapters.material(spark, sf_dir)
    return ledger.delete_for_good(rows, rows.filter("pool % 50 <> 0").select("pool").distinct(), ["pool"], "number")[1]


@register(
    "tombstone_guard",
    "SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def tombstone_guard(spark, sf_dir):
    lists = lambda df, kind, column: df.groupBy(F.lit(kind).alias("kind"), (F.col(column) % 7).alias("part")).agg(F.collect_list(F.col(column).cast("string")).alias("deleted"))
    dead = lists(table(spark, sf_dir, "part").filter("p_size = 7"), "id", "p_partkey").union(lists(table(spark, sf_dir, "supplier"), "owner", "s_suppkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    return ledger.guard_tombstones(rows, dead.select("kind", "deleted"), ["id", "owner"])


@register(
    "undo_match",
    f"""WITH {E} SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'before' ELSE stage END AS stage, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN cents - 1 ELSE cents END AS cents, id % 3 = 0 AND id % 2 = 0 AS undone FROM e""",
)
def undo_match(spark, sf_dir):
    rows = adapters.expense(spark, sf_dir).select("id", "stage", "cents")
    after = rows.filter("id % 3 = 0").withColumn("cents", F.when(F.col("id") % 2 == 0, F.col("cents")).otherwise(F.col("cents") + 5))
    before = rows.filter("id % 3 = 0").select("id", F.lit("before").alias("stage"), (F.col("cents") - 1).alias("cents"))
    return ledger.undo(rows, after, before, ["id"], ["stage", "cents"])


@register("upsert_checkpoint", "SELECT o_custkey AS key, max(o_orderkey) AS at FROM orders GROUP BY 1")
def upsert_checkpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"))
    return ledger.upsert_max(rows.filter("at % 2 = 0"), rows.filter("at % 2 = 1"), ["key"], "at")


@register(
    "review_returns",
    """WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS project, CASE o_orderstatus WHEN 'F' THEN 'submitted' ELSE 'draft' END AS stage, o_orderstatus = 'P' AS ready,
        o_custkey % 4 AS version, o_orderstatus <> 'O' AND o_totalprice <= 200000 AS good, o_custkey FROM orders),
    w AS (SELECT *, bool_and(good) OVER b AND count(*) OVER b <= 200 AS done FROM s WINDOW b AS (PARTITION BY o_custkey, project))
    SELECT id, project, CASE WHEN done THEN 'draft' ELSE stage END AS stage, ready AND NOT done AS ready, version + CAST(done AS INTEGER) AS version, done AS review FROM w""",
)
def review_returns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    state = rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.when(F.col("o_orderstatus") == "F", "submitted").otherwise("draft").alias("stage"),
        (F.col("o_orderstatus") == "P").alias("ready"), (F.col("o_custkey") % 4).alias("version"), F.lit(False).alias("closed"),
    )
    seen = F.when(F.col("o_totalprice") <= 200000, F.col("o_custkey") % 4).otherwise(-1)
    commands = rows.select(F.struct("o_custkey", "o_orderpriority").alias("batch"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), seen.alias("version"))
    return ledger.return_to_review(state, commands)


def registration_tables(spark, sf_dir):
    """Queue, requests, groups, choices, log and used claims: a request per pool, whose groups are an odd line and the next one.

    What several of them are made from is kept, so that lines are numbered and paired once.
    """
    m = keep(adapters.material(spark, sf_dir))
    invoice, n = F.col("role") == "invoice", F.col("number")
    queue = m.select(
        (F.col("pool") * 100 + F.col("rn")).alias("id"), F.col("pool").alias("project"), "role", F.when(n % 40 == 0, "archived").otherwise("received").alias("status"),
        F.concat(n.cast("string"), F.lit("/"), F.col("rn").cast("string")).alias("digest"), "cents", F.when(invoice, F.concat(n.cast("string"), F.lit("-"), (F.col("cents") % 7).cast("string"))).alias("number"),
        F.when(~invoice & (n % 5 == 0), F.array(F.concat(F.lit("pay:"), n.cast("string")))).alias("typed"), (F.col("cents") % 3).alias("revision"), (n % 97 != 0).alias("intact"),
    )
    tokens = creation.pool_tokens(queue)
    asked = m.filter("rn = 2").select("pool", F.concat(F.lit("r"), F.col("pool").cast("string")).alias("request"))
    requests = keep(asked.join(tokens, F.col("pool") == F.col("project")).select(
        "request", (F.col("pool") * 48_271 % 2_147_483_647).alias("at"), "project", F.when(F.col("pool") % 13 == 0, "old").otherwise(F.col("token")).alias("token")
    ))
    pairs = m.withColumn("group_no", F.floor((F.col("rn") - 1) / 2)).join(asked, "pool")
    groups = pairs.groupBy("request", "pool", "group_no").agg(F.count("*").alias("k"), F.max(F.when(F.col("rn") % 2 == 1, F.col("cents"))).alias("amount")).filter("k = 2")
    groups = keep(groups.select("request", "group_no", F.when(F.col("pool") % 10 == 0, "match").otherwise("create").alias("mode"), "amount"))
    choices = keep(pairs.join(groups.select("request", "group_no"), ["request", "group_no"], "left_semi").select(
        "request", "group_no", (F.col("pool") * 100 + F.col("rn")).alias("id"), F.when(invoice, "voucher").otherwise("payment").alias("part"), (F.col("cents") % 3).alias("revision")
    ))
    log = creation.fingerprints(requests, groups, choices).filter("project % 17 = 0 OR project % 19 = 0")
    log = log.select("request", "project", F.when(F.col("project") % 17 == 0, F.col("fingerprint")).otherwise("other").alias("fingerprint"))
    used = table(spark, sf_dir, "part").filter("p_size > 45").select(F.concat(F.lit("number:"), F.col("p_partkey").cast("string"), F.lit("-0")).alias("claim"))
    return queue, requests, groups, choices, log, used


@register("material_registration")
def material_registration(spark, sf_dir):
    outcomes, created = creation.register(*registration_tables(spark, sf_dir), keep)
    made = created.groupBy("request").agg(F.count("*").alias("items"), F.sum("amount").alias("cents"), F.count_if(F.col("alignment") == "balanced").alias("balanced"))
    return outcomes.join(made, "request", "left").select("request", "at", "outcome", "reason", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "cents", "balanced")])


CARD_SQL = f"""k AS (SELECT pool * 100 + rn AS id, pool, rn, number, CASE WHEN pool % 4 = 0 THEN '' ELSE CAST(pool % 3 AS VARCHAR) END AS project, role, CAST(number AS VARCHAR) AS digest, cents % 3 AS revision,
    CASE number % 6 WHEN 0 THEN 'archived' WHEN 1 THEN 'review' WHEN 2 THEN 'deleted' WHEN 3 THEN 'unused' ELSE 'received' END AS status, blocked = 'O' AND number % 5 = 0 AS linked, number % 31 = 0 AS converted,
    role = 'payment' AND number % 7 = 0 AS needless, CASE WHEN number % 6 = 0 AND number % 4 < 3 THEN 'review' END AS archived_from, CASE WHEN number % 6 = 2 THEN CASE WHEN number % 4 = 0 THEN 'unused' ELSE 'archived' END END AS deleted_from FROM m)"""


def cards(spark, sf_dir):
    """Cards, a command for each, and digests that expenses have."""
    m, n = adapters.material(spark, sf_dir), F.col("number")
    at = n % 6
    queue = m.select(
        (F.col("pool") * 100 + F.col("rn")).alias("id"), F.when(F.col("pool") % 4 == 0, "").otherwise((F.col("pool") % 3).cast("string")).alias("project"), "role",
        F.when(at == 0, "archived").when(at == 1, "review").when(at == 2, "deleted").when(at == 3, "unused").otherwise("received").alias("status"), n.cast("string").alias("digest"),
        (F.col("cents") % 3).alias("revision"), ((F.col("blocked") == "O") & (n % 5 == 0)).alias("linked"), (n % 31 == 0).alias("converted"), ((F.col("role") == "payment") & (n % 7 == 0)).alias("needless"),
        F.when((at == 0) & (n % 4 < 3), "review").alias("archived_from"), F.when(at == 2, F.when(n % 4 == 0, "unused").otherwise("archived")).alias("deleted_from"),
    )
    action = F.when(F.col("rn") % 4 == 0, "archive").when(F.col("rn") % 4 == 1, "restore").when(F.col("rn") % 4 == 2, "delete").otherwise("restore-deleted")
    commands = m.filter("pool % 9 > 0").select((F.col("pool") * 100 + F.col("rn")).alias("id"), F.when(n % 13 == 0, -1).otherwise(F.col("cents") % 3).alias("revision"), F.when(n % 11 == 0, "9").otherwise((F.col("pool") % 3).cast("string")).alias("project"), action.alias("action"))
    held = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").cast("string").alias("digest"))
    return queue, commands, held


@register(
    "archive_cards",
    f"""WITH {M}, {CARD_SQL}, c AS (SELECT *, CASE WHEN pool % 9 > 0 THEN ['archive', 'restore', 'delete', 'restore-deleted'][1 + rn % 4] END AS action, CASE WHEN number % 13 = 0 THEN -1 ELSE revision END AS seen,
        CASE WHEN number % 11 = 0 THEN '9' ELSE CAST(pool % 3 AS VARCHAR) END AS asked, needless OR status = 'unused' AS out_of_use, number IN (SELECT p_partkey FROM part WHERE p_size = 7) AS held FROM k),
    j AS (SELECT *, CASE WHEN action IS NULL THEN 'none' WHEN seen <> revision THEN 'stale' WHEN project <> '' AND project <> asked THEN 'other project' WHEN held OR linked THEN 'linked' WHEN converted THEN 'converted'
        WHEN CASE action WHEN 'archive' THEN status IN ('received', 'review') AND NOT out_of_use WHEN 'restore' THEN status = 'archived' AND NOT out_of_use AND archived_from IS NOT NULL
            WHEN 'delete' THEN status IN ('archived', 'unused') OR (out_of_use AND status IN ('received', 'review')) ELSE status = 'deleted' AND deleted_from IS NOT NULL END THEN 'applied' ELSE 'not allowed' END AS outcome FROM c)
    SELECT id, CASE WHEN outcome <> 'applied' THEN status WHEN action = 'archive' THEN 'archived' WHEN action = 'delete' THEN 'deleted' WHEN action = 'restore' THEN archived_from ELSE deleted_from END AS status,
        CASE WHEN outcome <> 'applied' THEN archived_from WHEN action = 'archive' THEN status WHEN action = 'restore' THEN NULL ELSE archived_from END AS archived_from,
        CASE WHEN outcome <> 'applied' THEN deleted_from WHEN action = 'delete' THEN CASE WHEN out_of_use THEN 'unused' ELSE status END WHEN action = 'restore-deleted' THEN NULL ELSE deleted_from END AS deleted_from,
        CASE WHEN outcome = 'applied' THEN revision + 1 ELSE revision END AS revision, outcome FROM j""",
)
def archive_cards(spark, sf_dir):
    return ledger.archive(*cards(spark, sf_dir))


@register(
    "move_projects",
    """WITH e AS (SELECT o_orderkey AS id, o_custkey % 5 AS project, CASE WHEN o_orderkey % 7 = 0 THEN 'p' END AS person, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey - 1 END AS merged_into, CASE WHEN o_orderkey % 4 = 2 THEN o_orderkey * 10 END AS match_id,
        o_orderstatus = 'F' AS verified, o_orderstatus <> 'P' AS draft, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 6 END AS target FROM orders),
    bad AS (SELECT DISTINCT l_orderkey * 10 AS match_id FROM lineitem WHERE l_orderkey % 4 = 2 AND l_suppkey % 9 = 0),
    j AS (SELECT e.*, CASE WHEN target IS NULL THEN NULL WHEN merged_into IS NOT NULL THEN 'merged' WHEN person IS NOT NULL AND project <> target THEN 'has a person' WHEN match_id IS NOT NULL AND id % 10 = 0 THEN 'group changed'
        WHEN match_id IN (SELECT match_id FROM bad) THEN 'card changed' ELSE 'moved' END AS outcome FROM e)
    SELECT j.id, CASE WHEN j.outcome = 'moved' THEN j.target WHEN h.outcome = 'moved' THEN h.target ELSE j.project END AS project, j.merged_into,
        j.verified AND NOT (coalesce(j.outcome = 'moved', false) OR coalesce(h.outcome = 'moved', false)) AS verified, (coalesce(j.outcome = 'moved', false) OR coalesce(h.outcome = 'moved', false)) AND j.draft AS review,
        coalesce(j.outcome, CASE WHEN h.outcome = 'moved' THEN 'moved' ELSE 'none' END) AS outcome FROM j LEFT JOIN j h ON j.merged_into = h.id""",
)
def move_projects(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    expenses = o.select(
        key.alias("id"), (F.col("o_custkey") % 5).alias("project"), F.when(key % 7 == 0, "p").alias("person"), F.when(key % 4 == 3, key - 1).alias("merged_into"), F.when(key % 4 == 2, key * 10).alias("match_id"),
        (F.col("o_orderstatus") == "F").alias("verified"), F.when(F.col("o_orderstatus") == "P", "submitted").otherwise("draft").alias("stage"),
    )
    groups = o.filter(key % 4 == 2).select((key * 10).alias("match_id"), key.alias("item_id"), (F.col("o_custkey") % 5).alias("project"), (key % 10 == 0).alias("undone"))
    # Some cards of a group went to another expense since.
    cards = table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 = 2").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_suppkey") % 9 == 0, F.col("l_orderkey") + 2).otherwise(F.col("l_orderkey")).alias("item_id"),
        (F.col("l_orderkey") * 10).alias("match_id"), F.lit(0).cast("bigint").alias("project"), F.lit(0).alias("revision"),
    )
    moves = o.filter(key % 3 > 0).select(key.alias("id"), (key % 6).alias("target"))
    return ledger.move_project(expenses, cards, groups, moves)[0]
