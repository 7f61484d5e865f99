"""Lookup, routing and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark import adapters
from ledgerlark.operators import routing as ops
from ledgerlark.plans.core import register
from ledgerlark.session import table

E = f"e AS ({adapters.EXPENSE_SQL})"
M = f"m AS ({adapters.MATERIAL_SQL})"
MSG = f"msg AS ({adapters.MESSAGE_SQL})"

PERIODS = """p AS (SELECT n_name AS project, n_regionkey AS region, DATE '1992-01-01' + CAST(n_nationkey * 97 AS INTEGER) AS start0,
    CASE WHEN n_nationkey % 5 <> 0 THEN DATE '1992-01-01' + CAST(n_nationkey * 97 + 160 AS INTEGER) END AS end0 FROM nation)"""


def periods(spark, sf_dir):
    key = F.col("n_nationkey")
    start = F.date_add(F.lit("1992-01-01").cast("date"), key * 97)
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("project"), start.alias("start"), F.when(key % 5 != 0, F.date_add(start, F.lit(160))).alias("end")
    )


@register(
    "route_by_period",
    f"""WITH {E}, {PERIODS}, top AS (SELECT max(expense_date) AS t FROM e),
    h AS (SELECT e.id, min(p.project) AS low, count(DISTINCT p.project) AS n FROM e JOIN p ON e.expense_date >= p.start0 AND e.expense_date <= coalesce(p.end0, (SELECT t FROM top)) GROUP BY e.id)
    SELECT e.id, e.expense_date AS day, CASE WHEN n = 1 THEN low END AS project, coalesce(n, 0) AS matches FROM e LEFT JOIN h ON e.id = h.id""",
)
def route_by_period(spark, sf_dir):
    rows = adapters.expense(spark, sf_dir).select("id", F.col("expense_date").alias("day"))
    return ops.unique_interval(rows, periods(spark, sf_dir), at="day", key=["id"])


@register(
    "late_routes",
    f"""WITH {PERIODS}, m AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 3 AS INTEGER) AS b
        FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'),
    h AS (SELECT m.id, min(p.project) AS low, count(DISTINCT p.project) AS n FROM m JOIN p ON p.region <> 0 AND a >= p.start0 AND (p.end0 IS NULL OR b <= p.end0) GROUP BY m.id)
    SELECT m.id, CASE WHEN n = 1 THEN low ELSE d.project END AS project, CASE WHEN n = 1 THEN 'date' ELSE 'default' END AS reason
        FROM m LEFT JOIN h ON m.id = h.id, (SELECT n_name AS project FROM nation WHERE n_nationkey = 0) d""",
)
def late_routes(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "unassigned").otherwise("assigned").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("touched"), day.alias("first"), F.date_add(day, (F.col("o_custkey") % 3).cast("int")).alias("last"),
    )
    nations = table(spark, sf_dir, "nation")
    closed = nations.select(F.col("n_name").alias("project"), (F.col("n_regionkey") == 0).alias("reimbursed"))
    first = nations.filter("n_nationkey = 0").first()
    return ops.reroute_unassigned(rows, periods(spark, sf_dir).join(closed, "project"), first["n_name"])


@register(
    "phase_overlap",
    f"""WITH {MSG}, ph AS (SELECT n_nationkey AS phase, min0 + n_nationkey * 100000 AS start, min0 + n_nationkey * 100000 + 130000 AS stop FROM nation, (SELECT min(second) AS min0 FROM msg)),
    h AS (SELECT id, min(phase) AS low, count(*) AS n FROM msg JOIN ph ON second >= start AND second < stop GROUP BY id)
    SELECT msg.id, CASE WHEN n = 1 THEN low END AS phase, coalesce(n, 0) AS matches FROM msg LEFT JOIN h ON msg.id = h.id""",
)
def phase_overlap(spark, sf_dir):
    msgs = adapters.message(spark, sf_dir).select("id", "second")
    start = F.col("min0") + F.col("n_nationkey") * 100_000
    phases = table(spark, sf_dir, "nation").crossJoin(msgs.agg(F.min("second").alias("min0")))
    phases = F.broadcast(phases.select(F.col("n_nationkey").alias("phase"), start.alias("start"), (start + 130_000).alias("stop")))  # 25 rows
    cell = F.floor(F.col("second") / 100_000)
    cells = phases.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / 100_000), F.floor((F.col("stop") - 1) / 100_000))))
    hits = msgs.withColumn("cell", cell).join(cells, "cell").filter("second >= start AND second < stop")
    found = hits.groupBy("id").agg(F.min("phase").alias("low"), F.count("*").alias("n"))
    return msgs.join(found, "id", "left").select("id", F.when(F.col("n") == 1, F.col("low")).alias("phase"), F.coalesce("n", F.lit(0)).alias("matches"))


@register(
    "task_window_join",
    f"""WITH {MSG}, t AS (SELECT chat, id AS task, second AS ask_at FROM msg WHERE kind = 'purchase'),
    h AS (SELECT m.id, count(DISTINCT t.task) AS tasks, min(t.task) AS low FROM msg m JOIN t ON m.chat = t.chat AND m.second >= t.ask_at AND m.second < t.ask_at + 21600 WHERE m.kind <> 'purchase' GROUP BY m.id)
    SELECT id, tasks, CASE WHEN tasks = 1 THEN low END AS task FROM h""",
)
def task_window_join(spark, sf_dir):
    msgs, width = adapters.message(spark, sf_dir), 21_600
    tasks = msgs.filter("kind = 'purchase'").select("chat", F.col("id").alias("task"), F.col("second").alias("ask_at"))
    cells = tasks.withColumn("cell", F.explode(F.array(F.floor(F.col("ask_at") / width), F.floor(F.col("ask_at") / width) + 1)))
    rows = msgs.filter("kind <> 'purchase'").withColumn("cell", F.floor(F.col("second") / width))
    hits = rows.join(cells, ["chat", "cell"]).filter((F.col("second") >= F.col("ask_at")) & (F.col("second") < F.col("ask_at") + width))
    found = hits.groupBy("id").agg(F.countDistinct("task").alias("tasks"), F.min("task").alias("low"))
    return found.select("id", "tasks", F.when(F.col("tasks") == 1, F.col("low")).alias("task"))


@register(
    "dedup_digest",
    """SELECT doc_id AS id, sha256(text) AS digest, min(doc_id) OVER w AS keep_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY sha256(text))""",
)
def dedup_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    groups = rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    return rows.join(groups, "digest")


@register(
    "duplicate_lookup_or",
    f"""WITH {E}, k AS (SELECT * FROM e WHERE stage = 'draft'), r AS (SELECT * FROM e WHERE stage = 'submitted'),
    h AS (SELECT id, 'cents' AS why FROM r WHERE cents IN (SELECT cents FROM k) UNION SELECT id, 'merchant' FROM r WHERE merchant IN (SELECT merchant FROM k))
    SELECT id, string_agg(why, ',' ORDER BY why) AS reasons FROM h GROUP BY id""",
)
def duplicate_lookup_or(spark, sf_dir):
    rows = adapters.expense(spark, sf_dir)
    return ops.duplicates_by_any(rows.filter("stage = 'submitted'"), rows.filter("stage = 'draft'"), ["cents", "merchant"])


@register(
    "supplement_unique_number",
    f"""WITH {M}, g AS (SELECT number, person, min(pool) AS pool0 FROM m WHERE role = 'invoice' GROUP BY number, person HAVING count(DISTINCT pool) = 1)
    SELECT m.pool, m.rn, m.number, m.person, g.pool0 AS target FROM m JOIN g ON m.number = g.number AND m.person = g.person WHERE m.role = 'payment'""",
)
def supplement_unique_number(spark, sf_dir):
    rows = adapters.material(spark, sf_dir)
    groups = rows.filter("role = 'invoice'").select("number", "person", F.col("pool").alias("target"))
    found = ops.unique_lookup(rows.filter("role = 'payment'"), groups, ["number", "person"], "target")
    return found.select("pool", "rn", "number", "person", "target")


@register("identity_owners", f"WITH {M}, o AS (SELECT number, count(DISTINCT pool) AS n FROM m GROUP BY number) SELECT DISTINCT m.pool, m.number, n - 1 AS others FROM m JOIN o ON m.number = o.number")
def identity_owners(spark, sf_dir):
    return ops.owners_elsewhere(adapters.material(spark, sf_dir), "pool", "number")


@register(
    "left_outer_attention",
    """SELECT event_id AS id, coalesce(o_orderstatus, c_mktsegment, 'none') AS owner FROM events
    LEFT JOIN orders ON 'o:' || event_id = 'o:' || o_orderkey LEFT JOIN customer ON 'c:' || user_id = 'c:' || c_custkey""",
)
def left_outer_attention(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    orders = table(spark, sf_dir, "orders").select(key("o:", "o_orderkey").alias("ok"), "o_orderstatus")
    people = table(spark, sf_dir, "customer").select(key("c:", "c_custkey").alias("ck"), "c_mktsegment")
    joined = events.withColumns({"ok": key("o:", "event_id"), "ck": key("c:", "user_id")}).join(orders, "ok", "left").join(people, "ck", "left")
    return joined.select(F.col("event_id").alias("id"), F.coalesce("o_orderstatus", "c_mktsegment", F.lit("none")).alias("owner"))


@register("enabled_anti_flag", "SELECT c_custkey AS id, o.k IS NULL AS enabled FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o.k")
def enabled_anti_flag(spark, sf_dir):
    off = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("k")).distinct()
    return table(spark, sf_dir, "customer").join(off, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("k").isNull().alias("enabled"))


@register(
    "missing_media_anti",
    f"WITH {MSG} SELECT id, chat, local_id FROM msg m WHERE kind = 'view' AND NOT EXISTS (SELECT 1 FROM msg x WHERE x.kind = 'click' AND x.chat = m.chat AND x.local_id = m.local_id)",
)
def missing_media_anti(spark, sf_dir):
    msgs = adapters.message(spark, sf_dir)
    media = msgs.filter("kind = 'click'").select("chat", "local_id")
    return msgs.filter("kind = 'view'").join(media, ["chat", "local_id"], "left_anti").select("id", "chat", "local_id")


@register(
    "recovered_media",
    f"""WITH {MSG}, c AS (SELECT DISTINCT chat, local_id, 'cached' AS origin FROM msg WHERE kind = 'click'), r AS (SELECT DISTINCT chat, local_id, 'recovered' AS origin FROM msg WHERE kind = 'view')
    SELECT * FROM c UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.chat = r.chat AND c.local_id = r.local_id)""",
)
def recovered_media(spark, sf_dir):
    msgs = adapters.message(spark, sf_dir)
    of = lambda kind, name: msgs.filter(F.col("kind") == kind).select("chat", "local_id", F.lit(name).alias("origin")).distinct()
    return ops.with_priority(of("click", "cached"), of("view", "recovered"), ["chat", "local_id"])


@register(
    "canonical_person",
    """WITH RECURSIVE p AS (SELECT s_suppkey AS person, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey - 1 END AS up FROM supplier WHERE s_suppkey >= 1),
    q AS (SELECT person, up, person AS root FROM p WHERE up IS NULL UNION ALL SELECT p.person, p.up, q.root FROM p JOIN q ON p.up = q.person)
    SELECT person, root FROM q""",
)
def canonical_person(spark, sf_dir):
    key = F.col("s_suppkey")
    people = table(spark, sf_dir, "supplier").filter("s_suppkey >= 1").select(key.alias("person"), F.when(key % 4 != 1, key - 1).alias("merged_into"))
    from ledgerlark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return ops.canonical(people)


@register(
    "linked_closure",
    """WITH RECURSIVE g AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 31) % (SELECT count(*) FROM customer) AS dst FROM orders),
    r AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0 UNION SELECT g.dst FROM r JOIN g ON r.node = g.src) SELECT node FROM r""",
)
def linked_closure(spark, sf_dir):
    from ledgerlark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    people = table(spark, sf_dir, "customer")
    ends = F.broadcast(people.agg(F.count("*").alias("n")))
    edges = table(spark, sf_dir, "orders").crossJoin(ends).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31) % F.col("n")).alias("dst")).distinct()
    return ops.closure(people.filter("c_mktsegment = 'BUILDING' AND c_acctbal < 0").select(F.col("c_custkey").alias("node")), edges)


@register(
    "preference_lookup",
    f"WITH {E} SELECT merchant, owner AS kind, CASE WHEN min(category) = max(category) THEN min(category) END AS category, min(category) <> max(category) AS conflict FROM e GROUP BY merchant, owner",
)
def preference_lookup(spark, sf_dir):
    rows = adapters.expense(spark, sf_dir).withColumnRenamed("owner", "kind")
    return ops.consistent_preference(rows, ["merchant"], "kind", "category")


@register(
    "strongest_transport_pairs",
    f"""WITH {M}, p AS (SELECT a.pool, a.rn AS trip, b.rn AS invoice, CASE WHEN a.number = b.number THEN 3 WHEN a.person = b.person THEN 2 ELSE 1 END AS rank
        FROM m a JOIN m b ON a.pool = b.pool AND a.cents = b.cents WHERE a.role = 'payment' AND b.role = 'invoice'),
    s AS (SELECT *, max(rank) OVER (PARTITION BY pool, trip) AS l, max(rank) OVER (PARTITION BY pool, invoice) AS r FROM p)
    SELECT pool, trip, invoice, rank FROM s WHERE rank = l AND rank = r""",
)
def strongest_transport_pairs(spark, sf_dir):
    rows = adapters.material(spark, sf_dir)
    side = lambda role, name: rows.filter(F.col("role") == role).select("pool", "cents", F.col("rn").alias(name), F.col("number").alias(f"{name}_no"), F.col("person").alias(f"{name}_by"))
    both = side("payment", "trip").join(side("invoice", "invoice"), ["pool", "cents"])
    rank = F.when(F.col("trip_no") == F.col("invoice_no"), 3).when(F.col("trip_by") == F.col("invoice_by"), 2).otherwise(1)
    both = both.select("pool", F.struct("pool", "trip").alias("l"), F.struct("pool", "invoice").alias("r"), "trip", "invoice", rank.alias("rank"))
    return ops.strongest_pairs(both, "l", "r", "rank").select("pool", "trip", "invoice", "rank")


@register(
    "used_digest_union",
    "SELECT event_id AS id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT s_suppkey FROM supplier)",
)
def used_digest_union(spark, sf_dir):
    used = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    used = used.union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()
    return table(spark, sf_dir, "events").join(used, "user_id", "left_anti").select(F.col("event_id").alias("id"))


@register("voucher_minus_paid", f"WITH {M} SELECT DISTINCT pool FROM m WHERE role = 'invoice' EXCEPT SELECT pool FROM m WHERE role = 'payment'")
def voucher_minus_paid(spark, sf_dir):
    rows = adapters.material(spark, sf_dir)
    return rows.filter("role = 'invoice'").select("pool").subtract(rows.filter("role = 'payment'").select("pool"))


@register("shared_numbers", f"WITH {M} SELECT number FROM m WHERE role = 'invoice' AND person = 'A' INTERSECT SELECT number FROM m WHERE role = 'payment' AND person = 'A'")
def shared_numbers(spark, sf_dir):
    rows = adapters.material(spark, sf_dir).filter("person = 'A'")
    return rows.filter("role = 'invoice'").select("number").intersect(rows.filter("role = 'payment'").select("number"))


@register("active_chats", f"WITH {MSG} SELECT DISTINCT chat, kind FROM msg WHERE value > 100")
def active_chats(spark, sf_dir):
    return adapters.message(spark, sf_dir).filter("value > 100").select("chat", "kind").distinct()


@register(
    "or_association",
    f"WITH {E} SELECT e.id, c_custkey AS item FROM e JOIN customer ON e.merchant = c_custkey UNION SELECT e.id, c_custkey FROM e JOIN customer ON 'intake:' || e.id = 'intake:' || c_custkey",
)
def or_association(spark, sf_dir):
    rows, items = adapters.expense(spark, sf_dir).select("id", "merchant"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"))
    one = rows.join(items, rows["merchant"] == items["item"]).select("id", "item")
    tag = lambda c: F.concat(F.lit("intake:"), F.col(c))
    two = rows.withColumn("k", tag("id")).join(items.withColumn("k", tag("item")), "k").select("id", "item")
    return one.union(two).distinct()


@register(
    "slot_assignment",
    """WITH s AS (SELECT c_nationkey AS site, c_custkey AS plate, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer),
    o AS (SELECT o_custkey AS plate, min(o_orderkey) AS low, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT site, plate, place // 2 AS slot_pair, CASE WHEN n = 1 THEN low END AS candidate FROM s LEFT JOIN o USING (plate)""",
)
def slot_assignment(spark, sf_dir):
    from pyspark.sql import Window

    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_custkey").alias("plate"))
    people = people.withColumn("place", F.dense_rank().over(Window.partitionBy("site").orderBy("plate")) - 1)
    runs = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("plate")).agg(F.min("o_orderkey").alias("low"), F.count("*").alias("n"))
    return people.join(runs, "plate", "left").select("site", "plate", F.floor(F.col("place") / 2).alias("slot_pair"), F.when(F.col("n") == 1, F.col("low")).alias("candidate"))


@register(
    "invoice_number_reuse",
    f"""WITH {M}, u AS (SELECT number, pool FROM m WHERE blocked = 'F' UNION SELECT number, pool FROM m WHERE role = 'payment' UNION
        SELECT p_partkey, -1 FROM part WHERE p_size > 48 UNION SELECT number, pool FROM m WHERE person = 'R'),
    c AS (SELECT number, count(DISTINCT pool) AS n FROM u GROUP BY number)
    SELECT pool, rn, m.number FROM m JOIN c ON m.number = c.number WHERE role = 'invoice' AND person = 'N' AND n > 1""",
)
def invoice_number_reuse(spark, sf_dir):
    rows = adapters.material(spark, sf_dir)
    used = [rows.filter(t).select("number", "pool") for t in ("blocked = 'F'", "role = 'payment'", "person = 'R'")]
    used.append(table(spark, sf_dir, "part").filter("p_size > 48").select(F.col("p_partkey").alias("number"), F.lit(-1).cast("bigint").alias("pool")))
    every = used[0].union(used[1]).union(used[2]).union(used[3])
    again = every.groupBy("number").agg(F.countDistinct("pool").alias("n")).filter("n > 1").select("number")
    return rows.filter("role = 'invoice' AND person = 'N'").join(again, "number", "left_semi").select("pool", "rn", "number")
