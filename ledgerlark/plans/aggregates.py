"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark import adapters
from ledgerlark.operators import aggregates as ops
from ledgerlark.plans.core import register
from ledgerlark.session import table

E = f"e AS ({adapters.EXPENSE_SQL})"
M = f"m AS ({adapters.MATERIAL_SQL})"
ALLOCATION = """SELECT owner, count(*) AS items, CAST(sum(cents) AS BIGINT) AS cents,
    CAST(sum(CASE WHEN stage IN ('submitted', 'reimbursed') THEN cents ELSE 0 END) AS BIGINT) AS packaged,
    CAST(sum(CASE WHEN stage = 'ready' THEN cents ELSE 0 END) AS BIGINT) AS ready,
    CAST(sum(CASE WHEN stage NOT IN ('submitted', 'reimbursed', 'ready') THEN cents ELSE 0 END) AS BIGINT) AS pending FROM e {where} GROUP BY owner"""


@register("person_allocation", f"WITH {E} " + ALLOCATION.format(where=""))
def person_allocation(spark, sf_dir):
    return ops.person_allocation(adapters.expense(spark, sf_dir))


@register(
    "zero_filled_summary",
    f"""WITH {E}, a AS ({ALLOCATION.format(where="")}),
    p AS (SELECT DISTINCT c_mktsegment AS owner FROM customer UNION ALL SELECT '')
    SELECT p.owner, coalesce(items, 0) AS items, coalesce(cents, 0) AS cents, coalesce(packaged, 0) AS packaged,
        coalesce(ready, 0) AS ready, coalesce(pending, 0) AS pending FROM p LEFT JOIN a ON p.owner = a.owner""",
)
def zero_filled_summary(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("owner"))
    return ops.zero_filled(people, ops.person_allocation(adapters.expense(spark, sf_dir)))


@register(
    "active_expense_filter",
    f"""WITH {E}, s AS (SELECT id % 5000 AS id, id AS seq, cents, CASE id % 7 WHEN 0 THEN 'deleted' WHEN 3 THEN 'returned' ELSE stage END AS status FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM s WHERE status NOT IN ('deleted', 'merged', 'cancelled', 'returned', 'archived'))
    SELECT id, seq, cents, status FROM r WHERE n = 1""",
)
def active_expense_filter(spark, sf_dir):
    status = F.when(F.col("id") % 7 == 0, "deleted").when(F.col("id") % 7 == 3, "returned").otherwise(F.col("stage"))
    rows = adapters.expense(spark, sf_dir).select((F.col("id") % 5000).alias("id"), F.col("id").alias("seq"), "cents", status.alias("status"))
    return ops.active_expenses(rows)


@register(
    "correction_rate",
    """WITH o AS (SELECT lang AS field, source, doc_id AS id FROM documents), c AS (SELECT lang AS field, source, d.doc_id AS id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0),
    t AS (SELECT field, source, count(DISTINCT id) AS observed FROM (SELECT * FROM o UNION ALL SELECT * FROM c) GROUP BY ALL),
    w AS (SELECT field, source, count(DISTINCT id) AS corrected FROM c GROUP BY ALL)
    SELECT t.field, t.source, observed, coalesce(corrected, 0) AS corrected, coalesce(corrected, 0) / observed AS rate
    FROM t LEFT JOIN w ON t.field = w.field AND t.source = w.source""",
)
def correction_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("field"), "source", F.col("doc_id").alias("id"))
    wrong = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return ops.correction_rate(docs, docs.join(wrong, "id", "left_semi"))


@register(
    "recognition_quality",
    r"""WITH r AS (SELECT lang AS type, 'quality' AS field, CAST(quality AS VARCHAR) AS gold,
        CASE WHEN n_chars > 5000 THEN NULL WHEN n_chars > 300 THEN ' 1' ELSE '0 ' END AS predicted FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    n AS (SELECT type, field, lower(regexp_replace(gold, '\s+', '', 'g')) AS g, coalesce(lower(regexp_replace(predicted, '\s+', '', 'g')), '') AS p FROM r),
    c AS (SELECT type, field, count(*) FILTER (WHERE g <> '') AS eligible, count(*) FILTER (WHERE g <> '' AND p <> '') AS extracted,
        count(*) FILTER (WHERE g <> '' AND g = p) AS correct FROM n GROUP BY ALL)
    SELECT *, CASE WHEN extracted > 0 THEN correct / extracted END AS accuracy, CASE WHEN eligible > 0 THEN extracted / eligible END AS coverage FROM c""",
)
def recognition_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    guess = F.when(F.col("n_chars") > 5000, None).when(F.col("n_chars") > 300, " 1").otherwise("0 ")
    return ops.recognition_quality(rows.select(
        F.col("lang").alias("type"), F.lit("quality").alias("field"), F.col("quality").cast("string").alias("gold"), guess.alias("predicted")
    ))


@register(
    "project_readiness",
    f"""WITH {E} SELECT project, count(*) FILTER (WHERE stage <> 'draft') AS verified,
    CAST(sum(CASE WHEN stage <> 'draft' THEN cents ELSE 0 END) AS BIGINT) AS verified_cents, count(*) FILTER (WHERE stage = 'draft') AS pending FROM e GROUP BY project""",
)
def project_readiness(spark, sf_dir):
    return ops.readiness(adapters.expense(spark, sf_dir))


@register("outcome_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def outcome_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@register(
    "index_totals",
    f"WITH {E} SELECT category, CAST(sum(CASE WHEN cents % 10 <> 0 THEN cents END) AS BIGINT) AS cents, count(*) FILTER (WHERE cents % 10 = 0) AS unresolved FROM e GROUP BY 1",
)
def index_totals(spark, sf_dir):
    known = F.when(F.col("cents") % 10 != 0, F.col("cents"))
    return adapters.expense(spark, sf_dir).groupBy("category").agg(F.sum(known).alias("cents"), F.count_if(known.isNull()).alias("unresolved"))


@register(
    "room_capacity",
    """WITH r AS (SELECT p_brand AS hotel, p_partkey % 40 AS room, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'king' ELSE 'twin' END AS room_type,
        CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size % 3 END AS occupants, CASE WHEN p_size > 45 THEN 6 END AS override, p_size = 50 AND p_partkey % 2 = 0 AS exclusive FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY hotel, room ORDER BY seq) AS n,
        CASE WHEN exclusive THEN 1 ELSE coalesce(override, CASE room_type WHEN 'king' THEN 2 WHEN 'twin' THEN 4 END) END AS b FROM r),
    g AS (SELECT hotel, count(*) FILTER (WHERE n = 1) AS rooms, count(*) FILTER (WHERE n > 1 OR b IS NULL OR occupants IS NULL OR occupants > b) AS issues,
        CAST(sum(CASE WHEN n = 1 THEN b END) AS BIGINT) AS beds, CAST(sum(CASE WHEN n = 1 THEN b - occupants END) AS BIGINT) AS free FROM n GROUP BY hotel)
    SELECT hotel, rooms, issues, CASE WHEN issues = 0 THEN beds END AS beds, CASE WHEN issues = 0 THEN free END AS free,
        CASE WHEN issues = 0 THEN CAST(ceil(greatest(0, 100 - free) / 4) AS BIGINT) END AS extra_rooms FROM g""",
)
def room_capacity(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    rooms = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("hotel"), (key % 40).alias("room"), key.alias("seq"), F.when(key % 3 == 0, "king").otherwise("twin").alias("room_type"),
        F.when(key % 97 != 0, size % 3).alias("occupants"), F.when(size > 45, 6).alias("override"), ((size == 50) & (key % 2 == 0)).alias("exclusive"),
    )
    return ops.room_capacity(rooms, arriving=100)


@register("consensus_value", f"WITH {M} SELECT pool, CASE WHEN min(person) = max(person) THEN min(person) END AS value, count(*) AS n FROM m GROUP BY pool")
def consensus_value(spark, sf_dir):
    return ops.consensus(adapters.material(spark, sf_dir), ["pool"], "person")


@register("repeated_identity", f"WITH {M} SELECT role, number, count(*) AS n FROM m WHERE person <> 'N' GROUP BY role, number HAVING count(*) > 1")
def repeated_identity(spark, sf_dir):
    return ops.repeated_identities(adapters.material(spark, sf_dir).filter("person <> 'N'"), ["role", "number"])


@register(
    "eval_percentile",
    """WITH r AS (SELECT lang, n_chars, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r FROM documents)
    SELECT lang, n_chars AS value, n FROM r WHERE r = ceil(n * 0.95)""",
)
def eval_percentile(spark, sf_dir):
    return ops.nearest_rank(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 0.95)


@register(
    "report_snapshot",
    f"""WITH {E}, s AS (SELECT project, category, min(id) AS low0 FROM e GROUP BY ALL),
    p AS (SELECT project, category, least(row_number() OVER (PARTITION BY project ORDER BY low0, category) + 23, 26) AS row FROM s),
    c AS (SELECT e.project, row, e.category, sum(cents) AS cents, count(*) AS items, min(id) AS low, max(id) AS high FROM e JOIN p ON e.project = p.project AND e.category = p.category GROUP BY ALL)
    SELECT project, row, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(items) AS BIGINT) AS items, string_agg(category, ';' ORDER BY low, category) AS names,
        min(low) AS first_id, max(high) AS last_id FROM c GROUP BY project, row""",
)
def report_snapshot(spark, sf_dir):
    return ops.report_snapshot(adapters.expense(spark, sf_dir))


@register(
    "lru_keep",
    f"""WITH {E}, h AS (SELECT project, id AS key, cents AS size, sum(cents) OVER (PARTITION BY project ORDER BY expense_date DESC, id DESC ROWS UNBOUNDED PRECEDING) AS held FROM e)
    SELECT project, key, size, CAST(held AS BIGINT) AS held FROM h WHERE held <= 500000000""",
)
def lru_keep(spark, sf_dir):
    rows = adapters.expense(spark, sf_dir).select("project", F.col("id").alias("key"), F.col("cents").alias("size"), F.col("expense_date").alias("accessed"))
    return ops.lru_keep(rows, limit=500_000_000, keys=["project"]).drop("accessed")


@register(
    "period_bounds",
    f"""WITH {E}, x AS (SELECT project, CASE WHEN id % 500 <> 0 THEN expense_date END AS d FROM e)
    SELECT project, min(d) AS first, max(d) AS last, count(*) FILTER (WHERE d IS NULL) > 0 AS partial FROM x GROUP BY project""",
)
def period_bounds(spark, sf_dir):
    rows = adapters.expense(spark, sf_dir).select("project", F.when(F.col("id") % 500 != 0, F.col("expense_date")).alias("d"))
    return ops.period_bounds(rows, ["project"], "d")


@register(
    "cross_item_duplicates",
    f"WITH {M} SELECT number, role, min(pool) AS low, max(pool) AS high, count(DISTINCT pool) AS items FROM m GROUP BY number, role HAVING count(DISTINCT pool) > 1",
)
def cross_item_duplicates(spark, sf_dir):
    return ops.cross_item_duplicates(adapters.material(spark, sf_dir), ["number", "role"], "pool")


@register(
    "personnel_ledger",
    f"""WITH msg AS ({adapters.MESSAGE_SQL}), r AS (SELECT CAST(ts AS DATE) AS day, chat AS person, kind AS label FROM msg),
    o AS (SELECT DISTINCT chat AS person, 'handoff' AS override FROM msg WHERE chat % 11 = 0)
    SELECT day, coalesce(override, label) AS label, count(*) AS n, array_to_string(list_sort(list(DISTINCT r.person)), ',') AS people
    FROM r LEFT JOIN o ON r.person = o.person GROUP BY 1, 2""",
)
def personnel_ledger(spark, sf_dir):
    rows = adapters.message(spark, sf_dir).select(F.col("ts").cast("date").alias("day"), F.col("chat").alias("person"), F.col("kind").alias("label"))
    over = rows.filter("person % 11 = 0").select("person", F.lit("handoff").alias("override")).distinct()
    return ops.personnel_ledger(rows, over)


@register(
    "import_counters",
    "SELECT event_type AS outcome, count(*) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY 1",
)
def import_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("keys"))


@register(
    "merge_preview",
    f"""WITH {E} SELECT merchant, count(*) AS items, CAST(sum(cents) AS BIGINT) AS before_cents, max(cents) AS kept_cents,
    min(owner) = max(owner) AND min(project) = max(project) AS allowed FROM e GROUP BY merchant HAVING count(*) > 1""",
)
def merge_preview(spark, sf_dir):
    one = lambda c: F.min(c) == F.max(c)
    return adapters.expense(spark, sf_dir).groupBy("merchant").agg(
        F.count("*").alias("items"), F.sum("cents").alias("before_cents"), F.max("cents").alias("kept_cents"), (one("owner") & one("project")).alias("allowed")
    ).filter("items > 1")


@register(
    "stage_timings",
    """SELECT user_id % 10 AS stage, event_type AS tool, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths,
    count(*) FILTER (WHERE value > 200) AS slow FROM events GROUP BY 1, 2""",
)
def stage_timings(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("stage"), F.col("event_type").alias("tool")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("hundredths"), F.count_if(F.col("value") > 200).alias("slow")
    )


@register("next_due", f"WITH msg AS ({adapters.MESSAGE_SQL}) SELECT kind, min(least(second + local_id * 60, second + 86400)) AS due FROM msg GROUP BY kind")
def next_due(spark, sf_dir):
    due = F.least(F.col("second") + F.col("local_id") * 60, F.col("second") + 86400)
    return adapters.message(spark, sf_dir).groupBy("kind").agg(F.min(due).alias("due"))


@register(
    "recent_stage_timings",
    f"""WITH msg AS ({adapters.MESSAGE_SQL}), r AS (SELECT kind AS stage, CAST(round(value * 100) AS BIGINT) AS spent, local_id % 9 = 0 AS failed, row_number() OVER (PARTITION BY kind ORDER BY second DESC, id DESC) AS place FROM msg)
    SELECT stage, count(*) AS steps, CAST(sum(spent) AS BIGINT) AS spent, max(spent) AS longest, count(*) FILTER (WHERE failed) AS errors FROM r WHERE place <= 256 GROUP BY stage""",
)
def recent_stage_timings(spark, sf_dir):
    rows = adapters.message(spark, sf_dir).select(
        F.col("kind").alias("stage"), "second", "id", F.round(F.col("value") * 100).cast("bigint").alias("spent"), (F.col("local_id") % 9 == 0).alias("failed")
    )
    return ops.recent_timings(rows)
