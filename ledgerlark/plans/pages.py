"""Window, paging and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark import adapters
from ledgerlark.operators import windows as ops
from ledgerlark.plans.core import register
from ledgerlark.session import table

E = f"e AS ({adapters.EXPENSE_SQL})"
M = f"m AS ({adapters.MATERIAL_SQL})"
MSG = f"msg AS ({adapters.MESSAGE_SQL})"
RUNS = """r AS (SELECT *, sum(fresh) OVER (PARTITION BY chat ORDER BY second, id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN lag(second) OVER w IS NULL OR second - lag(second) OVER w > {gap} OR NOT ({member0}) THEN 1 ELSE 0 END AS fresh
    FROM msg WINDOW w AS (PARTITION BY chat ORDER BY second, id)))"""


@register("latest_per_key", f"WITH {MSG} SELECT chat, kind, max_by(id, second * 1000000 + id) AS id FROM msg GROUP BY chat, kind")
def latest_per_key(spark, sf_dir):
    return ops.latest(adapters.message(spark, sf_dir), ["chat", "kind"], "second", "id").select("chat", "kind", "id")


@register(
    "last_n_events",
    f"WITH {MSG}, r AS (SELECT chat, id, row_number() OVER (PARTITION BY chat ORDER BY second DESC, id DESC) AS place FROM msg) SELECT * FROM r WHERE place <= 30",
)
def last_n_events(spark, sf_dir):
    return ops.last_n(adapters.message(spark, sf_dir), ["chat"], 30, "second", "id").select("chat", "id", "place")


@register(
    "gap_sessions",
    f"WITH {MSG}, {RUNS.format(gap=3600, member0='true')} SELECT chat, CAST(run AS BIGINT) AS run, count(*) AS n, min(second) AS first, max(second) AS last FROM r GROUP BY chat, run",
)
def gap_sessions(spark, sf_dir):
    runs = ops.gap_runs(adapters.message(spark, sf_dir), ["chat"], time="second", tie="id", member=F.lit(True), gap=3600)
    return runs.groupBy("chat", "run").agg(F.count("*").alias("n"), F.min("second").alias("first"), F.max("second").alias("last"))


@register(
    "closed_image_runs",
    f"""WITH {MSG}, {RUNS.format(gap=86400, member0="lag(kind) OVER w IN ('view', 'click')")},
    g AS (SELECT chat, run, max(CASE WHEN kind = 'purchase' THEN id END) AS closing_id, count(*) FILTER (WHERE kind IN ('view', 'click')) AS members,
        min(CASE WHEN kind IN ('view', 'click') THEN id END) AS first_id, max(CASE WHEN kind IN ('view', 'click') THEN id END) AS last_id FROM r GROUP BY chat, run)
    SELECT chat, closing_id, members, first_id, last_id FROM g WHERE closing_id IS NOT NULL AND members > 0""",
)
def closed_image_runs(spark, sf_dir):
    member, closer = F.col("kind").isin("view", "click"), F.col("kind") == "purchase"
    return ops.closed_runs(adapters.message(spark, sf_dir), ["chat"], time="second", tie="id", member=member, closer=closer, gap=86_400)


@register("tie_ambiguity", f"WITH {MSG} SELECT second // 60 AS minute, count(*) AS n, count(DISTINCT local_id) AS \"distinct\" FROM msg GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT local_id) < count(*)")
def tie_ambiguity(spark, sf_dir):
    rows = adapters.message(spark, sf_dir).withColumn("minute", F.floor(F.col("second") / 60))
    return ops.tied(rows, ["minute"], "local_id")


@register(
    "pair_batches",
    f"""WITH {E}, c AS (SELECT *, CASE WHEN category = lag(category) OVER (PARTITION BY project ORDER BY id) THEN 0 ELSE 1 END AS ch FROM e),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY project ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM c),
    p AS (SELECT *, (row_number() OVER (PARTITION BY project, run ORDER BY id) - 1) // 2 AS pair FROM r)
    SELECT project, min(category) AS category, min(id) AS first, CASE WHEN count(*) = 2 THEN max(id) END AS second FROM p GROUP BY project, run, pair""",
)
def pair_batches(spark, sf_dir):
    return ops.adjacent_pairs(adapters.expense(spark, sf_dir), ["project"], "category", "id")


@register(
    "suffix_sums",
    f"WITH {M} SELECT pool, rn, CAST(sum(cents) OVER (PARTITION BY pool ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS \"left\" FROM m",
)
def suffix_sums(spark, sf_dir):
    return ops.suffix_sum(adapters.material(spark, sf_dir), ["pool"], "cents", "rn").select("pool", "rn", "left")


@register("snapshot_page", f"WITH {E} SELECT id, cents, (SELECT count(*) FROM e) AS total, (SELECT count(*) FROM e) > 300 AS has_more FROM e ORDER BY cents DESC, id LIMIT 100 OFFSET 200")
def snapshot_page(spark, sf_dir):
    return ops.page(adapters.expense(spark, sf_dir).select("id", "cents"), F.desc("cents"), "id", size=100, number=2)


@register("keyset_page", f"WITH {E} SELECT id, cents, true AS has_more FROM e WHERE id > 700 ORDER BY id LIMIT 50")
def keyset_page(spark, sf_dir):
    return ops.keyset_page(adapters.expense(spark, sf_dir).select("id", "cents"), "id", after=700, size=50)


@register("filtered_page", f"WITH {E}, f AS (SELECT id, cents FROM e WHERE stage = 'ready') SELECT id, cents, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 40 AS has_more FROM f ORDER BY id LIMIT 20 OFFSET 20")
def filtered_page(spark, sf_dir):
    return ops.page(adapters.expense(spark, sf_dir).filter("stage = 'ready'").select("id", "cents"), "id", size=20, number=1)


@register(
    "ranked_top",
    f"""WITH {M}, s AS (SELECT pool, count(*) AS support, count(DISTINCT person) > 1 AS review FROM m GROUP BY pool)
    SELECT pool, support, review, (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM s) > 100 AS has_more FROM s ORDER BY support DESC, review, pool LIMIT 100""",
)
def ranked_top(spark, sf_dir):
    found = adapters.material(spark, sf_dir).groupBy("pool").agg(F.count("*").alias("support"), (F.countDistinct("person") > 1).alias("review"))
    return ops.page(found, F.desc("support"), "review", "pool", size=100, number=0)


@register(
    "todo_order",
    f"""WITH {E}, o AS (SELECT id, CASE WHEN id % 3 <> 0 THEN expense_date END AS due, stage FROM e)
    SELECT id, stage, due FROM o ORDER BY stage DESC, due IS NULL, due, id LIMIT 500""",
)
def todo_order(spark, sf_dir):
    rows = adapters.expense(spark, sf_dir).select("id", "stage", F.when(F.col("id") % 3 != 0, F.col("expense_date")).alias("due"))
    return rows.orderBy(F.desc("stage"), F.col("due").isNull(), "due", "id").limit(500)


@register("latest_messages", f"WITH {MSG} SELECT id, chat, second FROM msg ORDER BY second DESC, id LIMIT 500")
def latest_messages(spark, sf_dir):
    return adapters.message(spark, sf_dir).select("id", "chat", "second").orderBy(F.desc("second"), "id").limit(500)


@register("fail_closed_limit", f"WITH {M}, c AS (SELECT *, count(*) OVER (PARTITION BY pool, role) AS n FROM m) SELECT pool, rn, role FROM c WHERE n <= 4")
def fail_closed_limit(spark, sf_dir):
    return ops.fail_closed(adapters.material(spark, sf_dir).select("pool", "rn", "role"), ["pool", "role"], 4)


@register("rowid_scan", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS seq FROM orders")
def rowid_scan(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))).alias("seq"))


@register(
    "ordered_point_lookup",
    f"WITH {MSG} SELECT msg.id AS pos, o_orderkey AS id, o_orderstatus AS status FROM msg JOIN orders ON o_orderkey = chat * 100 + local_id",
)
def ordered_point_lookup(spark, sf_dir):
    wanted = adapters.message(spark, sf_dir).select(F.col("id").alias("pos"), (F.col("chat") * 100 + F.col("local_id")).alias("k"))
    orders = table(spark, sf_dir, "orders")
    return wanted.join(orders, wanted["k"] == orders["o_orderkey"]).select("pos", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@register("entity_hydration", "SELECT o_orderkey AS id, count(l_orderkey) AS lines, array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (WHERE l_returnflag IS NOT NULL)), ',') AS flags FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def entity_hydration(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("lines"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(lines, "id", "left")
    return orders.select("id", F.coalesce("lines", F.lit(0)).alias("lines"), F.nullif(F.coalesce("flags", F.lit("")), F.lit("")).alias("flags"))
