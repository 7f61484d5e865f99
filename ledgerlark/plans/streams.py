"""Batch twins of the ordered and stateful operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark import adapters
from ledgerlark.plans.core import register
from ledgerlark.streaming import ingest, timers

MSG = f"msg AS ({adapters.MESSAGE_SQL})"
#: A second within the events' time range. A fixed value.
NOW = 1_768_000_000


@register(
    "checkpoint_replay",
    f"""WITH {MSG}, b AS (SELECT chat, second // 86400 AS no, min(second) AS first, max(second) AS last, count(*) FILTER (WHERE kind = 'error') = 0 AND max(local_id) < 98 AS safe FROM msg GROUP BY 1, 2)
    SELECT chat, no, greatest(min(first) OVER (PARTITION BY chat), coalesce(max(CASE WHEN safe THEN last END) OVER (PARTITION BY chat ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 120,
        min(first) OVER (PARTITION BY chat))) AS read_from,
        max(CASE WHEN safe THEN last END) OVER (PARTITION BY chat ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS checkpoint FROM b""",
)
def checkpoint_replay(spark, sf_dir):
    safe = (F.count_if(F.col("kind") == "error") == 0) & (F.max("local_id") < 98)
    batches = adapters.message(spark, sf_dir).groupBy("chat", F.floor(F.col("second") / 86_400).alias("no")).agg(
        F.min("second").alias("first"), F.max("second").alias("last"), safe.alias("safe")
    )
    return ingest.replay_windows(batches)


@register(
    "conflicting_replay",
    f"""WITH {MSG} SELECT chat, local_id, count(*) AS arrivals, CASE WHEN min(kind) = max(kind) THEN min(kind) END AS kind, min(kind) <> max(kind) AS conflict FROM msg GROUP BY chat, local_id""",
)
def conflicting_replay(spark, sf_dir):
    return ingest.ingest_once(adapters.message(spark, sf_dir), ["chat", "local_id"], "kind")


@register(
    "rate_limited",
    f"""WITH RECURSIVE {MSG}, o AS (SELECT chat AS object, id, second, row_number() OVER (PARTITION BY chat ORDER BY second, id) AS n FROM msg),
    f AS (SELECT object, id, second, n, true AS emitted, [second] AS sent FROM o WHERE n = 1
        UNION ALL SELECT o.object, o.id, o.second, o.n, len(list_filter(f.sent, lambda s: s > o.second - 86400)) < 3,
            CASE WHEN len(list_filter(f.sent, lambda s: s > o.second - 86400)) < 3 THEN list_append(list_filter(f.sent, lambda s: s > o.second - 86400), o.second) ELSE f.sent END
        FROM f JOIN o ON o.object = f.object AND o.n = f.n + 1)
    SELECT object, id, second, emitted FROM f""",
)
def rate_limited(spark, sf_dir):
    return ingest.rate_limited(adapters.message(spark, sf_dir).select(F.col("chat").alias("object"), "id", "second"))


@register(
    "outbox_state",
    f"""WITH {MSG}, c AS (SELECT chat AS project, id AS seq, local_id AS item, kind <> 'error' AS verified, CASE WHEN kind <> 'error' THEN id END AS entry FROM msg),
    s AS (SELECT *, entry IS DISTINCT FROM lag(entry) OVER (PARTITION BY project, item ORDER BY seq) AS fresh FROM c),
    v AS (SELECT *, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY project ORDER BY seq) AS BIGINT) AS version FROM s),
    e AS (SELECT project, version, max(seq) AS seq FROM v WHERE version > 0 GROUP BY project, version)
    SELECT project, version, CASE WHEN version = max(version) OVER (PARTITION BY project) THEN 'pending' ELSE 'superseded' END AS status,
        (SELECT count(*) FROM c a WHERE a.project = e.project AND a.verified AND a.seq = (SELECT max(b.seq) FROM c b WHERE b.project = a.project AND b.item = a.item AND b.seq <= e.seq)) AS verified_items FROM e""",
)
def outbox_state(spark, sf_dir):
    changes = adapters.message(spark, sf_dir).select(
        F.col("chat").alias("project"), F.col("id").alias("seq"), F.col("local_id").alias("item"), (F.col("kind") != "error").alias("verified"), F.col("id").alias("version")
    )
    return ingest.outbox(changes)


@register("version_chain")
def version_chain(spark, sf_dir):
    rows = adapters.message(spark, sf_dir).select(F.col("chat").alias("key"), F.col("id").alias("seq"), F.col("kind").alias("fingerprint"))
    return ingest.version_chain(rows)


@register("task_event_fold")
def task_event_fold(spark, sf_dir):
    events = adapters.message(spark, sf_dir).filter("kind IN ('purchase', 'click', 'view')")
    kind = F.when(F.col("kind") == "purchase", "set").when(F.col("kind") == "click", "add").otherwise("subtract")
    events = events.select(F.col("chat").alias("task"), F.col("second").alias("at"), "id", kind.alias("kind"), F.col("local_id").alias("number"))
    return ingest.apply_in_order(events.select("task").distinct(), events)


@register(
    "escalation_stage",
    f"""WITH {MSG} SELECT id AS task, CASE WHEN {NOW} > second + 7200 THEN 'cancelled' WHEN {NOW} - second >= 3600 THEN 'escalate' WHEN {NOW} - second >= 1800 THEN 'direct'
    WHEN {NOW} - second >= 0 THEN 'group' ELSE 'waiting' END AS stage FROM msg""",
)
def escalation_stage(spark, sf_dir):
    tasks = adapters.message(spark, sf_dir).select(F.col("id").alias("task"), F.col("second").alias("ask_at"), (F.col("second") + 7200).alias("deadline"))
    return ingest.escalation(tasks, NOW)


@register(
    "retry_schedule",
    f"""WITH {MSG}, r AS (SELECT id, second AS created, local_id % 8 AS attempts, kind = 'error' AS failed FROM msg),
    s AS (SELECT *, CASE WHEN NOT failed THEN 'done' WHEN {NOW} - created >= 86400 THEN 'expired' ELSE 'pending' END AS status FROM r)
    SELECT id, status, CASE WHEN status = 'pending' THEN {NOW} + least(3600, 60 * CAST(pow(2, attempts) AS BIGINT)) END AS retry_at FROM s""",
)
def retry_schedule(spark, sf_dir):
    rows = adapters.message(spark, sf_dir).select("id", F.col("second").alias("created"), (F.col("local_id") % 8).alias("attempts"), (F.col("kind") == "error").alias("failed"))
    return ingest.retry_schedule(rows, NOW)


@register(
    "cron_catch_up",
    f"SELECT o_custkey AS task, max({NOW} - {NOW} % 86400 + o_orderkey % 86400) AS due FROM orders WHERE {NOW} - {NOW} % 86400 + o_orderkey % 86400 <= {NOW} GROUP BY 1",
)
def cron_catch_up(spark, sf_dir):
    from ledgerlark.session import table

    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 86_400).alias("at"))
    return ingest.due_occurrences(tasks, NOW)


@register(
    "rescue_stuck",
    f"""WITH {MSG} SELECT id FROM msg m WHERE kind = 'view' AND second < {NOW} AND NOT EXISTS (SELECT 1 FROM msg b WHERE b.kind = 'click' AND b.chat = m.chat AND b.local_id = m.local_id)
    AND NOT EXISTS (SELECT 1 FROM msg b WHERE b.kind = 'purchase' AND b.chat = m.chat AND b.local_id = m.local_id) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = m.id AND o_orderstatus = 'P')""",
)
def rescue_stuck(spark, sf_dir):
    from ledgerlark.session import table

    msgs = adapters.message(spark, sf_dir)
    rows = msgs.filter((F.col("kind") == "view") & (F.col("second") < NOW))
    for kind in ("click", "purchase"):
        rows = rows.join(msgs.filter(F.col("kind") == kind).select("chat", "local_id"), ["chat", "local_id"], "left_anti")
    held = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return rows.join(held, "id", "left_anti").select("id")


OPENS = "('view', 'signup')"


@register(
    "task_stages",
    f"""WITH {MSG}, r AS (SELECT chat AS project, row_number() OVER w AS turn, second // 16 AS sec, kind, local_id,
        last_value(CASE WHEN kind IN {OPENS} THEN id END IGNORE NULLS) OVER w AS task FROM msg WINDOW w AS (PARTITION BY chat ORDER BY second, id)),
    o AS (SELECT project, task, turn AS opened, sec + 300 AS ask FROM r WHERE kind IN {OPENS}),
    a AS (SELECT o.project, o.task, min(r.turn) AS answer FROM o JOIN r ON r.project = o.project AND r.task = o.task AND kind = 'purchase' AND turn > opened AND sec >= ask AND sec < ask + 86400 GROUP BY ALL),
    t AS (SELECT o.*, answer, (SELECT min(turn) FROM r WHERE r.project = o.project AND r.sec >= ask AND r.sec < ask + 1800) AS g,
        (SELECT min(turn) FROM r WHERE r.project = o.project AND r.sec >= ask + 1800 AND r.sec < ask + 3600) AS d,
        (SELECT min(turn) FROM r WHERE r.project = o.project AND r.sec >= ask + 3600) AS e FROM o LEFT JOIN a ON a.project = o.project AND a.task = o.task),
    f AS (SELECT * REPLACE (CASE WHEN answer IS NULL OR g < answer THEN g END AS g, CASE WHEN answer IS NULL OR d < answer THEN d END AS d, CASE WHEN answer IS NULL OR e < answer THEN e END AS e) FROM t),
    s AS (SELECT f.*, EXISTS (SELECT 1 FROM r WHERE r.project = f.project AND r.task = f.task AND kind = 'click' AND local_id % 2 = 0 AND turn > g AND turn <= coalesce(d, turn) AND turn <= coalesce(e, turn) AND turn < coalesce(answer, turn + 1)) AS gs,
        EXISTS (SELECT 1 FROM r WHERE r.project = f.project AND r.task = f.task AND kind = 'click' AND local_id % 2 = 1 AND turn > d AND turn <= coalesce(e, turn) AND turn < coalesce(answer, turn + 1)) AS ds,
        (SELECT max(turn) FROM r WHERE r.project = f.project AND kind = 'error' AND turn <= e) AS h FROM f)
    SELECT s.project, s.task, CASE WHEN g IS NULL THEN NULL WHEN gs THEN 'sent' WHEN e IS NOT NULL OR answer IS NOT NULL OR d IS NOT NULL THEN 'cancelled' ELSE 'pending' END AS group_status,
        CASE WHEN d IS NULL THEN NULL WHEN ds THEN 'sent' WHEN e IS NOT NULL OR answer IS NOT NULL THEN 'cancelled' ELSE 'pending' END AS direct_status,
        CASE WHEN e IS NULL THEN NULL WHEN NOT coalesce(hr.local_id % 3 <> 0 AND er.sec - hr.sec BETWEEN 0 AND 120, false) THEN 'collector_unavailable' WHEN gs OR ds THEN 'reply_missing' ELSE 'inquiry_not_delivered' END AS reason,
        answer IS NOT NULL AS answered
    FROM s LEFT JOIN r hr ON hr.project = s.project AND hr.turn = s.h LEFT JOIN r er ON er.project = s.project AND er.turn = s.e""",
)
def task_stages(spark, sf_dir):
    at = Window.partitionBy("chat").orderBy("second", "id")
    msg, opens = adapters.message(spark, sf_dir), F.col("kind").isin("view", "signup")
    kind = F.when(opens, "open").when(F.col("kind") == "click", "sent").when(F.col("kind") == "purchase", "answer").otherwise("health")
    detail = F.when(opens, F.col("kind")).when(F.col("kind") == "click", F.when(F.col("local_id") % 2 == 0, "group").otherwise("direct"))
    rows = msg.select(
        F.col("chat").alias("project"), F.last(F.when(opens, F.col("id")), ignorenulls=True).over(at).alias("task"), F.floor(F.col("second") / 16).alias("at"),
        kind.alias("kind"), F.coalesce(detail, F.when(F.col("local_id") % 3 != 0, "ok").otherwise("bad")).alias("detail"), F.row_number().over(at).alias("turn"),
    ).withColumn("ask", F.when(F.col("kind") == "open", F.col("at") + 300))
    return timers.staged_tasks(rows, rows.select("project", "turn", F.col("at").alias("tick")))
