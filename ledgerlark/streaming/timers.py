"""Tasks that are asked about in stages by timers: a group, then one person, then a human; never by what was missed.

``TaskStages`` is the stream, with one timer per stage in the state store; ``staged_tasks`` gives the same from tables, for any clock ticks.

A row is (project, task, at, kind, detail, ask): ``open`` (detail is the payload, ask the second when to ask; a task that is open already
stays as it is), ``sent`` (detail names the stage whose delivery was seen), ``answer``, and ``health`` of the project's collector (detail
``ok`` or not). ``at`` is a second. At a tick only the last stage that is due counts: ``group`` from ask on, ``direct`` 30 minutes on, ``escalate``
an hour on. A later stage or an answer cancels what is still pending before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds from asking to the next stages, for how long answers count, and how old a good health report may be. Fixed values.
DIRECT, DEADLINE, DAY, FRESH = 1800, 3600, 86_400, 120
ROWS = "project bigint, task bigint, at bigint, kind string, detail string, ask bigint"
CHANGES = "project bigint, task bigint, stage string, status string, reason string, payload string, tick bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TaskStages(StatefulProcessor):
    """Keyed by project. State: its open tasks, which of them each timer is for, and the last health report."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "task bigint", "ask bigint, payload string, answered boolean, group_status string, direct_status string, escalated boolean")
        self.due = handle.getMapState("due", "second bigint", "tasks array<bigint>")
        self.health = handle.getValueState("health", "at bigint, healthy boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at, r.kind, r.task or 0, r.ask or 0, r.detail or "")):
            if r.kind == "health":
                self.health.update((r.at, r.detail == "ok"))
                continue
            known = self.tasks.getValue((r.task,)) if self.tasks.containsKey((r.task,)) else None
            if r.kind == "open":
                if known is None:
                    self.tasks.updateValue((r.task,), (r.ask, r.detail, False, None, None, False))
                    for second in (r.ask, r.ask + DIRECT, r.ask + DEADLINE, r.ask + DAY):
                        self.wake(second, r.task)
                continue
            if known is None:
                continue
            ask, payload, answered, group, direct, escalated = known
            if r.kind == "sent":
                if r.detail == "group" and group == "pending":
                    group = "sent"
                    yield change(key, r.task, "group", "sent", None, payload, r.at)
                if r.detail == "direct" and direct == "pending":
                    direct = "sent"
                    yield change(key, r.task, "direct", "sent", None, payload, r.at)
            elif r.kind == "answer" and ask <= r.at < ask + DAY and not answered:
                answered = True
                group, direct, rows_out = cancel(key, r.task, group, direct, payload, r.at)
                yield from rows_out
            self.tasks.updateValue((r.task,), (ask, payload, answered, group, direct, escalated))

    def wake(self, second: int, task: int) -> None:
        before = list(self.due.getValue((second,))[0]) if self.due.containsKey((second,)) else []
        self.due.updateValue((second,), ([*before, task],))
        self.handle.registerTimer(second * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        second = expiredTimerInfo.getExpiryTimeInMs() // 1000
        now = timerValues.getCurrentWatermarkInMs() // 1000
        if not self.due.containsKey((second,)):
            return
        woken = list(self.due.getValue((second,))[0])
        self.due.removeKey((second,))
        for task in woken:
            if not self.tasks.containsKey((task,)):
                continue
            ask, payload, answered, group, direct, escalated = self.tasks.getValue((task,))
            if not answered and not escalated:
                if now >= ask + DEADLINE:
                    reached = "sent" in (group, direct)
                    group, direct, rows_out = cancel(key, task, group, direct, payload, now)
                    yield from rows_out
                    report = self.health.get() if self.health.exists() else None
                    fresh = report is not None and report[1] and 0 <= now - report[0] <= FRESH
                    reason = ("reply_missing" if reached else "inquiry_not_delivered") if fresh else "collector_unavailable"
                    escalated = True
                    yield change(key, task, "escalate", "pending", reason, payload, now)
                elif now >= ask + DIRECT and direct is None:
                    group, _, rows_out = cancel(key, task, group, None, payload, now)
                    yield from rows_out
                    direct = "pending"
                    yield change(key, task, "direct", "pending", None, payload, now)
                elif ask <= now < ask + DIRECT and group is None:
                    group = "pending"
                    yield change(key, task, "group", "pending", None, payload, now)
            if second >= ask + DAY:
                self.tasks.removeKey((task,))  # nothing can happen to it any more
            else:
                self.tasks.updateValue((task,), (ask, payload, answered, group, direct, escalated))

    def close(self) -> None:
        pass


def change(key, task: int, stage: str, status: str, reason: str | None, payload: str | None, tick: int) -> Row:
    return Row(project=key[0], task=task, stage=stage, status=status, reason=reason, payload=payload, tick=tick)


def cancel(key, task: int, group: str | None, direct: str | None, payload: str | None, tick: int):
    """Both statuses with what was pending cancelled, and the rows that say so."""
    rows = [change(key, task, stage, "cancelled", None, payload, tick) for stage, status in (("group", group), ("direct", direct)) if status == "pending"]
    off = lambda s: "cancelled" if s == "pending" else s
    return off(group), off(direct), rows


def use_timers(spark: SparkSession) -> None:
    """Timers need a state store that keeps several column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stage_stream(rows: DataFrame) -> DataFrame:
    """The stream of changes (project, task, stage, status, reason, payload, tick) of a stream of rows; see the module.

    The clock is the watermark: the greatest ``at`` of all micro-batches before. A restart goes on from the state store, payloads included.
    """
    timed = rows.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "0 seconds")
    return timed.groupBy("project").transformWithState(
        statefulProcessor=TaskStages(), outputStructType=CHANGES, outputMode="append", timeMode="EventTime"
    )


def next_tick(points: DataFrame, ticks: DataFrame) -> DataFrame:
    """``points`` (project, second and more) with the first tick (project, turn, tick) at or after it: its turn and time as ``turn`` and ``tick``.

    Ticks don't go back as turns go on. One window, which keeps one row at a time.
    """
    names = [c for c in points.columns if c not in ("project", "second")]
    both = points.select("project", "second", F.struct(*names).alias("_point"), F.lit(None).cast("struct<turn:bigint,tick:bigint>").alias("_tick")).union(
        ticks.select("project", F.col("tick").alias("second"), F.lit(None).cast(points.select(F.struct(*names)).schema[0].dataType), F.struct(F.col("turn").cast("bigint"), F.col("tick").cast("bigint")))
    )
    later = Window.partitionBy("project").orderBy(F.desc("second"), F.col("_tick.turn").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_next", F.last("_tick", ignorenulls=True).over(later)).filter("_point IS NOT NULL")
    return found.select("project", "second", *[F.col(f"_point.{c}").alias(c) for c in names], F.col("_next.turn").alias("turn"), F.col("_next.tick").alias("tick"))


def staged_tasks(rows: DataFrame, ticks: DataFrame) -> DataFrame:
    """The batch twin: (project, task, group_status, direct_status, reason, answered) after all rows and ticks.

    ``rows`` also have ``turn``: they are seen before that turn's tick (project, turn, tick). A status is null where the stage was never
    asked for, else pending, sent or cancelled; reason is null without an escalation. Null tasks open nothing.
    """
    opens = rows.filter("kind = 'open' AND task IS NOT NULL").groupBy("project", "task").agg(F.min(F.struct("turn", "at", "ask", "detail")).alias("o"))
    opens = opens.select("project", "task", F.col("o.turn").alias("opened"), F.col("o.at").alias("opened_at"), "o.ask")
    answers = rows.filter("kind = 'answer'").select("project", "task", "turn", "at")
    answered = opens.join(answers, ["project", "task"]).filter("(turn > opened OR turn = opened AND at > opened_at) AND at >= ask AND at < ask + 86400")
    answered = answered.groupBy("project", "task").agg(F.min(F.struct("turn", "at")).alias("answer"))
    # A task that is opened after its time is first looked at by the tick of its own turn.
    own = ticks.select("project", F.col("turn").alias("opened"), F.col("tick").alias("first_tick"))
    tasks = opens.join(own, ["project", "opened"], "left").join(answered, ["project", "task"], "left")
    places = F.array(*[F.struct(F.lit(name).alias("stage"), F.greatest(F.col("ask") + after, F.coalesce("first_tick", "ask")).alias("second")) for name, after in (("group", 0), ("direct", DIRECT), ("escalate", DEADLINE))])
    points = tasks.select("project", "task", "ask", "answer", F.explode(places).alias("p")).select("project", "p.second", "task", "p.stage", "ask", F.col("answer.turn").alias("answer_turn"))
    found = next_tick(points, ticks)
    until = F.when(F.col("stage") == "group", F.col("ask") + DIRECT).when(F.col("stage") == "direct", F.col("ask") + DEADLINE)
    fits = F.col("turn").isNotNull() & (until.isNull() | (F.col("tick") < until)) & (F.col("answer_turn").isNull() | (F.col("turn") < F.col("answer_turn")))
    turn_of = lambda s: F.max(F.when(fits & (F.col("stage") == s), F.col("turn"))).alias(s)
    stages = found.groupBy("project", "task").agg(turn_of("group"), turn_of("direct"), turn_of("escalate"), F.max(F.when(fits & (F.col("stage") == "escalate"), F.col("tick"))).alias("tick"))
    tasks = tasks.join(stages, ["project", "task"])
    sent = rows.filter("kind = 'sent'").select("project", "task", F.col("turn").alias("s_turn"), F.col("at").alias("s_at"), "detail")
    seen = tasks.join(sent, ["project", "task"])
    # Seen after it was asked for, and before what would cancel it.
    before = F.col("answer").isNull() | (F.struct("s_turn", "s_at") < F.struct(F.col("answer.turn"), F.col("answer.at")))
    in_time = lambda s, *ends: (F.col("detail") == s) & (F.col("s_turn") > F.col(s)) & before & (F.col("s_turn") <= F.least(*[F.coalesce(e, F.lit(1 << 62)) for e in ends]))
    seen = seen.groupBy("project", "task").agg(
        F.max(in_time("group", F.col("direct"), F.col("escalate"))).alias("group_sent"), F.max(in_time("direct", F.col("escalate"), F.col("escalate"))).alias("direct_sent")
    )
    reports = rows.filter("kind = 'health'").select("project", "turn", F.col("at"), (F.col("detail") == "ok").alias("healthy"))
    tasks = tasks.join(seen, ["project", "task"], "left").join(last_report(tasks, reports), ["project", "task"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = lambda s, later: F.when(F.col(s).isNull(), None).when(yes(f"{s}_sent"), "sent").when(later, "cancelled").otherwise("pending")
    over = F.col("escalate").isNotNull() | F.col("answer").isNotNull()
    fresh = F.coalesce(F.col("report.healthy") & (F.col("tick") - F.col("report.at")).between(0, FRESH), F.lit(False))
    reason = F.when(~fresh, "collector_unavailable").when(yes("group_sent") | yes("direct_sent"), "reply_missing").otherwise("inquiry_not_delivered")
    return tasks.select(
        "project", "task", status("group", over | F.col("direct").isNotNull()).alias("group_status"), status("direct", over).alias("direct_status"),
        F.when(F.col("escalate").isNotNull(), reason).alias("reason"), F.col("answer").isNotNull().alias("answered"),
    )


def last_report(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """(project, task, report) of escalated tasks: the project's last health report up to the turn of the escalation."""
    asked = tasks.filter("escalate IS NOT NULL").select("project", F.col("escalate").alias("turn"), "task", F.lit(None).cast("struct<at:bigint,healthy:boolean>").alias("r"))
    both = asked.union(reports.select("project", "turn", F.lit(None).cast("bigint"), F.struct(F.col("at").cast("bigint"), "healthy")))
    up_to = Window.partitionBy("project").orderBy("turn", F.col("task").asc_nulls_first(), "r.at").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("report", F.last("r", ignorenulls=True).over(up_to)).filter("task IS NOT NULL").select("project", "task", "report")
