"""Ingest by source key: replay with overlap, conflicts, rate limits and an outbox."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlark.streaming.folds import ordered_fold
from ledgerlark.streaming.outbox import events_of

OVERLAP = 120


def replay_windows(batches: DataFrame, *, overlap: int = OVERLAP) -> DataFrame:
    """Per batch of a chat (chat, no, first, last, safe): where its read started and the checkpoint after it.

    A read starts ``overlap`` before the checkpoint, not before the chat's first second. The checkpoint is the greatest
    end of the safe batches so far; an unsafe batch doesn't move it.
    """
    w = Window.partitionBy("chat").orderBy("no")
    done = F.max(F.when(F.col("safe"), F.col("last"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max(F.when(F.col("safe"), F.col("last"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.min("first").over(Window.partitionBy("chat"))
    return batches.select("chat", "no", F.greatest(start, F.coalesce(before - overlap, start)).alias("read_from"), done.alias("checkpoint"))


def ingest_once(arrivals: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Per key: how often it arrived, its payload, and whether arrivals disagree (then it has none)."""
    found = arrivals.groupBy(*key).agg(F.count("*").alias("arrivals"), F.min(payload).alias("low"), F.max(payload).alias("high"))
    clash = ~F.col("low").eqNullSafe(F.col("high"))
    return found.select(*key, "arrivals", F.when(~clash, F.col("low")).alias(payload), clash.alias("conflict"))


def ingest_stream(arrivals: DataFrame, path: str, checkpoint: str, key: list[str], payload: str):
    """A streaming query that keeps the table at ``path`` (Parquet, one folder per version) up to date: new keys are added, equal
    payloads skipped, and a different one marks the key as a conflict.

    ``foreachBatch`` merges each micro-batch with the newest version and writes the next one, named by the batch,
    so a replayed batch overwrites what it wrote before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*key).agg(F.min(payload).alias(payload), (F.min(payload) != F.max(payload)).alias("conflict"))
        if number:
            old = batch.sparkSession.read.parquet(f"{path}/v{number - 1}")
            both = old.unionByName(new)
            new = both.groupBy(*key).agg(
                F.min(payload).alias(payload), (F.max("conflict") | (F.min(payload) != F.max(payload))).alias("conflict")
            )
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limit_rate(times: list[int], *, most: int = 3, period: int = 86_400) -> list[bool]:
    """Which of the ascending ``times`` are emitted: at most ``most`` emitted ones in any ``period``; suppressed ones don't count."""
    sent: list[int] = []
    out = []
    for t in times:
        sent = [s for s in sent if s > t - period]
        out.append(len(sent) < most)
        if out[-1]:
            sent.append(t)
    return out


def rate_limited(rows: DataFrame, *, most: int = 3, period: int = 86_400) -> DataFrame:
    """Rows (object, id, second) with ``emitted``, as an ordered fold per object whose state are its last emissions, ``most`` at most."""

    def step(sent: list, row: dict) -> tuple:
        now = row["second"]
        while sent and sent[0] <= now - period:
            sent.pop(0)
        emitted = len(sent) < most
        if emitted:
            sent.append(now)
        return row["object"], row["id"], now, emitted

    return ordered_fold(rows.select("object", "id", "second"), "object", ["second", "id"], "object bigint, id bigint, second bigint, emitted boolean", list, step)


def rate_limited_stream(rows: DataFrame, *, most: int = 3, period: int = 86_400) -> DataFrame:
    """The same fold on a stream; an object's state are the times of its last emissions."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = list(state.get[0]) if state.exists else []
        for part in parts:
            part = part.sort_values(["second", "id"])
            flags = []
            for t in part["second"].tolist():
                sent = [s for s in sent if s > t - period]
                flags.append(len(sent) < most)
                if flags[-1]:
                    sent.append(t)
            yield part[["object", "id", "second"]].assign(emitted=flags)
        state.update((sent,))

    return rows.groupBy("object").applyInPandasWithState(
        fold, "object bigint, id bigint, second bigint, emitted boolean", "sent array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def outbox(changes: DataFrame) -> DataFrame:
    """The outbox of each project after changes (project, seq, item, verified, version): rows of (project, version, status, verified_items).

    The snapshot of a project is its items' verified versions. A change that leaves it as it is only refreshes the pending row; another
    snapshot supersedes it and adds a new row. Running sums over sorted rows, without a group in Python; see ``outbox``.
    """
    rows = events_of(changes.select("project", "seq", "item", "version", "verified", F.lit(True).alias("active"), F.lit(0).cast("bigint").alias("cents")))
    return rows.select("project", "version", "status", "verified_items")


def version_chain(snapshots: DataFrame, hash_of: Callable[[str], str] | None = None) -> DataFrame:
    """Per key the chain of versions over ordered fingerprints (key, seq, fingerprint): a change makes a new version from
    the last one, the same fingerprint keeps it."""
    import hashlib

    name = hash_of or (lambda s: hashlib.sha256(s.encode()).hexdigest())

    def step(state: dict, row: dict) -> tuple:
        if not state or row["fingerprint"] != state["last"]:
            state.update(version=name(f"{state.get('version', '')}:{row['fingerprint']}"), last=row["fingerprint"])
        return row["key"], row["seq"], state["version"]

    return ordered_fold(snapshots.select("key", "seq", "fingerprint"), "key", ["seq"], "key bigint, seq bigint, version string", dict, step)


def apply_in_order(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Per task the value after its events (task, at, id, kind, number): value, revision, kept, clarify.

    Events are seen in order of id. One that is older than the last applied is kept but not applied; one of the same second, or a
    change without a baseline, asks for clarification; every applied one adds a revision.
    """

    def step(state: dict, row: dict) -> None:
        at, kind, value = row["at"], row["kind"], state["value"]
        if state["last"] is not None and at < state["last"]:
            state["kept"] += 1
        elif state["last"] is not None and at == state["last"] or (kind != "set" and value is None):
            state["clarify"] += 1
        else:
            state["value"] = row["number"] if kind == "set" else value + (row["number"] if kind == "add" else -row["number"])
            state["last"] = at
            state["revision"] += 1

    def start() -> dict:
        return {"value": None, "last": None, "revision": 0, "kept": 0, "clarify": 0}

    def finish(task: int, state: dict) -> tuple:
        return task, state["value"], state["revision"], state["kept"], state["clarify"]

    joined = events.join(tasks.select("task"), "task", "left_semi").select("task", "at", "id", "kind", "number")
    return ordered_fold(joined, "task", ["id"], "task bigint, value bigint, revision bigint, kept bigint, clarify bigint", start, step, finish)


def due_occurrences(tasks: DataFrame, now: int, *, day: int = 86_400) -> DataFrame:
    """For each task (task, at: second of the day) the latest due time of today, one row per task and occurrence."""
    today = now - now % day
    due = tasks.withColumn("due", F.lit(today) + F.col("at")).filter(F.col("due") <= now)
    return due.groupBy("task").agg(F.max("due").alias("due"))


def escalation(tasks: DataFrame, now: int) -> DataFrame:
    """The stage of each task (task, ask_at, deadline) at ``now``: waiting, group, direct (30 minutes on), escalate (an hour on) or cancelled.

    Stages that were missed are not caught up: only the last one that is due counts.
    """
    passed = F.lit(now) - F.col("ask_at")
    stage = F.when(F.lit(now) > F.col("deadline"), "cancelled").when(passed >= 3600, "escalate").when(passed >= 1800, "direct")
    return tasks.select("task", stage.when(passed >= 0, "group").otherwise("waiting").alias("stage"))


def retry_schedule(rows: DataFrame, now: int) -> DataFrame:
    """Delivery rows (id, created, attempts, failed) at ``now``: status and when to try again (a minute doubled per attempt, an hour at most)."""
    wait = F.least(F.lit(3600), F.lit(60) * F.pow(F.lit(2), F.col("attempts")).cast("bigint"))
    old = F.lit(now) - F.col("created") >= 86_400
    status = F.when(~F.col("failed"), "done").when(old, "expired").otherwise("pending")
    return rows.select("id", status.alias("status"), F.when(status == "pending", F.lit(now) + wait).alias("retry_at"))


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
