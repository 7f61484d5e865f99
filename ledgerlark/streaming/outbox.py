"""Outbox of project snapshots: changes become events, of which the last of a project is delivered once, later again, or never.

A change is (project, seq, item, version, verified, active, cents): an item's state from then on. A project's snapshot is its verified
items' versions; any other snapshot is a new event that supersedes what is pending, the same one refreshes its counts.

``events_of`` folds a table of changes, ``event_stream`` a stream, with an item's state per key instead of sorting all items again.
``OutboxSink`` delivers from ``foreachBatch``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds between two attempts of a project, the longest wait, doublings of it, and how long an event is tried. Fixed values.
THROTTLE, LONGEST, DOUBLINGS, LIFETIME = 60, 3600, 6, 86_400
#: Events of one delivery pass.
PASS = 20
CHANGES = "project bigint, seq bigint, item bigint, version bigint, verified boolean, active boolean, cents bigint"
EVENTS = "project bigint, version bigint, seq bigint, fresh boolean, verified_items bigint, total_cents bigint, pending_items bigint"
STATE = "id string, project bigint, version bigint, created bigint, retry_at bigint, attempts bigint, status string, error string, verified_items bigint, total_cents bigint, pending_items bigint"
PROJECTS = "project bigint, current bigint, last_attempt bigint"
COUNTS = ("verified_items", "total_cents", "pending_items")


def steps(changes: DataFrame) -> DataFrame:
    """Each change with its project's state after it: EVENTS, where ``fresh`` tells whether the snapshot is another one.

    A snapshot changes exactly if the changed item's own entry does, so counts are running sums of differences to the item's state before.
    """
    own = Window.partitionBy("project", "item").orderBy("seq")
    so_far = Window.partitionBy("project").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    verified = F.coalesce(F.col("verified"), F.lit(False)) & F.coalesce(F.col("active"), F.lit(True))
    waits = ~F.coalesce(F.col("verified"), F.lit(False)) & F.coalesce(F.col("active"), F.lit(True))
    now = F.struct(F.when(verified, F.col("version")).alias("entry"), verified.cast("int").alias("verified"), F.when(verified, F.col("cents")).otherwise(0).alias("cents"), waits.cast("int").alias("waits"))
    rows = changes.select("project", "seq", "item", now.alias("now")).withColumn("was", F.lag("now").over(own))
    fresh = ~F.col("now.entry").eqNullSafe(F.col("was.entry")) | (F.col("now.verified") != F.coalesce("was.verified", F.lit(0)))
    less = lambda f: F.col(f"now.{f}") - F.coalesce(F.col(f"was.{f}"), F.lit(0))
    rows = rows.select("project", "seq", fresh.alias("fresh"), less("verified").alias("v"), less("cents").alias("c"), less("waits").alias("p"))
    total = lambda c: F.sum(c).over(so_far)
    return rows.select("project", total(F.col("fresh").cast("int")).alias("version"), "seq", "fresh", total("v").alias("verified_items"), total("c").alias("total_cents"), total("p").alias("pending_items"))


def events_of(changes: DataFrame) -> DataFrame:
    """The outbox after ``changes``: (project, version, seq, status, verified_items, total_cents, pending_items) of each event.

    The last event of a project is pending and the others superseded; counts are those of its last refresh. Changes that leave nothing
    verified before and after give no event. Null flags: not verified, active. Null projects are one project.
    """
    rows = steps(changes).filter("version > 0")
    last = F.max_by(F.struct(*COUNTS), "seq")
    events = rows.groupBy("project", "version").agg(F.min("seq").alias("seq"), last.alias("c"))
    status = F.when(F.col("version") == F.max("version").over(Window.partitionBy("project")), "pending").otherwise("superseded")
    return events.select("project", "version", "seq", status.alias("status"), "c.*")


class ProjectFold(StatefulProcessor):
    """Keyed by project: the state of each item, and the counts over them. A change costs one item's look-up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item bigint", "version bigint, verified boolean, waits boolean, cents bigint")
        self.counts = handle.getValueState("counts", "version bigint, verified bigint, cents bigint, pending bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, verified, cents, pending = tuple(self.counts.get()) if self.counts.exists() else (0, 0, 0, 0)
        for r in sorted(rows, key=lambda r: r.seq):
            before = self.items.getValue((r.item,)) if self.items.containsKey((r.item,)) else (None, False, False, 0)
            active = r.active is not False
            now = (r.version if r.verified and active else None, bool(r.verified and active), bool(active and not r.verified), (r.cents or 0) if r.verified and active else 0)
            fresh = (now[0], now[1]) != (before[0], before[1])
            version += fresh
            verified += now[1] - before[1]
            cents += now[3] - before[3]
            pending += now[2] - before[2]
            if any(now[1:]):
                self.items.updateValue((r.item,), now)
            elif self.items.containsKey((r.item,)):
                self.items.removeKey((r.item,))
            if version:
                yield Row(project=key[0], version=version, seq=r.seq, fresh=bool(fresh), verified_items=verified, total_cents=cents, pending_items=pending)
        self.counts.update((version, verified, cents, pending))

    def close(self) -> None:
        pass


def event_stream(changes: DataFrame) -> DataFrame:
    """The stream of EVENTS of a stream of changes, which come in order of ``seq`` within a project."""
    return changes.groupBy("project").transformWithState(statefulProcessor=ProjectFold(), outputStructType=EVENTS, outputMode="append", timeMode="None")


def enqueue(open_rows: DataFrame, projects: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """STATE rows and PROJECTS after EVENTS ``new`` arrive at second ``now``: pending, superseded or discarded (a day old) ones.

    Only a project's last event stays pending; it isn't tried earlier than THROTTLE after the project's last attempt.
    """
    latest = new.groupBy("project").agg(F.max("version").alias("newest"), F.max_by(F.struct(*COUNTS), "seq").alias("c"))
    known = projects.join(latest.select("project", "newest"), "project", "full").select(
        "project", F.greatest("current", "newest").alias("current"), "last_attempt"
    )
    made = new.filter("fresh").groupBy("project", "version").agg(F.min(F.lit(now)).alias("created"))
    made = made.join(open_rows.select("project", "version"), ["project", "version"], "left_anti").join(known.select("project", "last_attempt"), "project")
    ident = F.sha2(F.concat_ws(":", F.col("project").cast("string"), F.col("version").cast("string")), 256)
    made = made.select(
        ident.alias("id"), "project", "version", "created", F.greatest("created", F.col("last_attempt") + THROTTLE).alias("retry_at"), F.lit(0).cast("bigint").alias("attempts"),
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), *[F.lit(0).cast("bigint").alias(c) for c in COUNTS],
    ).withColumn("created", F.col("created").cast("bigint"))
    rows = open_rows.unionByName(made).join(known.select("project", "current"), "project", "left").join(latest.select("project", "newest", "c"), "project", "left")
    is_last = F.col("version") == F.coalesce("current", "version")
    old = F.col("created") <= now - LIFETIME
    waiting = F.col("status") == "pending"
    status = F.when(waiting & ~is_last, "superseded").when(waiting & old, "discarded").otherwise(F.col("status"))
    error = F.when(waiting & is_last & old, "expired_24h").otherwise(F.col("error"))
    fresher = F.col("version") == F.col("newest")
    counts = [F.when(fresher, F.col(f"c.{c}")).otherwise(F.col(c)).alias(c) for c in COUNTS]
    order = [f.split()[0] for f in STATE.split(", ")]
    return rows.select(*[c for c in rows.columns if c in order and c not in ("status", "error", *COUNTS)], status.alias("status"), error.alias("error"), *counts).select(*order), known


def due(rows: DataFrame, projects: DataFrame, now: int, most: int = PASS) -> DataFrame:
    """The pending rows that are tried now, the oldest ``most`` of them (a pass is this long on purpose; the rest waits for the next)."""
    free = projects.filter(F.col("last_attempt") > now - THROTTLE).select("project")
    waiting = rows.filter((F.col("status") == "pending") & (F.col("retry_at") <= now)).join(free, "project", "left_anti")
    return waiting.orderBy("created", "id").limit(most)


def settle(rows: DataFrame, projects: DataFrame, results: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Rows and projects after ``results`` (id, error) of a pass: sent, or pending with a longer wait, or superseded if no longer the last."""
    rows = rows.join(results.select("id", F.lit(True).alias("tried"), F.col("error").alias("failure")), "id", "left").join(projects.select("project", "current"), "project", "left")
    tried = F.coalesce("tried", F.lit(False))
    again = F.when(F.col("version") == F.col("current"), "pending").otherwise("superseded")
    wait = F.least(F.lit(LONGEST), F.lit(THROTTLE) * F.pow(F.lit(2), F.least(F.lit(DOUBLINGS), F.col("attempts")))).cast("bigint")
    done = rows.withColumns({
        "status": F.when(tried & F.col("failure").isNull(), "sent").when(tried, again).otherwise(F.col("status")), "error": F.when(tried, F.col("failure")).otherwise(F.col("error")),
        "retry_at": F.when(tried, now + wait).otherwise(F.col("retry_at")), "attempts": F.col("attempts") + tried.cast("bigint"),
    })
    reached = done.filter("tried").select("project").distinct().withColumn("now", F.lit(now).cast("bigint"))
    projects = projects.join(reached, "project", "left").select("project", "current", F.coalesce("now", "last_attempt").alias("last_attempt"))
    return done.select(*[f.split()[0] for f in STATE.split(", ")]), projects


class OutboxSink:
    """Delivers EVENTS from ``foreachBatch``: ``event_stream(...).writeStream.foreachBatch(sink.write)``.

    Each micro-batch has folders of its number, which a repeated run of it writes again or, once complete, doesn't touch: ``claimed`` (rows and
    which are tried), ``results``, then ``projects``, ``closed`` and ``open``. A run that died after claiming tries the same rows again, whose
    receiver knows them by id. The next micro-batch reads what is still open only; closed rows are history.

    ``send`` gets a row's dict on an executor and raises if it isn't accepted.
    """

    def __init__(self, folder: str, send: Callable[[dict], None], *, clock: Callable[[], float] = time.time, most: int = PASS) -> None:
        self.folder, self.send, self.clock, self.most = folder, send, clock, most

    def path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/batch={number}"

    def files(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def complete(self, spark: SparkSession, kind: str, number: int) -> bool:
        files, where = self.files(spark, f"{self.path(kind, number)}/_SUCCESS")
        return files.exists(where)

    def last_before(self, spark: SparkSession, number: int) -> int | None:
        files, where = self.files(spark, f"{self.folder}/open")
        found = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(where)] if files.exists(where) else []
        return max((n for n in found if n < number and self.complete(spark, "open", n)), default=None)

    def keep(self, spark: SparkSession, kind: str, number: int, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written once."""
        if not self.complete(spark, kind, number):
            make().write.mode("overwrite").parquet(self.path(kind, number))
        return spark.read.parquet(self.path(kind, number))

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if self.complete(spark, "open", number):
            return
        last = self.last_before(spark, number)
        old = spark.createDataFrame([], STATE) if last is None else spark.read.parquet(self.path("open", last))
        old_projects = spark.createDataFrame([], PROJECTS) if last is None else spark.read.parquet(self.path("projects", last))

        def claim() -> DataFrame:
            now = int(self.clock())
            rows, projects = enqueue(old, old_projects, batch, now)
            chosen = due(rows, projects, now, self.most).select("id", F.lit(True).alias("claimed"))
            return rows.join(chosen, "id", "left").join(projects, "project", "left").withColumn("now", F.lit(now).cast("bigint"))

        claimed = self.keep(spark, "claimed", number, claim)
        quiet = self.keep(spark, "quiet", number, lambda: enqueue(old, old_projects, batch, 0)[1].join(claimed.select("project"), "project", "left_anti"))
        results = self.keep(spark, "results", number, lambda: self.sent(claimed.filter("claimed")))
        first = claimed.select("now").first()
        now = int(self.clock()) if first is None else first["now"]
        rows = claimed.select(*[f.split()[0] for f in STATE.split(", ")])
        known = claimed.select("project", "current", "last_attempt").distinct().unionByName(quiet)
        done, projects = settle(rows, known, results, now)
        waiting = F.col("status") == "pending"
        self.keep(spark, "closed", number, lambda: done.filter(~waiting))
        # A project without open rows matters as long as it is throttled, and its version as long as it can be asked for.
        self.keep(spark, "projects", number, lambda: projects)
        self.keep(spark, "open", number, lambda: done.filter(waiting))

    def sent(self, rows: DataFrame) -> DataFrame:
        send = self.send

        def run(parts):
            for part in parts:
                errors = []
                for row in part.to_dict("records"):
                    try:
                        send(row)
                        errors.append(None)
                    except Exception as error:
                        errors.append(type(error).__name__)
                yield part[["id"]].assign(error=errors)

        return rows.drop("claimed", "now", "current", "last_attempt").mapInPandas(run, "id string, error string")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All events by now: closed ones and those of the last complete micro-batch that are open."""
        last = self.last_before(spark, 1 << 62)
        if last is None:
            return spark.createDataFrame([], STATE)
        closed = spark.read.parquet(f"{self.folder}/closed").filter(F.col("batch") <= last).drop("batch")
        return closed.unionByName(spark.read.parquet(self.path("open", last)))
