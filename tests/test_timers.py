import random

import pytest

from ledgerlark.streaming import timers

ASK = 10_000


def batch_rows(spark, turns):
    """Rows of each turn with turns as the stream counts them: it looks at its clock before and after each micro-batch."""
    rows = [(*r, 2 * k) for k, part in enumerate(turns) for r in part]
    projects = {r[0] for part in turns for r in part}
    clock, ticks = 0, []
    for k, part in enumerate(turns):
        ticks += [(p, 2 * k, clock) for p in projects]
        clock = max([clock, *(r[2] for r in part)])
        ticks += [(p, 2 * k + 1, clock) for p in projects]
    return spark.createDataFrame(rows, timers.ROWS + ", turn bigint"), spark.createDataFrame(ticks, "project bigint, turn bigint, tick bigint")


def by_batch(spark, turns):
    return {(r.project, r.task): (r.group_status, r.direct_status, r.reason, r.answered) for r in timers.staged_tasks(*batch_rows(spark, turns)).collect()}


def run_stream(spark, folder, turns, restart_at=()):
    """All changes in order; the query is stopped and started again before the turns of ``restart_at``."""
    timers.use_timers(spark)
    (folder / "in").mkdir()

    def start():
        rows = spark.readStream.schema(timers.ROWS).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
        return timers.stage_stream(rows).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).outputMode("append").start()

    query = start()
    try:
        for k, part in enumerate(turns):
            if k in restart_at:
                query.stop()
                query = start()
            spark.createDataFrame(part, timers.ROWS).coalesce(1).write.json(str(folder / "made" / str(k)))
            made = next((folder / "made" / str(k)).glob("part-*"))
            made.rename(folder / "in" / f"{k}.json")
            query.processAllAvailable()
    finally:
        query.stop()
    return sorted(map(tuple, spark.read.parquet(str(folder / "out")).collect()), key=lambda r: r[6])


def last_status(changes):
    out = {}
    for project, task, stage, status, reason, *_ in changes:
        out[project, task, stage] = (status, reason)
    return out


def test_stages_and_restart(spark, tmp_path):
    turns = [
        [(1, 7, 100, "open", "lunch", ASK), (1, 8, 100, "open", "dinner", ASK), (2, 9, 100, "open", "late", ASK)],
        [(1, None, ASK + 5, "health", "ok", None)],  # all are asked in their group
        [(1, 7, ASK + 20, "sent", "group", None), (1, 7, ASK + 21, "open", "another payload", 0)],
        [(1, 8, ASK + 1000, "answer", None, None)],
        [(1, None, ASK + 1810, "health", "ok", None)],  # 7 and 9 go to one person
        [(1, None, ASK + 3600, "health", "ok", None)],
    ]
    changes = run_stream(spark, tmp_path, turns, restart_at=(2, 4, 5))
    assert last_status(changes) == {
        (1, 7, "group"): ("sent", None), (1, 7, "direct"): ("cancelled", None), (1, 7, "escalate"): ("pending", "reply_missing"),
        (1, 8, "group"): ("cancelled", None), (2, 9, "group"): ("cancelled", None), (2, 9, "direct"): ("cancelled", None),
        (2, 9, "escalate"): ("pending", "collector_unavailable"),
    }
    assert {(task, payload) for _, task, *_, payload, _ in changes} == {(7, "lunch"), (8, "dinner"), (9, "late")}
    assert [r[6] for r in changes if r[2:4] == ("escalate", "pending")] == [ASK + 3600] * 2
    assert by_batch(spark, turns) == {
        (1, 7): ("sent", "cancelled", "reply_missing", False), (1, 8): ("cancelled", None, None, True), (2, 9): ("cancelled", "cancelled", "collector_unavailable", False),
    }


def test_missed_stages_are_not_caught_up(spark, tmp_path):
    turns = [[(1, 1, 1, "open", "p", ASK)], [(1, None, ASK + 7000, "health", "ok", None)], [(1, None, ASK + 9000, "health", "ok", None)]]
    changes = run_stream(spark, tmp_path, turns)
    assert [r[2:5] for r in changes] == [("escalate", "pending", "inquiry_not_delivered")]
    assert by_batch(spark, turns) == {(1, 1): (None, None, "inquiry_not_delivered", False)}


@pytest.mark.parametrize("at,detail", [(-121, "ok"), (0, "bad")])
def test_old_or_bad_reports_are_no_missing_reply(spark, at, detail):
    turns = [[(1, 1, 0, "open", "p", ASK)], [(1, None, ASK + 3600 + at, "health", detail, None)], [(2, None, ASK + 3600, "health", "ok", None)]]
    assert by_batch(spark, turns)[1, 1][2] == "collector_unavailable"


def test_stream_is_its_batch_twin(spark, tmp_path):
    rng = random.Random(8)
    turns, clock, opened = [], 0, []
    for _ in range(14):
        part = []
        for _ in range(rng.randrange(1, 6)):
            clock += rng.choice([1, 60, 400, 900, 1700])
            kind = rng.choice(["open", "open", "sent", "sent", "answer", "health"])
            project = rng.choice([1, 2])
            known = [t for p, t in opened if p == project]
            if kind == "open" or not known:
                task = len(opened)
                opened.append((project, task))
                part.append((project, task, clock, "open", f"payload {task}", clock + rng.choice([-2000, 0, 300, 900])))
            elif kind == "health":
                part.append((project, None, clock, "health", rng.choice(["ok", "ok", "bad"]), None))
            else:
                part.append((project, rng.choice(known[-4:]), clock, kind, rng.choice(["group", "direct"]), None))
        turns.append(part)
    want = by_batch(spark, turns)
    got = last_status(run_stream(spark, tmp_path, turns, restart_at=(5, 9)))
    status = lambda p, t, s: got.get((p, t, s), (None, None))
    assert {k: (status(*k, "group")[0], status(*k, "direct")[0], status(*k, "escalate")[1]) for k in want} == {k: v[:3] for k, v in want.items()}
    assert len({v[:3] for v in want.values()}) > 4
