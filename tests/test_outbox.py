import json
import random
from collections import Counter

import pytest

from ledgerlark.streaming import outbox, timers


class Receiver:
    """Writes what it accepts to a file, as it runs in another process; fails while ``down`` is there."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, row):
        import os

        if os.path.exists(f"{self.folder}/down"):
            raise OSError("no answer")
        with open(f"{self.folder}/sent", "a") as f:
            f.write(json.dumps({k: (v if isinstance(v, str) or v is None else int(v)) for k, v in row.items()}) + "\n")

    def sent(self):
        from pathlib import Path

        file = Path(self.folder, "sent")
        return [json.loads(x) for x in file.read_text().splitlines()] if file.exists() else []


@pytest.fixture
def desk(spark, tmp_path):
    receiver, clock = Receiver(tmp_path), [100_000]
    sink = outbox.OutboxSink(str(tmp_path / "box"), receiver, clock=lambda: clock[0])
    state = {"items": {}, "seq": 0, "batch": 0, "version": Counter()}

    def run(*changes):
        """A micro-batch after changes (project, item, verified); items count 100 cents each."""
        rows = []
        for project, item, verified in changes:
            state["seq"] += 1
            rows.append((project, state["seq"], item, state["seq"], verified, verified is not None, 100))
        state["items"][state["batch"]] = rows
        past = [r for b in range(state["batch"]) for r in state["items"][b]]
        events = outbox.steps(spark.createDataFrame(past + rows, outbox.CHANGES)).filter("version > 0")
        new = events.filter(events.seq > len(past))
        state["last"] = new
        sink.write(new, state["batch"])
        state["batch"] += 1

    return sink, receiver, clock, run, state


def statuses(spark, sink):
    return {(r.project, r.version): r.status for r in sink.rows(spark).collect()}


def test_coalescing_throttle_and_empty_state(spark, desk):
    sink, receiver, clock, run, _ = desk
    run((1, 1, True))
    assert [r["verified_items"] for r in receiver.sent()] == [1]
    clock[0] += 5
    run((1, 2, True))
    clock[0] += 5
    run((1, 3, True))
    assert len(receiver.sent()) == 1 and statuses(spark, sink) == {(1, 1): "sent", (1, 2): "superseded", (1, 3): "pending"}
    clock[0] += 50
    run()
    assert [(r["verified_items"], r["total_cents"]) for r in receiver.sent()] == [(1, 100), (3, 300)]
    run((1, 1, None), (1, 2, None), (1, 3, None))
    clock[0] += 60
    run()
    assert [r["verified_items"] for r in receiver.sent()] == [1, 3, 0] and len({r["id"] for r in receiver.sent()}) == 3


def test_refresh_keeps_the_event(spark, desk):
    sink, receiver, clock, run, _ = desk
    run((1, 1, True))
    run((1, 2, True))  # throttled
    before = sink.rows(spark).filter("status = 'pending'").first()
    run((1, 3, False))
    after = sink.rows(spark).filter("status = 'pending'").first()
    assert (before.id, before.version, before.pending_items) == (after.id, after.version, 0) and after.pending_items == 1


def test_backoff_and_expiry(spark, desk, tmp_path):
    sink, receiver, clock, run, _ = desk
    (tmp_path / "down").touch()
    run((1, 1, True))
    for attempt in range(8):
        row = sink.rows(spark).first()
        assert (row.attempts, row.status, row.error) == (attempt + 1, "pending", "OSError")
        assert row.retry_at - clock[0] == min(3600, 60 * 2 ** min(attempt, 6))
        run()  # too early
        assert sink.rows(spark).first().attempts == attempt + 1
        clock[0] = row.retry_at
        run()
    clock[0] = 100_000 + 86_400
    run()
    row = sink.rows(spark).first()
    assert (row.status, row.error) == ("discarded", "expired_24h") and not receiver.sent()


def test_failed_and_replaced_is_not_tried_again(spark, desk, tmp_path):
    sink, receiver, clock, run, _ = desk
    (tmp_path / "down").touch()
    run((1, 1, True))
    run((1, 2, True))
    assert statuses(spark, sink) == {(1, 1): "superseded", (1, 2): "pending"}
    # Replaced while it was being sent: the result finds a newer version.
    rows = spark.createDataFrame([("x", 1, 1, 0, 0, 0, "pending", None, 1, 1, 1)], outbox.STATE)
    projects = spark.createDataFrame([(1, 2, None)], outbox.PROJECTS)
    for error, status in (("OSError", "superseded"), (None, "sent")):
        done, known = outbox.settle(rows, projects, spark.createDataFrame([("x", error)], "id string, error string"), 50)
        assert done.first().status == status and known.first().last_attempt == 50


def test_crash_after_claiming_tries_the_same_rows(spark, desk):
    sink, receiver, clock, run, state = desk
    real, sink.sent = sink.sent, None
    with pytest.raises(TypeError):
        run((1, 1, True), (2, 1, True))
    assert sink.complete(spark, "claimed", 0) and not receiver.sent()
    sink.sent = real
    clock[0] += 30
    sink.write(state["last"], 0)
    assert sorted(r["project"] for r in receiver.sent()) == [1, 2] and set(statuses(spark, sink).values()) == {"sent"}
    sink.write(state["last"], 0)  # a repeated micro-batch does nothing
    assert len(receiver.sent()) == 2
    # One that died after sending sends again under the same id, by which a receiver knows it.
    files, where = sink.files(spark, sink.path("results", 0))
    files.delete(where, True)
    files.delete(sink.files(spark, sink.path("open", 0))[1], True)
    sink.write(state["last"], 0)
    assert len({r["id"] for r in receiver.sent()}) == 2 and set(statuses(spark, sink).values()) == {"sent"}


def test_a_pass_takes_the_oldest(spark, desk):
    sink, receiver, clock, run, _ = desk
    sink.most = 2
    run((1, 1, True), (2, 1, True), (3, 1, True))
    assert len(receiver.sent()) == 2
    run()
    assert sorted(r["project"] for r in receiver.sent()) == [1, 2, 3]


def random_changes(rng, n):
    return [(rng.choice([1, 2, 3, None]), i, rng.randrange(5), rng.randrange(3), rng.choice([True, True, False, None]), rng.choice([True, True, None, False]), rng.choice([100, 250])) for i in range(n)]


def brute_events(changes):
    """By whole snapshots, compared at each change."""
    items, out, version = {}, {}, Counter()
    for project, seq, item, v, verified, active, cents in changes:
        own = items.setdefault(project, {})
        snapshot = lambda: {i: x[0] for i, x in own.items() if x[1]}  # noqa: B023, E731
        before = snapshot()
        on = active is not False
        own[item] = (v, bool(verified) and on, on and not verified, cents)
        if snapshot() != before:
            version[project] += 1
            out[project, version[project]] = [seq]
        if version[project]:
            good = [x for x in own.values() if x[1]]
            out[project, version[project]][1:] = [len(good), sum(x[3] for x in good), sum(x[2] for x in own.values())]
    return {k: tuple(v) for k, v in out.items()}, dict(version)


@pytest.mark.parametrize("seed", [1, 2])
def test_events_by_brute_force(spark, seed):
    changes = random_changes(random.Random(seed), 120)
    want, versions = brute_events(changes)
    rows = outbox.events_of(spark.createDataFrame(changes, outbox.CHANGES)).collect()
    assert {(r.project, r.version): (r.seq, r.verified_items, r.total_cents, r.pending_items) for r in rows} == want
    assert all((r.status == "pending") == (r.version == versions[r.project]) for r in rows)
    assert outbox.events_of(spark.createDataFrame([], outbox.CHANGES)).count() == 0


def test_stream_through_restarts_is_its_batch_twin(spark, tmp_path):
    timers.use_timers(spark)
    changes = [c for c in random_changes(random.Random(5), 90) if c[0] is not None]
    receiver = Receiver(tmp_path)
    clock = [1000]
    sink = outbox.OutboxSink(str(tmp_path / "box"), receiver, clock=lambda: clock[0])
    (tmp_path / "in").mkdir()
    for k in range(0, len(changes), 15):
        made = tmp_path / "made" / str(k)
        spark.createDataFrame(changes[k : k + 15], outbox.CHANGES).coalesce(1).write.json(str(made))
        next(made.glob("part-*")).rename(tmp_path / "in" / f"{k:04}.json")
        stream = spark.readStream.schema(outbox.CHANGES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = outbox.event_stream(stream).writeStream.foreachBatch(sink.write).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        clock[0] += 61
    want, versions = brute_events(changes)
    rows = {(r.project, r.version): r for r in sink.rows(spark).collect()}
    assert set(rows) == set(want)
    for key, row in rows.items():
        if key[1] == versions[key[0]]:
            assert row.status == "sent" and (row.verified_items, row.total_cents, row.pending_items) == want[key][1:]
        else:
            assert row.status in ("sent", "superseded")
    assert len(receiver.sent()) == sum(r.status == "sent" for r in rows.values()) == len({x["id"] for x in receiver.sent()})
