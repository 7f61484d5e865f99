"""Rows dealt to as many tasks as their number needs, and what several paths read computed once."""

import pytest

from ledgerlark import session
from ledgerlark.operators import ledger, provenance, relations


@pytest.fixture
def tasks(spark, monkeypatch):
    """DEALT_ROWS such that 60 rows need a number of tasks that nothing else has."""
    monkeypatch.setattr(session, "DEALT_ROWS", 1)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < 60
    return 60


def plan(df):
    return df._jdf.queryExecution().toString()


def test_merged_attachments_follow_their_number(spark, tasks):
    rows = [(i, i % 7, "invoice") for i in range(57)] + [(None, 1, "invoice"), (None, 1, "invoice"), (3, 9, "payment")]
    # 3 goes to two items, one of which goes elsewhere itself; 50 has what 5 has already.
    merges = [(3, 4), (3, 8), (8, 9), (50, 1)]
    got = ledger.merge_attachments(spark.createDataFrame(rows, "item long, digest long, role string"), spark.createDataFrame(merges, "source long, target long"))
    want = set()
    for item, digest, role in rows:
        to = [t for s, t in merges if s == item]
        want |= {(t, digest, role) for t in to or [item]}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert f", {tasks})" in plan(got)


def test_moved_expenses_follow_their_number(spark, tasks):
    expenses = spark.createDataFrame([(i, 0, None, None, None, True, "draft") for i in range(60)], "id long, project long, person string, merged_into long, match_id long, verified boolean, stage string")
    cards = spark.createDataFrame([], "id long, item_id long, match_id long, project long, revision long")
    groups = spark.createDataFrame([], "match_id long, item_id long, project long, undone boolean")
    got = ledger.move_project(expenses, cards, groups, spark.createDataFrame([(5, 3)], "id long, target long"))[0]
    assert {(r.id, r.project) for r in got.collect() if r.outcome != "none"} == {(5, 3)} and got.count() == 60
    assert f", {tasks})" in plan(got)


def test_origins_follow_the_entries(spark, tasks):
    entries = spark.createDataFrame([(i, "agent" if i % 2 else "mail", i, f"d{i}") for i in range(58)] + [(1, "other", 1, "d1"), (70, "agent", 2, "d2")], "id long, source string, batch long, digest string")
    columns = "id long, account long, mailbox string, uidvalidity long, uid long, message_id long, digests array<string>"
    messages = spark.createDataFrame([(i, 1, "INBOX", 1, i, i, [f"d{i}"]) for i in range(60)] + [(5, 1, "INBOX", 1, 5, 99, ["d5"])], columns)
    accounts = spark.createDataFrame([(1, "INBOX", 1)], "account long, mailbox string, uidvalidity long")
    got = provenance.trusted_origins(entries, messages, accounts)
    # Entry 1 occurs twice and message 5 as well; entry 70 is an agent's with message 2.
    want = {(i, i, "agent") for i in range(1, 58, 2) if i not in (1, 5)} | {(70, 2, "agent")} | {(i, i, "manifest") for i in range(0, 58, 2)}
    assert {(r.id, r.uid, r.authority) for r in got.collect()} == want
    assert f", {tasks})" in plan(got)


def test_paths_compute_sums_once(spark):
    entries = spark.createDataFrame([(1, 1, "invoice", "meals", 100, None, True), (1, 2, "payment", "x", 60, None, True), (1, 3, "payment", "x", 40, None, True)], "pool long, id long, role string, category string, cents long, owner string, usable boolean")
    related = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "pool long, invoice long, other long")
    found = relations.legal_paths(entries, related)
    assert [(r.path, r.invoices, sorted(r.payments)) for r in found.collect()] == [("paid", [1], [2, 3])]
    assert "_groups" not in plan(found) and "ArrowEval" not in plan(found)
