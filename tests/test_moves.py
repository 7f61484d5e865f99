from ledgerlark.operators import ledger

CARD = "id long, project string, role string, status string, digest string, revision long, linked boolean, converted boolean, needless boolean, archived_from string, deleted_from string"


def test_archiving_and_back(spark):
    card = lambda i, status, **more: tuple({"id": i, "project": "", "role": "invoice", "status": status, "digest": f"d{i}", "revision": 1, "linked": False, "converted": None, "needless": False, "archived_from": None, "deleted_from": None, **more}.values())
    queue = spark.createDataFrame([
        card(1, "review"), card(2, "archived", archived_from="received"), card(3, "archived", archived_from="review", needless=True), card(4, "deleted", deleted_from="archived", archived_from="review"), card(5, "received", needless=True),
        card(6, "review", linked=True), card(7, "review"), card(8, "review", project="other"), card(9, "review", role="weird"), card(10, "review", converted=True), card(11, "review"), card(12, "unused"), card(13, "deleted", deleted_from="review"), card(14, "linked"),
    ], CARD)
    actions = {1: "archive", 2: "restore", 3: "restore", 4: "restore-deleted", 5: "delete", 6: "archive", 7: "archive", 8: "archive", 9: "archive", 10: "archive", 12: "delete", 13: "restore-deleted", 14: "archive"}
    commands = spark.createDataFrame([(i, 2 if i == 7 else 1, "p", a) for i, a in actions.items()], "id long, revision long, project string, action string")
    got = {r.id: (r.status, r.archived_from, r.deleted_from, r.revision, r.outcome) for r in ledger.archive(queue, commands, spark.createDataFrame([("d14",)], "digest string")).collect()}
    assert got == {
        1: ("archived", "review", None, 2, "applied"), 2: ("received", None, None, 2, "applied"), 3: ("archived", "review", None, 1, "not allowed"), 4: ("archived", "review", None, 2, "applied"), 5: ("deleted", None, "unused", 2, "applied"),
        6: ("review", None, None, 1, "linked"), 7: ("review", None, None, 1, "stale"), 8: ("review", None, None, 1, "other project"), 9: ("review", None, None, 1, "wrong role"), 10: ("review", None, None, 1, "converted"),
        11: ("review", None, None, 1, "none"), 12: ("deleted", None, "unused", 2, "applied"), 13: ("deleted", None, "review", 1, "not allowed"), 14: ("linked", None, None, 1, "linked"),
    }


def test_a_move_takes_members_cards_and_group(spark):
    expenses = spark.createDataFrame([(1, 10, None, None, 100, True, "draft"), (2, 10, None, 1, None, True, "cancelled"), (3, 10, "p", None, None, True, "draft"), (4, 10, None, None, 400, False, "submitted"), (5, 10, None, None, None, False, "draft")], "id long, project long, person string, merged_into long, match_id long, verified boolean, stage string")
    queue = spark.createDataFrame([(11, 1, 100, 10, 0), (12, 2, 100, 10, 0), (13, 5, 400, 10, 0), (14, 5, None, 10, 3), (15, None, None, 10, 0)], "id long, item_id long, match_id long, project long, revision long")
    groups = spark.createDataFrame([(100, 1, 10, False), (400, 4, 10, None)], "match_id long, item_id long, project long, undone boolean")
    moves = spark.createDataFrame([(i, 20) for i in (1, 2, 3, 4)], "id long, target long")
    out, cards, sets = ledger.move_project(expenses, queue, groups, moves)
    assert {r.id: (r.project, r.verified, r.review, r.outcome) for r in out.collect()} == {
        1: (20, False, True, "moved"), 2: (20, False, False, "merged"), 3: (10, True, False, "has a person"), 4: (10, False, False, "card changed"), 5: (10, False, False, "none"),
    }
    assert {r.id: (r.project, r.revision) for r in cards.collect()} == {11: (20, 1), 12: (20, 1), 13: (10, 0), 14: (10, 3), 15: (10, 0)}
    assert {r.match_id: r.project for r in sets.collect()} == {100: 20, 400: 10}


def test_acknowledged_gaps(spark):
    sources = [("a", "invoice", "d1"), ("b", "payment", "d2")]
    good = (True, False, ["发票"], "s", "old", sources, (["发票"], "s", sources[::-1]))
    rows = [
        good, (False, *good[1:]), (None, *good[1:]), (True, True, *good[2:]), (True, False, [], "s", "old", sources, ([], "s", sources)), (True, False, ["金额"], "s", "old", sources, (["金额"], "s", sources)),
        (*good[:6], (["行程单"], "s", sources)), (*good[:6], (["发票"], "old", sources)), (*good[:6], (["发票"], "other", sources)), (*good[:6], (["发票"], "s", sources[:1])), (*good[:6], None), (True, None, ["发票"], "s", None, sources, (["发票"], "s", sources)),
    ]
    src = "array<struct<id:string,role:string,digest:string>>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, verified boolean, amount_pending boolean, missing array<string>, scope string, old_scope string, sources {src}, ack struct<missing:array<string>,scope:string,sources:{src}>")
    got = {r.i: r.acknowledged for r in ledger.acknowledged(df).collect()}
    assert [i for i in range(len(rows)) if got[i]] == [0, 7, 11]
