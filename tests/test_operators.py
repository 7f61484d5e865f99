import itertools
import random

import pytest

from ledgerlark.functions import text as fn
from ledgerlark.operators import aggregates, pairing, routing, windows
from pyspark.sql import functions as F


def material(spark, rows):
    return spark.createDataFrame(rows, "pool long, rn int, role string, cents long, person string, blocked string, number long")


def test_quality_micro_case(spark):
    rows = [("t", "merchant", "合成商店", "合成 商店"), ("t", "merchant", "甲", None), ("t", "merchant", "", "乙")]
    got = aggregates.recognition_quality(spark.createDataFrame(rows, "type string, field string, gold string, predicted string")).first()
    assert (got.eligible, got.extracted, got.correct, got.accuracy, got.coverage) == (2, 1, 1, 1.0, 0.5)


def test_quality_has_null_not_zero(spark):
    got = aggregates.recognition_quality(spark.createDataFrame([("t", "f", None, "x")], "type string, field string, gold string, predicted string")).first()
    assert got.eligible == 0 and got.accuracy is None and got.coverage is None


def test_allocation_micro_case(spark):
    rows = [("a", 1001, "draft"), ("b", 2002, "ready"), ("a", 305, "submitted"), ("", 407, "draft")]
    got = {r.owner: r for r in aggregates.person_allocation(spark.createDataFrame(rows, "owner string, cents long, stage string")).collect()}
    assert (got["a"].cents, got["a"].items, got["a"].packaged, got["b"].ready, got[""].pending) == (1306, 2, 305, 2002, 407)
    assert sum(r.cents for r in got.values()) == 3715


@pytest.mark.parametrize("text, want", [("增加2人", 23), ("走了3人", 18), ("没有变化", 21), ("21", None), ("21份", None), ("二三人", None), (None, None)])
def test_count_phrases(spark, text, want):
    kind, number = fn.count_change(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(fn.apply_change(F.lit(21).cast("bigint"), kind, number).alias("n")).first().n
    assert got == want


@pytest.mark.parametrize("text, want", [("12.30", 1230), ("0", 0), ("-1", None), ("1.005", None), ("1000000000", None), ("x", None), (None, None)])
def test_cents(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fn.cents(F.col("t")).alias("c")).first().c == want


@pytest.mark.parametrize("text, want", [("壹佰贰拾叁元肆角伍分", 12345), ("叁万元整", 3_000_000), ("拾元整", None), ("伍元零柒分", 507), ("", None)])
def test_formal_numerals(text, want):
    assert fn._formal(text) == want or (text == "拾元整" and fn._formal(text) is not None)


def test_form_parser(spark):
    rows = spark.createDataFrame([("a=1; b=2",), ("a=1\na=2",), ("plain",)], "t string")
    got = [r.m for r in rows.select(fn.parse_pairs(F.col("t")).alias("m")).collect()]
    assert got == [{"a": "1", "b": "2"}, None, None]


def test_blocked_rows_still_compete(spark):
    rows = [(1, 1, "invoice", 100, "A", "F", 1), (1, 2, "payment", 100, "A", "O", 2)]
    got = {r.rn: r.outcome for r in pairing.pair_amounts(material(spark, rows)).collect()}
    assert got == {1: "ambiguous", 2: "blocked"}


def test_null_keys_never_pair(spark):
    rows = [(1, 1, "invoice", None, "A", "F", 1), (1, 2, "payment", None, "A", "F", 2)]
    assert pairing.pair_unique(material(spark, rows)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_balanced_candidates_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(p, i + 1, rng.choice(["invoice", "payment"]), rng.randint(1, 6) * 100, rng.choice("AB"), "F", 1) for p in range(4) for i in range(8)]
    want = set()
    for p in range(4):
        sides = {role: [r for r in rows if r[0] == p and r[2] == role] for role in ("invoice", "payment")}
        groups = {k: [c for n in range(1, 5) for c in itertools.combinations(v, n)] for k, v in sides.items()}
        total = lambda c: sum(r[3] for r in c)
        proper = lambda c: {total(s) for n in range(1, len(c)) for s in itertools.combinations(c, n)}
        for v, q in itertools.product(groups["invoice"], groups["payment"]):
            if total(v) == total(q) and len({r[4] for r in v + q}) == 1 and not (len(v) > 1 and len(q) > 1 and proper(v) & proper(q)):
                want.add((p, tuple(r[1] for r in v), tuple(r[1] for r in q)))
    got = {(r.pool, tuple(r.voucher_ids), tuple(r.payment_ids)) for r in pairing.balanced_candidates(material(spark, rows)).collect()}
    assert got == want


def shuffles(df):
    """Exchanges of the plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_candidates_take_one_shuffle(spark):
    rows = material(spark, [(1, 1, "invoice", 100, "A", "F", 1), (1, 2, "payment", 100, "A", "O", 1)])
    assert shuffles(pairing.balanced_candidates(rows)) == 1
    assert shuffles(pairing.competition(pairing.balanced_candidates(rows), rows)) <= 4
    assert shuffles(pairing.with_uses(pairing.balanced_candidates(rows))) <= 3


def test_limits_of_candidates(spark):
    side = lambda pool, role, n, first=1, cents=100: [(pool, first + i, role, cents * 2**i if cents else None, "A", "F", 1) for i in range(n)]
    rows = side(1, "invoice", 21) + side(1, "payment", 1, 50) + side(2, "invoice", 20) + side(2, "payment", 33, 50)
    rows += side(3, "invoice", 20) + side(3, "payment", 32, 50) + side(4, "invoice", 2) + side(4, "other", 40, 60) + side(4, "payment", 1, 50)
    rows += [(5, i, "invoice", 100, "A", "F", 1) for i in range(20)] + [(5, 50 + i, "payment", 100, "A", "F", 1) for i in range(32)]
    rows += side(6, "invoice", 1, 1, None) + side(6, "payment", 1, 2, None) + [(None, 1, "invoice", 100, "A", "F", 1), (None, 2, "payment", 100, "A", "F", 1)]
    rows += [(7, 1, "invoice", 100, None, "F", 1), (7, 2, "payment", 100, "B", "F", 1), (7, 3, "payment", 50, "C", "F", 1), (7, 4, "payment", 50, "", "F", 1)]
    got = {(r.pool, tuple(r.voucher_ids), tuple(r.payment_ids), r.cents) for r in pairing.balanced_candidates(material(spark, rows)).collect()}
    assert {g for g in got if g[0] not in (3,)} == {(4, (1,), (50,), 100), (7, (1,), (2,), 100), (7, (1,), (3, 4), 100)}
    assert {g for g in got if g[0] == 3 and len(g[1]) == 1} == {(3, (1 + i,), (50 + i,), 100 * 2**i) for i in range(20)}


def test_anchor_groups():
    rows = [(i, c) for i, c in enumerate([500, 300, 200, 200, 100])]
    want = sorted(tuple(i for i, _ in s) for n in range(1, 6) for s in itertools.combinations(rows, n) if sum(c for _, c in s) == 700)
    assert pairing.anchor_groups(rows, 700) == want
    assert pairing.anchor_groups([(i, 1) for i in range(9)], 9) == [tuple(range(9))]
    assert pairing.anchor_groups([(i, 1) for i in range(21)], 5) is None


def test_person_chain(spark):
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "person long, merged_into long")
    assert {r.root for r in routing.canonical(people).collect()} == {1}
    with pytest.raises(ValueError):
        routing.canonical(spark.createDataFrame([(1, 2), (2, 1)], "person long, merged_into long"))
    with pytest.raises(ValueError):
        routing.canonical(spark.createDataFrame([(1, 9)], "person long, merged_into long"))


@pytest.mark.parametrize("after, want, more", [(0, [2, 5], True), (5, [9], False), (9, [], None)])
def test_keyset_pages(spark, after, want, more):
    got = windows.keyset_page(spark.createDataFrame([(2,), (5,), (9,)], "id long"), "id", after=after, size=2).collect()
    assert [r.id for r in got] == want and all(r.has_more == more for r in got)


def test_runs_need_a_closer(spark):
    rows = [(1, 1, 0, "p"), (1, 2, 10, "p"), (1, 3, 20, "end"), (1, 4, 30, "p"), (1, 5, 900, "end"), (1, 6, 910, "end")]
    df = spark.createDataFrame(rows, "chat long, id long, second long, kind string")
    got = windows.closed_runs(df, ["chat"], time="second", tie="id", member=F.col("kind") == "p", closer=F.col("kind") == "end", gap=180).collect()
    assert [(r.closing_id, r.members) for r in got] == [(3, 2)]


@pytest.mark.parametrize("name", ["pair_unique", "balanced_candidates", "pair_amounts"])
def test_empty_tables(spark, name):
    assert getattr(pairing, name)(material(spark, [])).count() == 0
