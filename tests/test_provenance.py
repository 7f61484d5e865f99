import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import identifiers as ids
from ledgerlark.operators import provenance as ops
from ledgerlark.plans import registry
from ledgerlark.plans import sources as plans
from tests.helpers import HAVE_DATA, SF


def read_rows(text, role, platform, channel, shop):
    """Row by row, as a person would: the longest label that the row has, then its value."""
    rows = [r.strip() for r in text.splitlines() if r.strip()]
    out = []
    for at, raw in enumerate(rows):
        row = unicodedata.normalize("NFKC", raw)
        for label in sorted(ids.LABELS, key=len, reverse=True):
            value = None
            if row == label:
                value = rows[at + 1] if at + 1 < len(rows) else None
            elif row.startswith(label):
                rest = row[len(label) :]
                if rest.lstrip().startswith(":") and rest.lstrip()[1:].strip():
                    value = rest.lstrip()[1:].strip()
                elif rest[:1].isspace() or rest[:1].isdigit():
                    value = rest.strip()
            if value is not None or row == label:
                break
        else:
            continue
        value = "".join(unicodedata.normalize("NFKC", value or "").split())
        value = re.sub(r"[|丨│]?复制$", "", value)
        digits = sum(c.isascii() and c.isdigit() for c in value)
        good = re.fullmatch(r"[A-Za-z0-9-]{6,64}", value) and digits >= 4 and not re.fullmatch(r"1[3-9]\d{9}|\d{4}-\d{1,2}-\d{1,2}|0+", value)
        kind = ids.LABELS[label]
        if kind == "order":
            kind = "payment_order" if role == "payment" else "shopping_order" if role in ids.SHOPPING_ROLES else "untyped_order"
        if good and (kind, value) not in [(k, v) for k, v, _ in out]:
            out.append((kind, value, label))
    scope = {"shopping_order": platform, "payment_order": channel, "payment_transaction": channel, "merchant_order": platform or shop}
    values = lambda kind: {v for k, v, _ in out if k == kind}
    return [(k, "" if len(values(k)) > 1 else scope.get(k) or "", v, label) for k, v, label in out]


def keys_of(found):
    return list(dict.fromkeys(json.dumps([k, n, v], ensure_ascii=False, separators=(",", ":")) for k, n, v, _ in found if k != "untyped_order" and n and n not in ids.NO_SCOPE))


@pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")
def test_identifiers_of_all_receipts(spark):
    want = {}
    for r in plans.receipts(spark, SF).collect():
        found = read_rows(r.text, r.role, r.platform, r.channel, r.shop)
        want[r.id] = ("|".join("/".join(x) for x in found), "|".join(keys_of(found)))
    got = {r.id: (r.identifiers, r["keys"]) for r in registry.QUERIES["typed_identifiers"](spark, SF).collect()}
    assert got == want and len({k for _, k in got.values()}) > 100


def test_identifiers_by_hand(spark):
    cases = [
        ("订单号：AB 12345 复制\n订单详情", "", [("shopping_order", "美团", "AB12345", "订单号")]), ("商家订单号\n\n 7654321 ", "order", [("merchant_order", "美团", "7654321", "商家订单号")]),
        ("交易号 2024-01-02\n订单编号:000000", "order", []), ("交易号:123456\n支付宝交易号:654321", "payment", [("payment_transaction", "", "123456", "交易号"), ("payment_transaction", "", "654321", "支付宝交易号")]),
        ("支付单号123456", "payment", [("payment_order", "支付宝", "123456", "支付单号")]), ("支付单号x123456", "payment", []), ("", "payment", []), (None, "payment", []),
    ]
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(cases)], "i int, t string, r string")
    found = ids.typed_identifiers(F.col("t"), F.col("r"), F.lit("美团"), F.lit("支付宝"), F.lit(None).cast("string"))
    assert {r.i: [tuple(x) for x in r.f] for r in df.select("i", found.alias("f")).collect()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_doubt_voids_an_origin(spark):
    m = lambda i, digests, account=1, epoch=5: (i, account, "INBOX", epoch, i, f"<{i}>", digests)
    messages = spark.createDataFrame([m(1, ["a", "b"]), m(2, ["c", "c"]), m(3, ["d"], epoch=4), m(4, ["e"]), m(4, ["f"]), m(5, ["b"]), m(6, ["g", "h"], account=2)], "id long, account long, mailbox string, uidvalidity long, uid long, message_id string, digests array<string>")
    accounts = spark.createDataFrame([(1, "INBOX", 5), (2, "INBOX", 5), (2, "INBOX", 6)], "account long, mailbox string, uidvalidity long")
    rows = [(1, "agent", 1, "a"), (2, "agent", 1, "x"), (3, "agent", 2, "c"), (4, "agent", 3, "d"), (5, "agent", 4, "e"), (6, "mail", 9, "a"), (7, "mail", 9, "b"), (8, "mail", None, "zz"), (9, "agent", 1, "a"), (9, "agent", 1, "a"), (10, "agent", 6, "g"), (11, "mail", None, None), (12, "web", 1, "a")]
    got = ops.trusted_origins(spark.createDataFrame(rows, "id long, source string, batch long, digest string"), messages, accounts).collect()
    assert {(r.id, r.uid, r.authority) for r in got} == {(1, 1, "agent"), (6, 1, "manifest")}


def test_shards_overflow_and_ties(spark):
    rows = [(1, s, 10 + k, 0, k) for s in "ab" for k in range(3)] + [(2, "a", 10, 1, 1), (2, "a", 10, 1, 2), (2, "b", 10, 2, 1), (2, "b", 99, 1, 9)] + [(3, "a", 10, k, k) for k in range(6)]
    windows = spark.createDataFrame([(c, 10, 20) for c in (1, 2, 3, 4)], "chat long, start long, end long")
    messages, states = ops.merge_shards(spark.createDataFrame(rows, "chat long, shard string, second long, seq long, local_id long"), windows, most=5)
    got = sorted(messages.collect(), key=lambda r: (r.chat, r.place))
    assert [(r.shard, r.second, r.tied) for r in got if r.chat == 1] == [(s, 10 + k, True) for k in range(3) for s in "ab"]
    assert [(r.shard, r.local_id, r.tied) for r in got if r.chat == 2] == [("a", 1, False), ("a", 2, False), ("b", 1, False)] and not [r for r in got if r.chat == 3]
    assert {r.chat: (r.scanned, r.issues, r.safe) for r in states.collect()} == {1: (6, "order_across_shards", False), 2: (3, "", True), 3: (6, "overflow", False), 4: (0, "", True)}


def deep(value, n):
    for _ in range(n):
        value = {"data": [value, {"category": "餐饮"}]}
    return value


def test_rename_at_any_depth_and_back(spark):
    old = [
        {"category": "顺丰", "merchant": "顺丰", "note": "sf"}, {"report_section": "sf", "rows": [{"goods_category": "顺丰"}, {"kind": "category", "value": "顺丰"}, {"kind": "merchant", "value": "顺丰"}]},
        deep({"managed_category": "顺丰"}, 60), {"kind": "report_section", "value": "sf", "category": ["顺丰"]}, "顺丰", ["顺丰"], 5, None, {"category": "餐饮", "价": 1.50},
    ]
    texts = [json.dumps(x, ensure_ascii=bool(i % 2)) for i, x in enumerate(old)] + [None, "", "{顺丰", '{"category" :  "餐饮", "x": "sf"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, data string")
    out, applied = ops.migrate(rows, ["data"], spark.createDataFrame([], "name string"), "first")
    got = {r.i: r for r in out.collect()}
    assert json.loads(got[0].data) == {"category": "快递", "merchant": "顺丰", "note": "sf"}
    assert json.loads(got[1].data) == {"report_section": "express", "rows": [{"goods_category": "快递"}, {"kind": "category", "value": "快递"}, {"kind": "merchant", "value": "顺丰"}]}
    assert json.loads(got[2].data) == deep({"managed_category": "快递"}, 60) and json.loads(got[3].data) == {"kind": "report_section", "value": "express", "category": ["顺丰"]}
    assert {i for i, r in got.items() if r.changed} == {0, 1, 2, 3} and all(got[i].data == texts[i] for i in range(4, len(texts)))
    again, same = ops.migrate(out.drop("changed"), ["data"], applied, "first")
    assert not again.filter("changed").count() and same.count() == 1
    # A hash from before still is that of the row, and one of another row isn't.
    old_hash = lambda t: hashlib.sha256(t.encode()).hexdigest()
    before = [(i, old_hash(json.dumps(x, ensure_ascii=False))) for i, x in enumerate(old)]
    told = out.join(spark.createDataFrame(before, "i int, h string"), "i").select("i", ops.same_version(F.col("data"), F.col("h")).alias("ok"), ops.same_version(F.col("data"), F.lit("x")).alias("no")).collect()
    assert {r.i for r in told if r.ok} >= {0, 1, 2, 3, 4} and not any(r.no for r in told)
