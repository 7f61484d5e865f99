import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import evidence as ev
from ledgerlark.functions import text as fn
from ledgerlark.operators import evidence as joins
from ledgerlark.operators import ledger, pairing, routing, rules


def values(spark, function, texts, *more):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    return [r.v for r in rows.select(function(F.col("t"), *more).alias("v")).collect()]


def test_kinds_and_providers(spark):
    texts = ["滴滴出行 - 行程单", "电子发票\n价税合计 5", "电⼦发票 发票号码", "行程单", None, "", "上车时间起点终点金额 用车人手机号 行程总计 订单类型 所在城市 起点/终点 可开票金额 共1笔行程，合计8元"]
    assert values(spark, ev.document_kind, texts) == ["trip", "invoice", "invoice", None, None, None, "trip"]
    assert values(spark, ev.provider, ["上汽享道 曹操出行", "GeelyRide", "滴滴", "x", None]) == ["xiangdao", "caocao", "didi", "unknown", "unknown"]


def test_amounts(spark):
    texts = ["（小写）¥12.30", "价税合计\n¥12.30", "价税合计: 5\n(小写)5.00", "价税合计: 5\n(小写)6", "(小写)1.234", "Total With Tax ￥7", None]
    assert values(spark, ev.invoice_amount, texts) == [1230, None, 500, None, None, 700, None]
    assert values(spark, ev.trip_amount, ["共计3单行程 总计可开票金额 ¥8.5 元", "Trip total: 9", "合计 5", None]) == [850, 900, None, None]


def test_tax_rows(spark):
    texts = ["*住宿服务*房", "*五金*钉\n*办公用品*笔", "*五金*安装费", "*住宿服务*房\n*五金*钉", "*神秘*x", "", None]
    assert values(spark, ev.tax_category, texts) == ["酒店", "材料采购", None, None, None, None, None]


def test_labelled_values(spark):
    texts = ["备 注：a b\n备注\n\nc\n其他：d\n备注", "备注" + "x" * 161, None]
    assert values(spark, lambda t: ev.label_values(t, ("备注",)), texts) == [["ab", "c"], [], []]


def test_transaction_times(spark):
    when = datetime.datetime
    texts = ["支付时间 2025年1月2日 03:04:05.6", "交易时间\n2025/1/2 3:04", "支付时间 2025-01-02 03:04:05Z", "支付时间:2025-01-02 03:04\n付款时间:2025-01-02 03:05", "时间 2025-01-02 03:04", None]
    got = values(spark, lambda t: ev.transaction_time(t, F.lit("payment")), texts)
    assert [tuple(r) for r in got] == [
        (when(2025, 1, 2, 3, 4, 5, 600000), "fraction", False), (when(2025, 1, 2, 3, 4), "minute", False), (None, None, False), (None, None, True), (None, None, False), (None, None, False),
    ]
    both = "支付时间 2025-01-02 03:04\n下单时间 2025-01-01 01:01"
    assert values(spark, lambda t: ev.transaction_time(t, F.lit("order")), [both])[0].value == when(2025, 1, 1, 1, 1)


def test_merchants(spark):
    texts = ["南昌市 红谷建材有限公司", "红谷建材有限公司开票¥5元", "红谷建材有限公司开票6元", "建材有限公司", "红谷银行股份有限公司", None]
    assert values(spark, ev.company_identity, texts, F.lit(500)) == ["南昌市红谷建材有限公司", "红谷建材有限公司", None, None, None, None]
    texts = ["美团", "赣江之星酒店", "快捷酒店", "红谷滩大酒店（个体工商户）", "中国铁路", "餐饮服务", "红谷小吃店(东湖店)"]
    assert values(spark, ev.specific_merchant, texts, F.lit(500)) == [None, "赣江之星酒店", "快捷酒店", "红谷滩大酒店", "中国铁路", None, "红谷小吃店(东湖店)"]
    same = spark.createDataFrame([("南昌市甲乙", "甲乙"), ("甲乙", "南昌甲乙"), ("甲乙", "甲乙"), ("", ""), ("甲", "乙"), (None, "甲")], "a string, b string")
    assert [r.s for r in same.select(ev.same_company(F.col("a"), F.col("b")).alias("s")).collect()] == [True, True, True, False, False, False]


def test_states_and_roles(spark):
    assert values(spark, ev.payment_state_text, ["申请退款 >\n当前状态\n\n退款申请\n", None]) == ["\n当前状态\n\n退款申请\n", ""]
    assert values(spark, lambda t: ev.payment_ineligible(F.lit(""), t), ["已 退款", "ok", None]) == [True, False, False]
    role = lambda t: ev.effective_role(F.lit("order"), F.lit(None).cast("string"), t, F.lit(False))
    texts = ["交易成功\n实付款 5", "交易成功", "交易成功 实付5\n配送中", "订单已延迟1小时2分钟送达\n实付5", "退款成功 交易成功 实付5", None]
    assert values(spark, role, texts) == ["receipt", "order", "order", "receipt", "order", "order"]


def test_codes_confirmations_and_numbers(spark):
    rows = spark.createDataFrame([(500, 500, 500, [200, 300], None), (500, 500, 500, [1], None), (500, 400, 500, [], " "), (500, 400, 500, [], "why"), (1, 1, 1, [0] * 51, None)], "a long, f long, s long, p array<long>, r string")
    got = [r.v for r in rows.select(ev.confirm_amounts(*(F.col(c) for c in "afspr")).alias("v")).collect()]
    assert got == [None, "sum", "reason", None, "parts"]
    numbers = spark.createDataFrame([(decimal.Decimal(x),) for x in ("0", "100", "1.50", "2.345", "2.355", "10.01")], "n decimal(20,6)")
    assert [r.v for r in numbers.select(ev.number_text(F.col("n")).alias("v")).collect()] == ["0", "100", "1.5", "2.34", "2.36", "10.01"]
    days = spark.createDataFrame([(d,) for d in (1, 10, 11, 20, 31)], "d int")
    assert [r.v for r in days.select(ev.day_text(F.col("d")).alias("v")).collect()] == ["一", "十", "十一", "二十", "三十一"]
    files = spark.createDataFrame([(b"%PDF-1",), (b"\xff\xd8\xff0",), (b"RIFF1234WEBPx",), (b"",), (b"GIF8",), (None,)], "c binary")
    assert [r.v for r in files.select(ev.file_kind(F.col("c")).alias("v")).collect()] == [".pdf", ".jpg", ".webp", None, None, None]


def test_photo_hints(spark):
    got = values(spark, ev.photo_hints, ["2026.09.25 拍摄时间：8:05 京A·12345 地点:展馆 防伪", "2026-1-2,2026-1-3 时间 25:00", None])
    assert tuple(got[0]) == (datetime.date(2026, 9, 25), "08:05", "京A12345", "展馆") and tuple(got[1])[:2] == (None, None)


def test_pairs_keep_all_after_the_first_separator(spark):
    assert values(spark, fn.parse_pairs, ["a=b=c；d：e", "a=1\na=2", "x", None]) == [{"a": "b=c", "d": "e"}, None, None, None]


def test_rides_and_renderings(spark):
    day = datetime.date
    trips = spark.createDataFrame([(1, "d", 5, day(2025, 1, 2), ["m"]), (2, "d", 6, None, ["m"]), (3, "d", 7, day(2025, 1, 9), ["m"]), (4, None, 5, None, ["m"])], "id int, provider string, cents int, ended date, sources array<string>")
    bills = spark.createDataFrame([(10, "d", 5, day(2025, 1, 2), ["m", "n"]), (11, "d", 6, day(2025, 1, 1), ["m"]), (12, "d", 6, None, ["m"]), (13, "d", 7, day(2025, 1, 8), ["m"])], "id int, provider string, cents int, dated date, sources array<string>")
    assert [tuple(r) for r in joins.ride_pairs(trips, bills).collect()] == [(1, 10)]
    shape = "id int, batch string, source string, project string, stem string, number string, conflict boolean"
    images = spark.createDataFrame([(1, "b", "", "", "x", "", False), (2, "b", "", "", "y.pdf", "", False), (3, "b", "", "", "q", "77", False), (4, "b", "", "", "x", "9", False), (5, "b", "", "", "x", "", True)], shape)
    files = spark.createDataFrame([(10, "b", "", "", "x", "8", False, "x.pdf"), (11, "b", "", "", "y", "77", False, "y.pdf"), (12, "c", "", "", "x", "", False, "x.pdf")], shape + ", name string")
    assert sorted(map(tuple, joins.render_pairs(images, files).collect())) == [(1, 10), (2, 11), (3, 11)]


def test_union_keeps_the_first_of_each_identity(spark):
    one, two = spark.createDataFrame([(1, "a"), (None, "b")], "id int, x string"), spark.createDataFrame([(1, "c"), (2, "d"), (None, "e")], "id int, x string")
    assert sorted((r.x for r in joins.union_by_identity(one, two).collect())) == ["a", "b", "d", "e"]


def test_cleanup_needs_a_day(spark):
    with pytest.raises(ValueError):
        joins.cleanup_candidates(spark.range(1), datetime.datetime(2025, 1, 1), 0)


def test_a_pool_of_equal_amounts_is_over_its_limit_before_pairs_are_made(spark):
    rows = [(1, i, "invoice" if i < pairing.MAX_VOUCHERS else "payment", 100, "p", "F", i) for i in range(pairing.MAX_VOUCHERS + pairing.MAX_PAYMENTS)]
    rows += [(2, 0, "invoice", 300, "p", "F", 0), (2, 1, "payment", 100, "p", "F", 1), (2, 2, "payment", 200, "p", "F", 2)]
    material = spark.createDataFrame(rows, "pool int, rn int, role string, cents long, person string, blocked string, number int")
    assert [(r.pool, r.voucher_ids, r.payment_ids) for r in pairing.balanced_candidates(material).collect()] == [(2, [0], [1, 2])]


def test_closure_of_a_chain_with_a_loop_and_nulls(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0), (3, None), (None, 50), (60, 61)], "src int, dst int")
    seeds = spark.createDataFrame([(2,), (2,), (None,)], "node int")
    assert sorted(r.node for r in routing.closure(seeds, edges, cut_every=3).collect()) == list(range(10))


REASON_CASES = [
    ("12", " A店 铺", "3.50", "单 1 2号 A店\n铺 3.50元", ["order", "merchant", "amount"]),
    ("12", "AB", "3.50", "312 AB 13.50 .3.50 3.501", []),
    ("a\\Eb", None, "", "x a\\Eb x", ["order"]),
    (" 7 ", "A.C", "3.50", "7 ABC 3450", ["order"]),
    ("", None, None, "anything", []),
    ("5", "shop", "1.00", None, []),
    ("5", "", "1.00", "5\u0665 \u06651.00", []),
]


def test_match_reasons(spark):
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(REASON_CASES)], "i int, o string, m string, a string, t string")
    got = rows.select("i", ev.match_reasons(F.col("o"), F.col("m"), F.col("a"), F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [c[4] for c in REASON_CASES]


def test_returns_of_whole_batches_only(spark):
    state = [(i, "p", stage, ready, 1, closed) for i, stage, ready, closed in (
        (1, "submitted", False, None), (2, "draft", True, False), (3, "draft", None, False), (4, "reimbursed", None, None), (5, "submitted", None, True), (6, "submitted", None, None))]
    commands = [("a", 1, "p", 1), ("a", 2, "p", 1), ("b", 3, "p", 1), ("b", 4, "p", 1), ("c", 5, "p", 1), ("d", 6, "p", 1), ("d", 99, "p", 1)]
    state = spark.createDataFrame(state, "id int, project string, stage string, ready boolean, version int, closed boolean")
    schema = "batch string, id int, project string, version int"
    got = ledger.return_to_review(state, spark.createDataFrame(commands, schema)).filter("review").collect()
    assert sorted((r.id, r.stage, r.ready, r.version) for r in got) == [(1, "draft", False, 2), (2, "draft", False, 2)]
    twice = spark.createDataFrame([*commands, ("e", 1, "p", 1)], schema)
    assert ledger.return_to_review(state, twice).filter("review").isEmpty()
    assert ledger.return_to_review(state, spark.createDataFrame(commands, schema), most=1).filter("review").isEmpty()


def test_late_routes(spark):
    day = datetime.date
    messages = [(1, "unassigned", None, day(2024, 1, 2), day(2024, 1, 5)), (2, "unassigned", None, day(2024, 1, 2), day(2024, 2, 5)), (3, "dismissed", None, day(2024, 1, 2), day(2024, 1, 2)),
        (4, "unassigned", True, day(2024, 1, 2), day(2024, 1, 2)), (5, "unassigned", False, None, None), (6, "unassigned", False, day(2024, 3, 1), day(2024, 3, 1))]
    messages = spark.createDataFrame(messages, "id int, status string, touched boolean, first date, last date")
    projects = [("a", day(2024, 1, 1), day(2024, 1, 31), False), ("b", day(2024, 1, 1), None, True), ("c", day(2024, 2, 20), None, None), ("d", day(2024, 2, 21), day(2024, 3, 1), None)]
    projects = spark.createDataFrame(projects, "project string, start date, end date, reimbursed boolean")
    found = lambda default: sorted(tuple(r) for r in routing.reroute_unassigned(messages, projects, default).collect())
    assert found(None) == found("gone") == [(1, "a", "date")]
    assert found("b") == [(1, "a", "date"), (2, "b", "default"), (6, "b", "default")]


ATTACHED = [("1", "z", "invoice", True), ("2", "b", "payment", True), ("3", "c", "receipt", True), ("4", "a", "order", True), ("5", "d", "package", True), ("6", "e", "invoice", False), ("7", "a", "invoice", None)]
PRINT_CASES = [
    ({"acknowledged": True}, ["1", "2", "3", "4", "5"]),
    ({"acknowledged": True, "complete": True, "category": "rail"}, ["1"]),
    ({"basis": "payment_only", "trip_required": True}, ["2"]),
    ({"basis": "invoice_payment"}, ["3", "1", "2"]),
    ({"basis": "invoice_payment", "support": ["4"]}, ["3", "1", "2", "4"]),
    ({"basis": "invoice_payment", "support": ["4", "4"]}, None),
    ({"basis": "invoice_payment", "support": ["2"]}, None),
    ({"basis": "invoice_payment", "support": ["9"]}, None),
    ({"legacy": True, "category": "rail"}, ["5"]),
    ({"category": "takeout"}, ["4", "1"]),
    ({"category": "printing"}, ["3", "2", "1"]),
    ({"category": "materials", "alternative": True}, ["2"]),
    ({"category": "other"}, None),
    ({"attachments": None, "category": "rail"}, []),
    ({"attachments": None, "legacy": True}, None),
]


def test_printed_attachments(spark):
    flags = ("acknowledged", "complete", "trip_required", "waybill_required", "legacy", "alternative")
    schema = "i int, attachments array<struct<id: string, name: string, role: string, available: boolean>>, support array<string>, basis string, category string, "
    rows = [(i, c.get("attachments", ATTACHED), c.get("support"), c.get("basis"), c.get("category"), *(c.get(f) for f in flags)) for i, (c, _) in enumerate(PRINT_CASES)]
    got = rules.selected_attachments(spark.createDataFrame(rows, schema + ", ".join(f"{f} boolean" for f in flags))).orderBy("i").collect()
    assert [r.selected for r in got] == [want for _, want in PRINT_CASES]


def test_category_status(spark):
    items = [(1, "draft", None, None, "other", None, "k"), (2, "draft", True, None, "other", None, "k"), (3, "draft", None, None, "meals", None, "k"), (4, "draft", None, None, "meals", None, "k"),
        (5, "draft", None, None, "other", True, "k"), (6, "submitted", None, None, "other", None, "k"), (7, "draft", None, None, None, None, None)]
    items = spark.createDataFrame(items, "id int, stage string, verified boolean, closed boolean, category string, manual boolean, input_key string")
    tried = [(3, "saved", "meals", None, "k"), (4, "failed", None, "meals", "old"), (5, "saved", "other", None, "k"), (6, "manual", None, None, "k"), (7, "saved", None, None, None)]
    tried = spark.createDataFrame(tried, "item int, status string, category string, managed string, input_key string")
    got = {r.id: (r.status, r.eligible, r.pending) for r in rules.category_status(items, tried).collect()}
    assert got == {1: (None, True, True), 2: (None, False, False), 3: ("saved", True, False), 4: ("failed", True, True), 5: ("manual", False, False),
        6: ("manual", False, False), 7: ("saved", False, False)}


def test_source_relations_with_transfers_and_conflicts(spark):
    x = lambda v: [("payment_order", "支付宝", v)]
    rows = [
        ([], [], "unknown", False, "南昌市红谷建材有限公司", "微信 转给 红谷建材有限公司 成功", True), ([], [], "unknown", True, "红谷建材有限公司", "转给红谷建材有限公司", False),
        ([], [], "unknown", False, "红谷建材有限公司", "转给别家建材有限公司", False), ([], [], "no", False, None, "转给红谷建材有限公司", False), ([], [], "yes", False, None, None, True), ([], [], "yes", True, None, None, False),
        (x("a1"), x("b2"), "yes", False, "红谷建材有限公司", "转给红谷建材有限公司", False), (x("a1"), x("a1"), "unknown", None, None, "红谷建材有限公司", True), ([], [], None, None, None, None, False),
    ]
    ids = "array<struct<kind:string,namespace:string,value:string>>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, l {ids}, r {ids}, rel string, c boolean, name string, t string, want boolean")
    df = df.withColumn("to", ev.transfer_recipient(F.col("t")))
    got = df.select("i", "want", ev.source_relation(F.col("l"), F.col("r"), F.col("rel"), conflict=F.col("c"), identity=F.col("name"), recipient=F.col("to")).alias("got")).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_buyer_against_the_profile(spark):
    rows = [
        (["甲公司"], ["h1"], "甲 公司", "h1", ("match", [])), (["甲公司"], ["h1"], "甲公司", "", ("partial", [])), (["甲公司"], ["h1"], "乙公司", "h2", ("mismatch", ["name", "tax_id"])), (["甲公司"], [], "甲公司", None, ("match", [])),
        (["ABC"], None, "ａｂｃ", "h9", ("match", [])), (["甲公司"], ["h1"], None, None, ("unreadable", [])), ([], [], "甲公司", "h1", None), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, n array<string>, h array<string>, name string, tax string")
    got = {r.i: r.c for r in df.select("i", ev.compare_company(F.col("n"), F.col("h"), F.col("name"), F.col("tax")).alias("c")).collect()}
    assert [got[i] and tuple(got[i]) for i in range(len(rows))] == [r[4] for r in rows]


def test_renderings_need_a_batch(spark):
    schema = "id long, batch string, source string, project string, stem string, number string, conflict boolean, name string"
    rows = [(1, "", "s", "", "a", "", False, "a.pdf"), (2, None, "s", "", "b", "", False, "b.pdf"), (3, "x", "s", "", "c", "", False, "c.pdf")]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in joins.render_pairs(df, df.withColumn("id", F.col("id") + 10)).collect()] == [(3, 13)]


def test_a_missing_key_fails_the_whole_call(spark):
    from ledgerlark.operators import windows

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    wanted = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "pos long, id long")
    assert sorted((r.pos, r.v) for r in windows.get_many(wanted(2, 1, 2), rows, "id").collect()) == [(0, "b"), (1, "a"), (2, "b")]
    for ids in ((1, 3), (None,)):
        with pytest.raises(Exception, match="no row with id"):
            windows.get_many(wanted(*ids), rows, "id").collect()
