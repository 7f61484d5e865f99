"""What evidence states, read by plain scanners that share only the fixed words with the columns, over texts put together at random."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import evidence as ev

N = 2500


def flat(text):
    return "".join(unicodedata.normalize("NFKC", text or "").split())


def lines(text):
    return re.split(ev.LINE_BREAK.replace(r"  ", "  "), text or "")


def tight(text):
    return "".join(c for c in text if not c.isspace())


def texts_of(seed, parts, gaps=("", "", " ", "\n", "\n", "，", "　", "x", "5"), most=7):
    rng = random.Random(seed)
    made = [None, ""]
    for _ in range(N):
        made.append("".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(1, most))))
    return made


def same(spark, function, scanner, texts, least=3):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r.v for r in rows.select("i", function(F.col("t")).alias("v")).collect()}
    want = {i: scanner(t) for i, t in enumerate(texts)}
    wrong = {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]}
    assert not wrong, list(wrong.values())[:3]
    assert len({str(v) for v in want.values()}) >= least


# -- kinds and providers

NAMES = {"xiangdao": ("享道出行", "上汽享道", "XIANGDAO"), "caocao": ("曹操出行", "吉利优行", "CAOCAOTRAVEL", "GEELYRIDE"), "didi": ("滴滴", "DIDITRAVEL")}
KIND_PARTS = (
    "行程单", "行程 单", "上车时间", "起点", "终点", "金额", "共2笔行程", "，合计", "合计¥12.50元", "12", "电子发票", "发票号码", "价税合计", "Electronic Invoice", "Total With Tax", "invoice number",
    "滴滴出行-", "滴滴", "曹操出行", "Xiang Dao", "上汽享道", "didi travel", "Trip Table", "Trip Total", "pickup", "DESTINATION", "amount", "用车人手机号", "行程总计", "共３单行程合计8", "GEELYRIDE",
)


def test_providers(spark):
    def scan(text):
        t = flat(text)
        return next((name for name, words in NAMES.items() if any(w.lower() in t.lower() for w in words)), "unknown")

    same(spark, ev.provider, scan, texts_of(1, KIND_PARTS), 4)


def number_at(text, at):
    """The number that starts at ``at``, with two decimals at most, and where it ends."""
    end = at
    while end < len(text) and text[end] in "0123456789":
        end += 1
    if end == at:
        return None, at
    if text[end : end + 1] == "." and text[end + 1 : end + 2] in tuple("0123456789"):
        stop = end + 2 + (text[end + 2 : end + 3] in tuple("0123456789"))
        return text[at:stop], stop
    return text[at:end], end


def skip(text, at, *choices):
    """``at`` behind the first of ``choices`` that stands there."""
    return next((at + len(c) for c in choices if text.startswith(c, at)), at)


def to_cents(number):
    whole, _, part = number.partition(".")
    return int(whole) * 100 + int(part.ljust(2, "0")[:2])


def trip_total(text):
    t = flat(text)
    for at in range(len(t)):
        if t[at] == "共":
            start = skip(t, at + 1, "计")
            end = start
            while end < len(t) and t[end].isdecimal() and t[end].isascii():
                end += 1
            if end == start or t[end : end + 1] not in tuple("笔次个单") or not t.startswith("行程", end + 1):
                continue
            mark = skip(t, end + 3, "，", ",", ";", "；", "。")
            word = skip(t, mark, "合计", "总计可开票金额")
            number, _ = number_at(t, skip(t, word, "¥", "￥"))
            if word > mark and number:
                return to_cents(number)
    upper = t.upper()
    at = upper.find("TRIPTOTAL")
    while at >= 0:
        number, _ = number_at(t, skip(t, skip(t, at + 9, ":", "："), "¥", "￥"))
        if number:
            return to_cents(number)
        at = upper.find("TRIPTOTAL", at + 1)
    return None


def test_document_kinds(spark):
    def scan(text):
        t = flat(text)
        up = t.upper()
        chinese = bool(re.search("共计?[0-9]+[笔次个单]行程", t)) and trip_total(re.sub("(?i)triptotal", "", t)) is not None and all(w in t for w in ("上车时间", "起点", "终点", "金额"))
        chinese = chinese and ("行程单" in t or all(w in t for w in ev.TRIP_HEADINGS))
        english = all(w in up for w in ("TRIPTABLE", "TRIPTOTAL", "PICKUP", "DESTINATION", "AMOUNT"))
        if any(m in t for m in ev.TRIP_MARKERS) or chinese or english:
            return "trip"
        title = "电子发票" in t or "ELECTRONICINVOICE" in up
        return "invoice" if title and any(w in up for w in ("价税合计", "发票号码", "INVOICENUMBER", "TOTALWITHTAX")) else None

    whole = ["上车时间起点终点金额共2笔行程合计5元行程单", "Trip Table Trip Total pickup destination amount"]
    same(spark, ev.document_kind, scan, texts_of(2, KIND_PARTS, most=16) + texts_of(3, (*KIND_PARTS, *whole)), 3)


# -- amounts

AMOUNT_PARTS = ("价税合计", "（小写）", "(小写)", "Total With Tax", "TRIP TOTAL", "：", ":", "¥", "￥", "12", "12.5", "12.50", "７.25", "3.456", "8.", "0", "共2笔行程", "共计11单行程", "，", "合计", "总计可开票金额", "元")


def test_invoice_amounts(spark):
    def scan(text):
        found = set()
        for row in lines(text):
            t = flat(row)
            up = t.upper()
            for label, colon in (("(小写)", False), ("TOTALWITHTAX", True), ("价税合计", True)):
                for at in (m.start() for m in re.finditer(re.escape(label), up)):
                    start = at + len(label)
                    start = skip(t, skip(t, start, ":", "：") if colon else start, "¥", "￥")
                    end = start
                    while end < len(t) and t[end] in "0123456789.":
                        end += 1
                    if re.fullmatch(r"[0-9]+(\.[0-9]{1,2})?", t[start:end]):
                        found.add(to_cents(t[start:end]))
        return found.pop() if len(found) == 1 else None

    same(spark, ev.invoice_amount, scan, texts_of(4, AMOUNT_PARTS, gaps=("", "", "", "\n", " ")), 8)


def test_trip_amounts(spark):
    same(spark, ev.trip_amount, trip_total, texts_of(5, AMOUNT_PARTS, gaps=("", "", "", "\n", " "), most=10), 5)


# -- labels and tax classes


def test_label_values(spark):
    def scan(text):
        rows = [r for r in map(tight, lines(text)) if r]
        out = []
        for at, row in enumerate(rows):
            label = next((x for x in ("商品说明", "备注") if row.startswith(x)), None)
            if label is not None:
                own = row[len(label) :]
                own = own[1:] if own[:1] in (":", "：") else own
                value = own or (rows[at + 1] if at + 1 < len(rows) else "")
                if value and len(value) <= 160:
                    out.append(value)
        return out

    parts = ("商品说明", "备注", "：", ":", "会议 12", "客户", "说明", "y" * 170, " ")
    same(spark, lambda t: ev.label_values(t, ("商品说明", "备注")), scan, texts_of(6, parts, gaps=("", "", "\n", " \n\n", " ")), 20)


def test_tax_categories(spark):
    def scan(text):
        classes, work = [], False
        for raw in lines(unicodedata.normalize("NFKC", text or "")):
            parts = raw.strip().split("*")
            if len(parts) == 3 and parts[0] == "" and 1 <= len(parts[1]) <= 50:
                classes.append(ev.TAX_CATEGORIES.get(tight(parts[1]), ""))
                work |= any(w in parts[2] for w in ev.NO_GOODS.split("|"))
        category = classes[0] if len(set(classes)) == 1 else ""
        return None if not category or category == "材料采购" and work else category

    parts = ("*", "*", "＊", "住宿服务", "住宿 服务", "文具", "五金", "铁路客运", "餐饮服务", "房费", "安装费", "笔", "x")
    rows = ("*文具*笔\n", "*五金*螺丝\n", "*住宿服务*房费\n", "*五金*安装\n", "*未知*x\n", " ＊文具＊ 本 \n", "*铁路客运服务*票\n")
    same(spark, ev.tax_category, scan, texts_of(7, parts, gaps=("", "", "", "\n")) + texts_of(8, rows, gaps=("",), most=4), 4)


# -- states and roles

STATE_PARTS = (
    "申请退款 >", "退款申请", "当前状态", "交易状态：", "订单已送达", "订单已提前12分钟送达", "配送已完成 >", "已签收", "交易成功", "已付款", "实付款：¥12.50", "实付 5", "待发货", "订单状态：待发货", "配送中", "已退款", "退款成功",
    "等待对方收款", "转账中", "未付款", "铁路电子客票", "商品", "已 退款", "支付成功",
)
ROWS = ("\n", "\n", " ", "", "\n\n", "，")


def state_text(text):
    label, out = "", []
    for row in lines(text):
        control = row.strip("\t ").rstrip("›>↗").rstrip("\t ") in ("可申请退款", "申请退款", "退款申请") and bool(re.fullmatch(r"[\t ]*[^\t ›>↗]+[\t ]*[›>↗]?[\t ]*", row)) and label not in ev.STATE_LABELS
        name = tight(row).rstrip(":：")
        label = name or label
        out.append("" if control else row)
    return "\n".join(out)


def test_state_texts(spark):
    same(spark, ev.payment_state_text, state_text, texts_of(9, STATE_PARTS, gaps=ROWS), 50)


def any_of(text, words):
    return any(w in text for w in words.split("|"))


@pytest.mark.parametrize("status", [None, "succeeded", "refunded", "uncertain"])
def test_ineligible_payments(spark, status):
    scan = lambda t: status in ev.BAD_PAYMENT_STATES or any_of(tight(t or ""), ev.BAD_PAYMENT_TEXT)
    same(spark, lambda t: ev.payment_ineligible(F.lit(status).cast("string"), t), scan, texts_of(10, STATE_PARTS, gaps=ROWS), 1 if status == "refunded" else 2)


@pytest.mark.parametrize("role,status", [("order", None), ("purchase", "succeeded"), ("order", "refunded"), ("payment", "succeeded"), (None, None)])
def test_effective_roles(spark, role, status):
    delivered, unsent = re.compile(ev.DELIVERED_ROW), re.compile(ev.UNSENT_ROW)

    def scan(text):
        own = role or "other"
        if own not in ("order", "purchase"):
            return own
        source = state_text(text)
        t, rows = tight(source), [tight(r) for r in lines(source)]
        if (status or "") not in ("", "succeeded", "unknown", "uncertain") or any_of(t, ev.OPEN_PURCHASE) or any(unsent.search(r) for r in rows):
            return own
        paid = any(number_at(t, skip(t, skip(t, m.end(), ":", "："), "¥", "￥"))[0] for m in re.finditer("实付款|实付金额|实际付款|实付", t))
        done = any_of(t, ev.COMPLETED) or any(delivered.search(r) for r in rows)
        return "receipt" if status == "succeeded" or done and paid else own

    function = lambda t: ev.effective_role(F.lit(role).cast("string"), F.lit(status).cast("string"), t, F.lit(False))
    same(spark, function, scan, texts_of(11, STATE_PARTS, gaps=ROWS), 2 if role in ("order", "purchase") and status != "refunded" else 1)


def test_file_kinds(spark):
    rng = random.Random(12)
    heads = (b"%PDF-", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"RIFF", b"WEBP", b"\x00\x00\x00\x00", b"abcd", b"%PDF", b"")
    contents = [b"".join(rng.choice(heads) for _ in range(rng.randrange(4))) for _ in range(600)] + [b"RIFF1234WEBPmore"]

    def scan(c):
        starts = {".pdf": b"%PDF-", ".png": b"\x89PNG\r\n\x1a\n", ".jpg": b"\xff\xd8\xff"}
        return next((k for k, h in starts.items() if c[: len(h)] == h), ".webp" if c[:4] == b"RIFF" and c[8:12] == b"WEBP" else None)

    rows = spark.createDataFrame(list(enumerate(contents)), "i int, c binary")
    assert {r.i: r.k for r in rows.select("i", ev.file_kind(F.col("c")).alias("k")).collect()} == {i: scan(c) for i, c in enumerate(contents)}
