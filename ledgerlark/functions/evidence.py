"""Facts that expense evidence states in its text, and relations between two pieces of evidence, as columns.

Nothing is guessed: where a text says nothing, says several things or says something impossible, the result is null.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlark.functions.text import cents, compatibility_form, merchant_identity

# -- Fixed values: labels, markers and patterns whose wording decides results.
LOCAL_PREFIX = "^(南昌市|南昌)"
COMPANY_END = "(股份有限公司|有限责任公司|有限公司)$"
SHOP_END = "(股份有限公司|有限责任公司|有限公司|酒店|宾馆|旅馆|公寓|食堂|餐厅|餐饮店|快餐店|饭店|便利店|超市|小吃店|商店)$"
NO_COMPANY = "支付宝|微信支付|财付通|银联|中国铁路|银行"
NO_SHOP = "支付宝|微信|财付通|银联|银行|支付平台|酒店旅游|酒店住宿|住宿服务|餐饮服务|材料采购"
PLATFORM_NAMES = (
    "支付宝", "微信", "微信支付", "财付通", "银联", "支付平台", "携程", "携程旅行", "同程旅行", "飞猪", "去哪儿", "美团", "美团外卖",
    "淘宝", "淘宝闪购", "京东",
)
GENERIC_NAMES = ("酒店", "住宿", "餐饮", "其他", "携程旅行网")
VAGUE_CORES = ("餐饮", "酒店", "住宿", "快餐", "小吃", "便利", "旅游", "生活", "南昌", "南昌市")
TRIP_MARKERS = (
    "滴滴出行-行程单", "滴滴出行行程单", "DIDITRAVEL-TRIPTABLE", "CAOCAOTRAVEL-TRIPTABLE", "第三方网约车服务提供方曹操出行—行程单",
    "第三方网约车服务提供方曹操出行-行程单", "第三方网约车服务提供方上汽享道出行—行程单", "第三方网约车服务提供方上汽享道出行-行程单",
    "XIANGDAOTRAVEL-TRIPTABLE",
)
PROVIDERS = {"xiangdao": "享道出行|上汽享道|(?i:XIANGDAO)", "caocao": "曹操出行|吉利优行|(?i:CAOCAOTRAVEL)|(?i:GEELYRIDE)", "didi": "滴滴|(?i:DIDITRAVEL)"}
TRIP_COLUMNS = (("上车时间", "起点", "终点", "金额"), ("PICKUP", "DESTINATION", "AMOUNT"))
TRIP_HEADINGS = ("用车人手机号", "行程总计", "订单类型", "所在城市", "起点/终点", "可开票金额")
NUMBER = r"([0-9]+(?:\.[0-9]{1,2})?)"
TRIP_AMOUNTS = (rf"共(?:计)?\d+(?:笔|次|个|单)行程[，,;；。]?(?:合计|总计可开票金额)[¥￥]?{NUMBER}元?", rf"(?i)TRIPTOTAL[:：]?[¥￥]?{NUMBER}")
INVOICE_AMOUNTS = tuple(rf"{label}[¥￥]?{NUMBER}(?![0-9.])" for label in (r"\(小写\)", "(?i:TOTALWITHTAX)[:：]?", "价税合计[:：]?"))
TAX_CATEGORIES = {
    "住宿服务": "酒店", "铁路客运": "高铁", "铁路旅客运输服务": "高铁", "铁路客运服务": "高铁",
    **dict.fromkeys(("五金", "五金产品", "劳保用品", "劳动保护用品", "日用杂品", "文具", "文具用品", "电线电缆", "纸制品", "办公用品", "计算机外围设备", "计算机外部设备"), "材料采购"),
}
NO_GOODS = "安装|维修|租赁|人工|施工|服务费"
REFUND_CONTROL = r"^[\t ]*(?:可申请退款|申请退款|退款申请)[\t ]*[›>↗]?[\t ]*$"
STATE_LABELS = ("当前状态", "支付状态", "付款状态", "交易状态", "退款状态")
BAD_PAYMENT_STATES = ("failed", "refunded", "unpaid", "cancelled", "canceled")
BAD_PAYMENT_TEXT = (
    "已退款|退款成功|已全额退款|全额退回|已退回|已撤销|交易关闭|交易失败|支付失败|付款失败|已取消|等待对方收款|待对方收款|等待付款|未支付|未付款|待支付|待付款|转账中"
)
OPEN_PURCHASE = (
    "已退款|退款成功|退款完成|退款中|退款处理中|已申请退款|退款申请|已退回|已撤销|交易关闭|订单关闭|订单已关闭|交易失败|支付失败|付款失败|已取消|等待付款|未付款|未支付|"
    "待支付|待付款|转账中"
)
UNSENT_ROW = (
    r"^(?:(?:订单|配送|物流|当前)状态[:：]?)?(?:待配送|等待配送|待发货|等待发货|未发货|配送中|骑士正在配送|尚未送达|未送达|未签收|待取货|待收货)(?:[>＞，,。！!]|$)"
)
COMPLETED = "订单已送达|订单已完成|交易完成|交易成功|已付款|已支付|支付成功|付款成功"
DELIVERED_ROW = (
    r"^(?:(?:订单)?已(?:(?:提前|延迟)\d+(?:小时(?:\d+分(?:钟)?)?|分(?:钟)?))?送达|已送至(?:指定暂存点|(?:您的)?收货地址|指定地点)|配送已完成|(?:订单|包裹)?已签收)"
    r"(?:[>＞，,。！!]|$)"
)
PAID_TOTAL = r"(?:实付款|实付金额|实际付款|实付)[:：]?[¥￥]?\d+(?:\.\d{1,2})?"
RAIL_TEXT = r"铁路电子客票|铁路客运(?:服务)?|12306(?:电子)?(?:发票|车票|客票)"
TIME_LABELS = {
    "payment": {"支付时间": 0, "付款时间": 0, "扣款时间": 0, "交易时间": 1},
    "other": {"下单时间": 0, "订单创建时间": 0, "消费时间": 1, "支付时间": 2, "付款时间": 2, "交易时间": 2},
}
DATE_TIME = (
    r"(?<!\d)(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?[ T]?(\d{1,2})[:时](\d{2})(?:[:分](\d{2})(?:\.(\d{1,6}))?秒?)?(?![\d.:])((?i:Z|UTC|GMT|[+-]\d{2}:?\d{2})?)"
)
PLATE = "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Z][A-Z0-9]{5,6}"
PHOTO_DATE = r"(20\d{2})[.年/-](\d{1,2})[.月/-](\d{1,2})"
BEFORE_NAME, AFTER_NAME = r"(?:^|[，,、;/：:（(·|\-])", r"(?=$|[，,、;/：:）)·|\-]|住宿|房费|入住|预订|订单)"
FULL_QR_TYPES = ("31", "32")
MAX_FILE = 20 * 1024 * 1024
#: Where a text breaks into lines.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def rows_of(text: Column) -> Column:
    """The lines of a text."""
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK)


def filled(rows: Column) -> Column:
    return F.filter(rows, lambda r: squeezed(r) != "")


def _cjk(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def only(values: Column) -> Column:
    """The one distinct value of an array; null if none or several."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.get(values, F.lit(0)))


# -- parties


def company_identity(text: Column, amount: Column) -> Column:
    """A complete company name. A note of the invoiced amount after it has to equal ``amount`` (cents)."""
    flat = squeezed(text)
    noted = F.regexp_extract(flat, r"开票[¥￥]?(\d+(?:\.\d{1,2})?)元?$", 1)
    name = F.regexp_replace(flat, r"开票[¥￥]?\d+(?:\.\d{1,2})?元?$", "")
    core = F.regexp_replace(F.regexp_replace(name, COMPANY_END, ""), LOCAL_PREFIX, "")
    good = ((noted == "") | cents(noted).eqNullSafe(amount)) & has(name, COMPANY_END) & (_cjk(core) >= 4)
    return F.when(good & has(name, r"^[一-鿿A-Za-z0-9（）()·]+$") & ~has(name, NO_COMPANY), name)


def specific_merchant(text: Column, amount: Column) -> Column:
    """A seller or shop that is named, rather than a kind of goods or a channel of payment."""
    name = merchant_identity(text)
    company = company_identity(name, amount)
    shop = F.regexp_replace(name, r"[（(]个体工商户[）)]$", "")
    base = F.regexp_replace(shop, r"\([^()]{1,60}\)$", "")
    ending = F.regexp_extract(base, SHOP_END, 1)
    core = F.regexp_replace(base, SHOP_END, "")
    long_enough = ~ending.endswith("公司") | (_cjk(F.regexp_replace(core, LOCAL_PREFIX, "")) >= 4)
    good = (
        (_cjk(shop) >= 4) & (F.length(shop) <= 160) & has(shop, r"^[一-鿿A-Za-z0-9（）()·-]+$") & ~has(shop, NO_SHOP)
        & ~shop.isin(*PLATFORM_NAMES, *GENERIC_NAMES) & (ending != "") & (_cjk(core) >= 2) & long_enough & ~core.isin(*VAGUE_CORES)
    )
    return F.when(name.isin(*PLATFORM_NAMES), None).when(company.isNotNull(), company).when((shop == "中国铁路") | good, shop)


def same_company(left: Column, right: Column) -> Column:
    """Equal names, or equal but for the one local prefix that may be left out."""
    bare = lambda c: F.regexp_replace(c, LOCAL_PREFIX, "")
    shorter = F.regexp_replace(left, "^南昌", "") == right
    return F.coalesce((left != "") & (right != "") & ((left == right) | (has(left, LOCAL_PREFIX) & ((bare(left) == right) | shorter)) | (has(right, LOCAL_PREFIX) & ((bare(right) == left) | (F.regexp_replace(right, "^南昌", "") == left)))), F.lit(False))


def names_merchant(descriptions: Column, name: Column) -> Column:
    """Whether a description (of an array, in normal form) names the merchant (in normal form) as a part of its own."""

    def named(variant):
        pattern = F.concat(F.lit(BEFORE_NAME + r"\Q"), variant, F.lit(r"\E" + AFTER_NAME))
        return (F.length(variant) >= 4) & F.exists(descriptions, lambda d: F.regexp_like(d, pattern))

    variants = (name, F.regexp_replace(name, "^南昌市", ""), F.regexp_replace(name, "^南昌", ""))
    return F.coalesce((name != "") & reduce(lambda a, b: a | b, map(named, variants)), F.lit(False))


def merchant_relation(left: Column, right: Column) -> Column:
    """yes, no or unknown: whether two structs (shop, identity, descriptions) are of one merchant.

    Shops decide if both are known. Else equal identities or a description that names the other side say yes, two identities
    without such evidence no, and anything else is unknown.
    """
    known = lambda c: F.coalesce(c != "", F.lit(False))
    shops = F.when(same_company(left["shop"], right["shop"]), "yes").otherwise("no")
    one, two = F.coalesce(left["identity"], F.lit("")), F.coalesce(right["identity"], F.lit(""))
    named = same_company(one, two) | names_merchant(right["descriptions"], one) | names_merchant(left["descriptions"], two)
    return F.when(known(left["shop"]) & known(right["shop"]), shops).when(named, "yes").when(known(one) & known(two), "no").otherwise("unknown")


def transfer_recipient(text: Column) -> Column:
    """The company that a payment's text says the money was transferred to, in normal form; null if none."""
    return F.nullif(F.regexp_extract(compatibility_form(text), "转给([一-鿿A-Za-z0-9（）()·]+?(?:股份有限公司|有限责任公司|有限公司))", 1), F.lit(""))


def source_relation(left: Column, right: Column, relation: Column, *, conflict: Column | None = None, identity: Column | None = None, recipient: Column | None = None) -> Column:
    """Whether two arrays of identifiers (kind, namespace, value) or else ``merchant_relation`` tie two sources together.

    A name ``conflict`` of either side rules it out, as does a domain (kind, namespace) that both have with other values. An invoice's merchant
    ``identity`` and the ``recipient`` of a payment's transfer tie them too, if they are one company.
    """
    domain = lambda i: F.struct(i["kind"], i["namespace"])
    mine = lambda ids, d: F.array_sort(F.array_distinct(F.transform(F.filter(ids, lambda i: domain(i) == d), lambda i: i["value"])))
    shared = F.array_intersect(F.transform(left, domain), F.transform(right, domain))
    agree = F.forall(shared, lambda d: mine(left, d) == mine(right, d))
    tied = F.arrays_overlap(left, right) | (relation == "yes")
    if identity is not None and recipient is not None:
        tied = F.coalesce(tied, F.lit(False)) | same_company(merchant_identity(identity), merchant_identity(recipient))
    if conflict is not None:
        agree = agree & ~F.coalesce(conflict, F.lit(False))
    return F.coalesce(agree & tied, F.lit(False))


# -- kinds, amounts and dates


def provider(text: Column) -> Column:
    """The ride provider that a text names; ``unknown`` if none."""
    flat, out = compatibility_form(text), F.lit("unknown")
    for name, pattern in reversed(PROVIDERS.items()):
        out = F.when(has(flat, pattern), F.lit(name)).otherwise(out)
    return out


def document_kind(text: Column) -> Column:
    """trip or invoice, by markers or by the parts that such a document has; null otherwise."""
    flat = compatibility_form(text)
    upper = F.upper(flat)
    every = lambda c, parts: reduce(lambda a, b: a & b, [c.contains(p) for p in parts])
    chinese = has(flat, TRIP_AMOUNTS[0]) & every(flat, TRIP_COLUMNS[0]) & (flat.contains("行程单") | every(flat, TRIP_HEADINGS))
    english = every(upper, ("TRIPTABLE", "TRIPTOTAL", *TRIP_COLUMNS[1]))
    trip = reduce(lambda a, b: a | b, [flat.contains(m) for m in TRIP_MARKERS]) | chinese | english
    title = flat.contains("电子发票") | upper.contains("ELECTRONICINVOICE")
    fields = has(flat, "价税合计|发票号码") | has(upper, "INVOICENUMBER|TOTALWITHTAX")
    return F.when(trip, "trip").when(title & fields, "invoice")


def invoice_amount(text: Column) -> Column:
    """Cents of the total that all labelled rows of an invoice agree on. A label and its value have to share a row."""
    flat = compatibility_form(F.regexp_replace(text, LINE_BREAK, "␞"))  # a mark that no pattern spans
    found = F.flatten(F.array(*[F.regexp_extract_all(flat, F.lit(p), F.lit(1)) for p in INVOICE_AMOUNTS]))
    return only(F.transform(found, lambda n: F.round(n.cast("decimal(18,2)") * 100).cast("bigint")))


def trip_amount(text: Column) -> Column:
    """Cents of a trip table's total, by the first pattern that matches."""
    flat = compatibility_form(text)
    found = [F.nullif(F.regexp_extract(flat, p, 1), F.lit("")) for p in TRIP_AMOUNTS]
    return F.round(F.coalesce(*found).cast("decimal(18,2)") * 100).cast("bigint")


def label_values(text: Column, labels: tuple[str, ...]) -> Column:
    """Values of labelled rows: what follows the label in its row, or else the next row; without white space."""
    rows = F.transform(filled(rows_of(text)), squeezed)
    pattern = rf"^(?:{'|'.join(labels)})[:：]?(.*)$"

    def value(row, at):
        own = F.regexp_extract(row, pattern, 1)
        return F.when(row.rlike(pattern), F.when(own != "", own).otherwise(F.get(rows, at + 1)))

    return F.filter(F.transform(rows, value), lambda v: v.isNotNull() & (v != "") & (F.length(v) <= 160))


def transaction_time(text: Column, role: Column) -> Column:
    """A struct (value, precision, ambiguous) of the moment that the best label states; a time with a zone is not read."""
    rows = filled(F.transform(rows_of(nfkc(text)), lambda r: F.regexp_replace(r, r"(?U)^\s+|\s+$", "")))
    # Python functions can't be called within a lambda, so each row is paired with the next one first.
    pairs = F.zip_with(rows, F.slice(rows, F.lit(2), F.size(rows)), lambda row, after: F.struct(row.alias("row"), after.alias("after")))
    labels = list(dict.fromkeys([*TIME_LABELS["payment"], *TIME_LABELS["other"]]))
    pattern = rf"^({'|'.join(labels)})\s*[:：]?\s*(.*)$"
    priorities = [F.create_map(*[F.lit(x) for pair in TIME_LABELS[kind].items() for x in pair]) for kind in ("payment", "other")]

    def of_row(pair):
        label, own = (F.regexp_extract(pair["row"], pattern, i) for i in (1, 2))
        value = squeezed(F.when(own != "", own).otherwise(F.coalesce(pair["after"], F.lit(""))))
        priority = F.when(role == "payment", F.try_element_at(priorities[0], label)).otherwise(F.try_element_at(priorities[1], label))
        return F.transform(F.regexp_extract_all(value, F.lit(DATE_TIME), F.lit(0)), lambda m: _moment(m, priority))

    found = F.filter(F.flatten(F.transform(pairs, of_row)), lambda m: m["stamp"].isNotNull() & m["priority"].isNotNull())
    best = _let(found, lambda all_: _let(F.array_min(F.transform(all_, lambda m: m["priority"])), lambda p: F.filter(all_, lambda m: m["priority"] == p)))
    return _let(best, _unique_moment)


def _let(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is computed and written once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unique_moment(best: Column) -> Column:
    stamps = F.array_distinct(F.transform(best, lambda m: m["stamp"]))
    last = F.try_element_at(best, F.lit(-1))
    one = F.size(stamps) == 1
    return F.struct(F.when(one, last["stamp"]).alias("value"), F.when(one, last["precision"]).alias("precision"), (F.size(stamps) > 1).alias("ambiguous"))


def _moment(match: Column, priority: Column) -> Column:
    part = lambda i: F.regexp_extract(match, DATE_TIME, i)
    two = lambda i: F.lpad(part(i), 2, "0")
    day = F.concat_ws("-", part(1), two(2), two(3))
    clock = F.concat(two(4), F.lit(":"), part(5), F.lit(":"), F.lpad(part(6), 2, "0"), F.lit("."), F.rpad(part(7), 6, "0"))
    precision = F.when(part(7) != "", "fraction").when(part(6) != "", "second").otherwise("minute")
    stamp = F.when(part(8) == "", F.concat_ws(" ", day, clock).try_cast("timestamp_ntz"))
    return F.struct(priority.alias("priority"), stamp.alias("stamp"), precision.alias("precision"))


def tax_category(text: Column) -> Column:
    """The category of ``*class*name`` rows: all classes have to be known and of one category; goods that are work abstain."""
    rows = F.transform(rows_of(nfkc(text)), lambda r: F.regexp_replace(r, r"(?U)^\s+|\s+$", ""))
    pattern = r"^\*([^*\n]{1,50})\*([^*]*)$"
    rows = F.filter(rows, lambda r: r.rlike(pattern))
    known = F.create_map(*[F.lit(x) for pair in TAX_CATEGORIES.items() for x in pair])
    found = F.transform(rows, lambda r: F.coalesce(F.try_element_at(known, squeezed(F.regexp_extract(r, pattern, 1))), F.lit("")))
    category = F.nullif(only(found), F.lit(""))
    work = F.exists(rows, lambda r: F.regexp_extract(r, pattern, 2).rlike(NO_GOODS))
    return F.when(~((category == "材料采购") & work), category)


# -- states and roles


def payment_state_text(text: Column) -> Column:
    """The text without lines that only offer a refund, unless a label of a state comes before."""
    none = F.struct(F.lit("").alias("label"), F.array().cast("array<string>").alias("rows"))

    def step(acc, row):
        flat = F.regexp_replace(squeezed(row), "[:：]+$", "")
        control = row.rlike(REFUND_CONTROL) & ~acc["label"].isin(*STATE_LABELS)
        label = F.when(flat != "", flat).otherwise(acc["label"])
        return F.struct(label.alias("label"), F.array_append(acc["rows"], F.when(control, F.lit("")).otherwise(row)).alias("rows"))

    return F.array_join(F.aggregate(rows_of(text), none, step, lambda acc: acc["rows"]), "\n")


def payment_ineligible(status: Column, text: Column) -> Column:
    """Whether a payment has failed, was refunded or isn't done, by its state or its text."""
    return F.coalesce(status.isin(*BAD_PAYMENT_STATES), F.lit(False)) | has(squeezed(text), BAD_PAYMENT_TEXT)


def effective_role(role: Column, status: Column, text: Column, by_hand: Column) -> Column:
    """receipt for an order or purchase that is complete and paid, or paid by its state; else the role itself."""
    role = F.coalesce(F.nullif(role, F.lit("")), F.lit("other"))
    status = F.coalesce(status, F.lit(""))
    source = payment_state_text(text)
    flat, rows = squeezed(source), F.transform(rows_of(source), squeezed)
    open_ = ~status.isin("", "succeeded", "unknown", "uncertain") | has(flat, OPEN_PURCHASE) | F.exists(rows, lambda r: r.rlike(UNSENT_ROW))
    complete = (has(flat, COMPLETED) | F.exists(rows, lambda r: r.rlike(DELIVERED_ROW))) & has(flat, PAID_TOTAL)
    promoted = role.isin("order", "purchase") & ~by_hand & ~open_ & ((status == "succeeded") | complete)
    return F.when(promoted, "receipt").otherwise(role)


def rail_invoice(role: Column, category: Column, text: Column) -> Column:
    """Whether an invoice is one of a railway, which never looks for a payment."""
    return F.coalesce(role == "invoice", F.lit(False)) & (F.coalesce(category == "高铁", F.lit(False)) | has(text, RAIL_TEXT))


def compare_code(code: Column, fields: Column) -> Column:
    """match, partial, mismatch or unreadable: a tax code's struct (type, invoice_number, amount, issue_date) against read fields.

    A field that wasn't read isn't compared, nor is an amount that differs where the code's type doesn't hold the full one.
    """
    states = []
    for name in ("invoice_number", "amount", "issue_date"):
        read, told = fields[name], code[name]
        same = cents(read).eqNullSafe(cents(told)) if name == "amount" else F.trim(read) == told
        loose = F.lit(name == "amount") & ~code["type"].isin(*FULL_QR_TYPES)
        states.append(F.when(F.coalesce(read, F.lit("")) == "", "open").when(same, "same").when(loose, "open").otherwise("other"))
    states = F.array(*states)
    return F.when(code.isNull(), "unreadable").when(F.array_contains(states, "other"), "mismatch").when(F.array_contains(states, "open"), "partial").otherwise("match")


def compare_company(names: Column, tax_hashes: Column, name: Column, tax_hash: Column) -> Column:
    """A struct (status, mismatches): a buyer's read name and hash of its tax number against a profile's arrays of them, in normal form.

    match if all that the profile has was read and fits, partial if only some was read, mismatch if something doesn't fit, unreadable if nothing
    was read; null without a profile.
    """
    flat = F.upper(F.coalesce(compatibility_form(name), F.lit("")))
    given = F.coalesce(tax_hash, F.lit(""))
    has_names, has_hashes = F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, F.size(F.coalesce(tax_hashes, F.array().cast("array<string>"))) > 0
    bad = F.array_compact(F.array(
        F.when((flat != "") & has_names & ~F.array_contains(names, flat), "name"), F.when((given != "") & has_hashes & ~F.array_contains(tax_hashes, given), "tax_id")
    ))
    whole = (~has_names | (flat != "")) & (~has_hashes | (given != ""))
    status = F.when(F.size(bad) > 0, "mismatch").when((flat == "") & (given == ""), "unreadable").when(whole, "match").otherwise("partial")
    return F.when(has_names | has_hashes, F.struct(status.alias("status"), bad.alias("mismatches")))


def confirm_amounts(amount: Column, face: Column, stored: Column, parts: Column, reason: Column) -> Column:
    """Why a confirmation of an expense's amounts (cents) is refused; null if it is accepted.

    Parts, 50 at most, have to add to the amount; another amount than the face or the stored one needs a reason.
    """
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    changed = (amount != face) | (amount != stored)
    return (
        F.when(F.size(parts) > 50, "parts").when((F.size(parts) > 0) & (total != amount), "sum")
        .when(changed & (F.trim(F.coalesce(reason, F.lit(""))) == ""), "reason").when(F.length(F.trim(reason)) > 2000, "length")
    )


# -- photos, reports and files


def photo_hints(text: Column) -> Column:
    """A struct (captured_date, captured_time, plate, location) of what a photo's watermark states once."""
    flat = squeezed(text)
    day = lambda m: F.concat_ws("-", F.regexp_extract(m, PHOTO_DATE, 1), *[F.lpad(F.regexp_extract(m, PHOTO_DATE, i), 2, "0") for i in (2, 3)]).try_cast("date")
    days = F.filter(F.transform(F.regexp_extract_all(flat, F.lit(PHOTO_DATE), F.lit(0)), day), lambda d: d.isNotNull())
    hour, minute = (F.regexp_extract(flat, r"(?:拍摄时间|时间).*?(\d{1,2})[:：](\d{2})", i) for i in (1, 2))
    clock = F.when((hour.try_cast("int") < 24) & (minute.try_cast("int") < 60), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))
    plates = F.regexp_extract_all(F.regexp_replace(F.upper(flat), "[·•]", ""), F.lit(PLATE), F.lit(0))
    place = F.substr(F.nullif(F.regexp_extract(flat, "地点[:：](.*?)(?:今日水印|防伪|验真|$)", 1), F.lit("")), F.lit(1), F.lit(160))
    return F.struct(only(days).alias("captured_date"), clock.alias("captured_time"), only(plates).alias("plate"), place.alias("location"))


def number_text(value: Column) -> Column:
    """A number with two decimals at most, half to even, and without trailing zeros."""
    text = F.bround(value.cast("decimal(20,6)"), 2).cast("decimal(20,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def day_text(day: Column) -> Column:
    """A day of the month in Chinese numerals."""
    digit = lambda n: F.substr(F.lit("零一二三四五六七八九"), n + 1, F.lit(1))
    tens, ones = F.floor(day / 10).cast("int"), (day % 10).cast("int")
    long = F.concat(F.when(day >= 20, digit(tens)).otherwise(F.lit("")), F.lit("十"), F.when(ones > 0, digit(ones)).otherwise(F.lit("")))
    return F.when(day < 10, digit(ones)).otherwise(long)


def file_kind(content: Column) -> Column:
    """The kind of a file by its first bytes; null if it is empty, larger than MAX_FILE or of another kind."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.when(head.startswith("255044462D"), ".pdf").when(head.startswith("89504E470D0A1A0A"), ".png").when(head.startswith("FFD8FF"), ".jpg")
    kind = kind.when(head.rlike("^52494646.{8}57454250"), ".webp")
    return F.when((F.octet_length(content) > 0) & (F.octet_length(content) <= MAX_FILE), kind)


def match_reasons(order: Column, merchant: Column, amount: Column, text: Column) -> Column:
    """Why a text may be about an expense, in this order: ``order``, ``merchant``, ``amount``; an empty array if nothing speaks for it.

    Spaces of the text don't count. The order number and the amount mustn't be part of a longer number, a merchant has three characters
    or more. Null or empty values are no reason, and a null text gives none.
    """
    blank = r"(?U)[\s\x1C-\x1F]+"
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), blank, "")
    number = F.regexp_replace(order, rf"^{blank}|{blank}$", "")
    name = F.regexp_replace(merchant, blank, "")
    digit = r"\p{Nd}"
    return F.array_compact(F.array(
        F.when((number != "") & F.regexp_like(flat, F.concat(F.lit(f"(?<!{digit})"), quoted(number), F.lit(f"(?!{digit})"))), "order"),
        F.when((F.char_length(name) >= 3) & F.contains(flat, name), "merchant"),
        F.when((amount != "") & F.regexp_like(flat, F.concat(F.lit(f"(?<![{digit}.])"), quoted(amount), F.lit(f"(?!{digit})"))), "amount"),
    ))
