"""Queries of what evidence states and of how it belongs together.

The driver's tables hold no evidence texts, so each query writes some from an order's or customer's columns, with one SQL expression for
both engines, and reads them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark import adapters
from ledgerlark.functions import evidence as ev
from ledgerlark.operators import evidence as joins
from ledgerlark.operators import rules
from ledgerlark.plans.core import register
from ledgerlark.session import table

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
MONEY = f"CAST(CAST({CENTS} AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))"
WHOLE = f"CAST({MONEY} AS STRING)"


def orders(spark, sf_dir, **texts):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[F.expr(t).alias(n) for n, t in texts.items()])


KIND_TEXT = f"""CASE o_orderkey % 8 WHEN 0 THEN '滴滴 出行-行程单 ' || {WHOLE} WHEN 1 THEN '电子发票 发票号码: 12345678' WHEN 2 THEN 'Electronic Invoice Total With Tax 5'
    WHEN 3 THEN '行程单 上车时间 起点 终点 金额 共2笔行程，合计' || {WHOLE} || '元 曹操出行' WHEN 4 THEN 'Trip Table Trip Total 8 pickup destination amount XIANGDAO'
    WHEN 5 THEN '上车时间 起点 终点 共2笔行程，合计3元 行程单' WHEN 6 THEN '电子发票' ELSE o_orderstatus END"""


@register(
    "document_kind",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 IN (0, 3, 4) THEN 'trip' WHEN o_orderkey % 8 IN (1, 2) THEN 'invoice' END AS kind,
    CASE o_orderkey % 8 WHEN 0 THEN 'didi' WHEN 3 THEN 'caocao' WHEN 4 THEN 'xiangdao' ELSE 'unknown' END AS provider FROM orders""",
)
def document_kind(spark, sf_dir):
    rows = orders(spark, sf_dir, text=KIND_TEXT)
    return rows.select("id", ev.document_kind(F.col("text")).alias("kind"), ev.provider(F.col("text")).alias("provider"))


AMOUNT_TEXT = f"""CASE o_orderkey % 6 WHEN 0 THEN '价税合计（小写） ¥' || {WHOLE} WHEN 1 THEN '价税合计' || chr(10) || '（小写）' || {WHOLE} || chr(10) || 'Total With Tax: ' || {WHOLE}
    WHEN 2 THEN '(小写)1.00' || chr(10) || '价税合计:' || {WHOLE} WHEN 3 THEN '价税合计' || chr(10) || {WHOLE} WHEN 4 THEN '共3笔行程，合计' || {WHOLE} || '元' ELSE 'Trip Total ¥' || {WHOLE} END"""


@register(
    "amount_in_text",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 IN (0, 1) OR (o_orderkey % 6 = 2 AND {CENTS} = 100) THEN {CENTS} END AS invoice_cents,
    CASE WHEN o_orderkey % 6 > 3 THEN {CENTS} END AS trip_cents FROM orders""",
)
def amount_in_text(spark, sf_dir):
    rows = orders(spark, sf_dir, text=AMOUNT_TEXT)
    return rows.select("id", ev.invoice_amount(F.col("text")).alias("invoice_cents"), ev.trip_amount(F.col("text")).alias("trip_cents"))


TAX_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN '*住宿服务*房费' WHEN 1 THEN ' *文具* 笔 ' || chr(10) || '*五金*螺丝' WHEN 2 THEN '*五金*安装 费' WHEN 3 THEN '*住宿服务*房' || chr(10) || '*文具*笔'
    WHEN 4 THEN '*餐饮服务*午餐' WHEN 5 THEN '*铁路 客运*票' ELSE 'x *住宿服务*房费' END"""


@register(
    "tax_category",
    """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN '酒店' WHEN 1 THEN '材料采购' WHEN 5 THEN '高铁' END AS category FROM orders""",
)
def tax_category(spark, sf_dir):
    return orders(spark, sf_dir, text=TAX_TEXT).select("id", ev.tax_category(F.col("text")).alias("category"))


LABEL_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN '商品说明： 会议 ' || o_custkey || chr(10) || '备注' || chr(10) || chr(10) || ' 客户 ' || o_orderkey WHEN 1 THEN '商品说明' || o_custkey
    WHEN 2 THEN '其他: 1' || chr(10) || '备注' ELSE '说明: 商品说明' END"""


@register(
    "labelled_values",
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '会议' || o_custkey || '|客户' || o_orderkey WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS found FROM orders""",
)
def labelled_values(spark, sf_dir):
    return orders(spark, sf_dir, text=LABEL_TEXT).select("id", F.array_join(ev.label_values(F.col("text"), ("商品说明", "备注")), "|").alias("found"))


@register(
    "transaction_time",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN o_orderdate END AS moment,
    CASE o_orderkey % 5 WHEN 0 THEN 'second' WHEN 1 THEN 'minute' WHEN 4 THEN 'second' END AS precision, o_orderkey % 5 = 2 AS ambiguous FROM orders""",
)
def transaction_time(spark, sf_dir):
    at, day = F.col("o_orderkey") % 5, lambda pattern: F.date_format("o_orderdate", pattern)
    text = (
        F.when(at == 0, F.concat(F.lit("交易时间：2001-02-03 04:05\n支付时间 "), day("yyyy年M月d日 HH:mm:ss"))).when(at == 1, F.concat(F.lit("付款时间\n"), day("yyyy/MM/dd HH:mm")))
        .when(at == 2, F.concat(F.lit("支付时间:"), day("yyyy-MM-dd HH:mm"), F.lit("\n扣款时间: 2001-02-03 04:05")))
        .when(at == 3, F.concat(F.lit("支付时间:"), day("yyyy-MM-dd HH:mm:ss"), F.lit("+08:00\n时间: "), day("yyyy-MM-dd HH:mm"))).otherwise(F.concat(F.lit("支付时间:2001-02-30 04:05\n交易时间:"), day("yyyy-MM-dd HH:mm:ss")))
    )
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ev.transaction_time(text, F.lit("payment")).alias("t"))
    return found.select("id", F.col("t.value").alias("moment"), F.col("t.precision").alias("precision"), F.col("t.ambiguous").alias("ambiguous"))


STATE_TEXT = """CASE o_orderkey % 9 WHEN 0 THEN '订单已完成' || chr(10) || '实付款：¥' || o_custkey WHEN 1 THEN '交易成功' || chr(10) || '申请退款 >' || chr(10) || '实付 5' WHEN 2 THEN '当前状态' || chr(10) || '退款申请' || chr(10) || '实付5 已付款'
    WHEN 3 THEN '已退款' WHEN 4 THEN '订单状态：待发货' || chr(10) || '已付款 实付 8' WHEN 5 THEN '已提前12分钟送达 > ' || chr(10) || '实付金额 9.50' WHEN 6 THEN '支付成功' WHEN 7 THEN '铁路电子客票' ELSE '等待对方收款' END"""
STATE = "CASE WHEN o_orderkey % 11 = 0 THEN 'succeeded' WHEN o_orderkey % 11 = 1 THEN 'refunded' WHEN o_orderkey % 11 = 2 THEN 'unknown' END"
ROLE = "CASE o_orderkey % 5 WHEN 0 THEN 'order' WHEN 1 THEN 'purchase' WHEN 2 THEN 'payment' WHEN 3 THEN 'invoice' END"


@register(
    "evidence_roles",
    f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 9 AS k, o_orderkey % 11 AS s, {ROLE} AS role FROM orders)
    SELECT id, CASE WHEN role IN ('order', 'purchase') AND id % 13 <> 0 AND s <> 1 AND k NOT IN (2, 3, 4) AND (s = 0 OR k IN (0, 1, 5)) THEN 'receipt' ELSE coalesce(role, 'other') END AS role,
    s = 1 OR k IN (3, 8) AS ineligible, coalesce(role = 'invoice', false) AND k = 7 AS rail FROM o""",
)
def evidence_roles(spark, sf_dir):
    rows = orders(spark, sf_dir, text=STATE_TEXT, status=STATE, role=ROLE)
    text, role = F.col("text"), F.col("role")
    return rows.select(
        "id", ev.effective_role(role, F.col("status"), text, F.col("id") % 13 == 0).alias("role"),
        ev.payment_ineligible(F.col("status"), text).alias("ineligible"), ev.rail_invoice(role, F.lit(None), text).alias("rail"),
    )


@register(
    "tax_code_check",
    f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, o_orderkey % 2 = 0 AS total FROM orders)
    SELECT id, CASE k WHEN 0 THEN 'unreadable' WHEN 1 THEN 'match' WHEN 2 THEN CASE WHEN total THEN 'mismatch' ELSE 'partial' END WHEN 3 THEN 'partial' WHEN 4 THEN 'mismatch' ELSE 'match' END AS status FROM o""",
)
def tax_code_check(spark, sf_dir):
    at, number, day = F.col("o_orderkey") % 7, F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.date_format("o_orderdate", "yyyy-MM-dd")
    amount = F.expr(WHOLE)
    kind = F.when(F.col("o_orderkey") % 2 == 0, "31").otherwise("01")
    code = F.when(at > 0, F.struct(kind.alias("type"), number.alias("invoice_number"), amount.alias("amount"), day.alias("issue_date")))
    read = F.struct(
        F.when(at == 4, F.concat(number, F.lit("9"))).otherwise(F.concat(F.lit(" "), number)).alias("invoice_number"),
        F.when(at == 2, "0.01").otherwise(amount).alias("amount"), F.when(at == 3, "").otherwise(day).alias("issue_date"),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ev.compare_code(code, read).alias("status"))


@register(
    "confirm_amounts",
    f"""WITH {"e AS (" + adapters.EXPENSE_SQL + ")"}, l AS (SELECT pool, sum(cents) AS total, count(*) AS n FROM ({adapters.MATERIAL_SQL}) GROUP BY pool)
    SELECT id, CASE WHEN n > 50 THEN 'parts' WHEN total <> CASE WHEN id % 3 = 0 THEN cents ELSE total END THEN 'sum'
        WHEN CASE WHEN id % 3 = 0 THEN cents ELSE total END <> cents AND id % 2 = 0 THEN 'reason' END AS refused FROM e JOIN l ON id = pool""",
)
def confirm_amounts(spark, sf_dir):
    parts = adapters.material(spark, sf_dir).groupBy(F.col("pool").alias("id")).agg(F.collect_list("cents").alias("parts"), F.sum("cents").alias("total"))
    rows = adapters.expense(spark, sf_dir).join(parts, "id")
    amount = F.when(F.col("id") % 3 == 0, F.col("cents")).otherwise(F.col("total"))
    reason = F.when(F.col("id") % 2 == 0, " ").otherwise("changed")
    return rows.select("id", ev.confirm_amounts(amount, F.col("cents"), F.col("cents"), F.col("parts"), reason).alias("refused"))


@register(
    "photo_hints",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 IN (0, 3) THEN CAST(o_orderdate + INTERVAL 120 MONTH AS DATE) END AS captured_date, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%H:%M') WHEN o_orderkey % 4 = 1 THEN NULL END AS captured_time,
    CASE WHEN o_orderkey % 4 IN (0, 1) THEN '京A' || lpad(CAST(o_custkey % 99999 AS VARCHAR), 5, '0') END AS plate, CASE o_orderkey % 4 WHEN 0 THEN '会展中心' WHEN 2 THEN '门口' END AS location FROM orders""",
)
def photo_hints(spark, sf_dir):
    at, shown = F.col("o_orderkey") % 4, F.date_format(F.add_months("o_orderdate", 120), "yyyy.M.d")
    plate = F.lpad((F.col("o_custkey") % 99999).cast("string"), 5, "0")
    text = (
        F.when(at == 0, F.concat(shown, F.lit(" 拍摄时间: "), F.date_format("o_orderdate", "H:mm"), F.lit(" 京A·"), plate, F.lit(" 地点：会展中心 今日水印")))
        .when(at == 1, F.concat(F.lit("2020-1-1,2020年1月2日 时间 99:99 京a"), plate)).when(at == 2, F.lit("京A11111 沪B22222 地点:门口\n防伪")).otherwise(F.concat(F.lit("2021-13-40,"), shown))
    )
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ev.photo_hints(text).alias("h"))
    return found.select("id", "h.*")


@register(
    "report_numbers",
    f"""SELECT o_orderkey AS id, regexp_replace(regexp_replace(CAST({MONEY} AS VARCHAR), '0+$', ''), '\\.$', '') AS number,
    CASE WHEN day(o_orderdate) >= 20 THEN ['二', '三'][day(o_orderdate) // 10 - 1] ELSE '' END || CASE WHEN day(o_orderdate) >= 10 THEN '十' ELSE '' END
      || CASE WHEN day(o_orderdate) % 10 > 0 THEN ['一', '二', '三', '四', '五', '六', '七', '八', '九'][day(o_orderdate) % 10] ELSE '' END AS day FROM orders""",
)
def report_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), ev.number_text(F.expr(MONEY)).alias("number"), ev.day_text(F.dayofmonth("o_orderdate")).alias("day")
    )


@register(
    "file_kinds",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg' WHEN 3 THEN '.webp' END AS kind FROM documents""",
)
def file_kinds(spark, sf_dir):
    at, rest = F.col("doc_id") % 6, F.coalesce(F.col("text"), F.lit("")).cast("binary")
    head = F.when(at == 0, F.unhex(F.lit("255044462D"))).when(at == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(at == 2, F.unhex(F.lit("FFD8FF"))).when(at == 3, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.unhex(F.lit("00")))
    return table(spark, sf_dir, "documents").select("doc_id", ev.file_kind(F.concat(head, rest)).alias("kind"))


COMPANY = "(CASE WHEN c_custkey % 3 = 0 THEN '南昌市' ELSE '' END || '云帆商贸' || (c_custkey % 40) || '有限公司')"


@register(
    "named_merchants",
    f"""WITH c AS (SELECT *, {COMPANY} AS company, CAST(c_custkey AS BIGINT) * 100 AS cents FROM customer)
    SELECT c_custkey AS id, CASE WHEN c_custkey % 6 IN (0, 1) THEN company END AS company,
    CASE c_custkey % 6 WHEN 0 THEN company WHEN 1 THEN company WHEN 3 THEN '赣江之星酒店' WHEN 5 THEN '赣江饭店(' || c_custkey || '店)' END AS merchant FROM c""",
)
def named_merchants(spark, sf_dir):
    text = f"""CASE c_custkey % 6 WHEN 0 THEN ' ' || {COMPANY} WHEN 1 THEN {COMPANY} || '开票¥' || c_custkey || '元' WHEN 2 THEN {COMPANY} || '开票1.5元' WHEN 3 THEN '赣江之星酒店（个体工商户）'
        WHEN 4 THEN '美团外卖' ELSE '赣江饭店（' || c_custkey || '店）' END"""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(text).alias("text"), (F.col("c_custkey") * 100).alias("cents"))
    return rows.select("id", ev.company_identity(F.col("text"), F.col("cents")).alias("company"), ev.specific_merchant(F.col("text"), F.col("cents")).alias("merchant"))


RELATION_SQL = f"""o AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, c_custkey, {COMPANY} AS company FROM orders JOIN customer ON o_custkey = c_custkey)"""


@register(
    "merchant_relations",
    f"""WITH {RELATION_SQL}, r AS (SELECT id, k, CASE WHEN k = 0 THEN 'yes' WHEN k = 1 THEN 'no' WHEN k = 2 THEN 'yes' WHEN k = 3 THEN 'yes' WHEN k = 4 THEN 'no' WHEN k = 5 THEN 'yes' ELSE 'unknown' END AS relation FROM o)
    SELECT id, relation, k < 7 AND NOT (k = 6 AND id % 3 > 0) AND (relation = 'yes' OR k = 6) AS same_source FROM r""",
)
def merchant_relations(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = both.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 8).alias("k"), F.expr(COMPANY).alias("company"))
    k, name, no = F.col("k"), F.col("company"), F.array().cast("array<string>")
    bare = F.regexp_replace(name, "^南昌市", "")
    left = F.struct(F.when(k < 2, name).alias("shop"), F.when(k.isin(2, 3, 4, 5), name).alias("identity"), no.alias("descriptions"))
    right = F.struct(
        F.when(k == 0, bare).when(k == 1, "别家").alias("shop"), F.when(k == 2, bare).when(k == 4, "别处").alias("identity"),
        F.when(k == 3, F.array(F.concat(F.lit("九月,"), bare, F.lit("住宿")))).when(k == 5, F.array(F.concat(name, F.lit("·订单")))).otherwise(no).alias("descriptions"),
    )
    one = lambda value: F.array(F.struct(F.lit("payment_order").alias("kind"), F.lit("x").alias("namespace"), value.alias("value")))
    none = F.array().cast("array<struct<kind:string,namespace:string,value:string>>")
    ids = F.when(k == 6, one(F.lit("a1"))).otherwise(none), F.when(k == 6, one(F.when(F.col("id") % 3 > 0, "b2").otherwise("a1"))).otherwise(none)
    relation = ev.merchant_relation(left, right)
    return rows.select("id", relation.alias("relation"), ev.source_relation(*ids, relation).alias("same_source"))


@register(
    "ride_pairs",
    f"""WITH t AS (SELECT o_orderkey AS trip, {CENTS} // 100000 AS cents, o_custkey % 3 AS provider, o_custkey AS src, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS ended FROM orders WHERE o_orderstatus = 'O'),
    i AS (SELECT o_orderkey AS invoice, {CENTS} // 100000 AS cents, o_custkey % 3 AS provider, o_custkey AS src, CAST(o_orderdate AS DATE) AS dated FROM orders WHERE o_orderstatus = 'F'),
    p AS (SELECT trip, invoice FROM t JOIN i USING (provider, cents, src) WHERE coalesce(ended <= dated, true)),
    n AS (SELECT *, count(*) OVER (PARTITION BY trip) AS a, count(*) OVER (PARTITION BY invoice) AS b FROM p) SELECT trip, invoice FROM n WHERE a = 1 AND b = 1""",
)
def ride_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr(f"{CENTS} div 100000").alias("cents"), (F.col("o_custkey") % 3).alias("provider"), F.array("o_custkey").alias("sources"),
        F.col("o_orderdate").cast("date").alias("dated"), "o_orderstatus",
    )
    trips = rows.filter("o_orderstatus = 'O'").withColumn("ended", F.when(F.col("id") % 5 > 0, F.col("dated")))
    return joins.ride_pairs(trips, rows.filter("o_orderstatus = 'F'"))


@register(
    "render_pairs",
    """WITH d AS (SELECT o_orderkey AS id, o_custkey AS batch, o_orderstatus AS source, 'f' || (o_orderkey % 4) AS stem, o_orderkey % 5 AS number, o_orderkey % 7 = 0 AS conflict, o_orderkey % 2 = 0 AS image FROM orders),
    p AS (SELECT DISTINCT a.id AS image, b.id AS document FROM d a JOIN d b ON a.batch = b.batch AND a.source = b.source WHERE a.image AND NOT b.image AND NOT a.conflict AND NOT b.conflict
      AND NOT (a.number > 0 AND b.number > 0 AND a.number <> b.number) AND (a.stem = 'f' || ((b.id + 1) % 4) OR (a.number > 0 AND a.number = b.number))),
    n AS (SELECT *, count(*) OVER (PARTITION BY image) AS n FROM p) SELECT image, document FROM n WHERE n = 1""",
)
def render_pairs(spark, sf_dir):
    id_ = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        id_.alias("id"), F.col("o_custkey").alias("batch"), F.col("o_orderstatus").alias("source"), F.lit("").alias("project"),
        F.concat(F.lit("f"), F.when(id_ % 2 == 0, id_ % 4).otherwise((id_ + 1) % 4)).alias("stem"), F.when(id_ % 5 > 0, (id_ % 5).cast("string")).otherwise("").alias("number"), (id_ % 7 == 0).alias("conflict"),
    )
    documents = rows.filter("id % 2 = 1").withColumn("name", F.concat("stem", F.lit(".pdf")))
    return joins.render_pairs(rows.filter("id % 2 = 0"), documents)


@register(
    "project_views",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'P' || c_custkey ELSE c_name END AS name, coalesce(c_custkey % 3 = 1 AND c_custkey % 2 = 1, false) AS pinned,
    CAST(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 10 ELSE 0 END AS BIGINT) AS project_revision, CASE WHEN c_custkey % 4 = 0 THEN 'reimbursed' ELSE 'unreimbursed' END AS reimbursement_status,
    CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS reimbursement_revision FROM customer WHERE NOT (c_custkey % 3 > 0 AND c_custkey % 5 = 0)""",
)
def project_views(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    metadata = customer.filter(key % 3 > 0).select(
        key.alias("project_id"), F.when(key % 3 == 1, F.concat(F.lit("P"), key)).otherwise("").alias("display_name"), ((key % 3 == 1) & (key % 2 == 1)).alias("pinned"),
        (key % 10).alias("revision"), (key % 5 == 0).alias("permanently_deleted"),
    )
    labels = customer.filter(key % 4 == 0).select(key.alias("project_id"), F.lit("reimbursed").alias("status"), F.lit(1).cast("bigint").alias("revision"))
    return joins.project_views(customer.select(key.alias("id"), F.col("c_name").alias("name")), metadata, labels)


@register(
    "attempts_with_expense",
    f"""WITH e AS ({adapters.EXPENSE_SQL}) SELECT event_id AS attempt, event_id * 3 AS item_id, stage, cents FROM events LEFT JOIN e ON e.id = event_id * 3""",
)
def attempts_with_expense(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select(F.col("event_id").alias("attempt"), (F.col("event_id") * 3).alias("item_id"))
    return joins.with_expense(attempts, adapters.expense(spark, sf_dir).select("id", "stage", "cents")).select("attempt", "item_id", "stage", "cents")


@register(
    "rows_of_active_projects",
    f"""WITH e AS ({adapters.EXPENSE_SQL}) SELECT id, project FROM e JOIN nation ON n_nationkey = project WHERE n_regionkey <> 1 AND n_nationkey % 4 > 0""",
)
def rows_of_active_projects(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    projects = nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 1, "archived").otherwise("active").alias("status"), (F.col("n_nationkey") % 4 == 0).alias("paused"))
    return joins.of_active_projects(adapters.expense(spark, sf_dir).select("id", "project"), projects)


@register(
    "returned_materials",
    """WITH ev AS (SELECT user_id AS id, arg_max(event_type, event_id) AS message FROM events GROUP BY 1),
    g AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderdate, o_orderkey) AS undone_at FROM orders GROUP BY 1)
    SELECT c.c_custkey AS id, c_custkey % 50 = 0 OR (c_acctbal > 0 AND coalesce(message IN ('click', 'view'), false) AND coalesce(status = 'F', false)
      AND NOT coalesce(TIMESTAMP '1997-01-01' > undone_at, false)) AS is_returned FROM customer c LEFT JOIN ev ON ev.id = c_custkey LEFT JOIN g ON g.id = c_custkey""",
)
def returned_materials(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50 == 0).alias("returned"), (F.col("c_acctbal") > 0).alias("open"), F.lit("1997-01-01").cast("timestamp_ntz").alias("updated_at")
    )
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("id"), F.col("event_type").alias("message"))
    status = F.when(F.col("o_orderstatus") == "F", "undone").otherwise("active").alias("status")
    groups = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("id"), status, F.col("o_orderdate").alias("undone_at"))
    return joins.returned_materials(items, events, groups, ("click", "view")).select("id", "is_returned")


@register(
    "cleanup_candidates",
    """SELECT page_id, url AS path FROM pages WHERE TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 20 AS INTEGER)) <= TIMESTAMP '2024-01-13'""",
)
def cleanup_candidates(spark, sf_dir):
    import datetime

    changed = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval((F.col("page_id") % 20).cast("int"))
    folders = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), changed.alias("changed"))
    return joins.cleanup_candidates(folders, datetime.datetime(2024, 1, 20)).select("page_id", "path")


@register(
    "union_by_identity",
    """WITH a AS (SELECT DISTINCT o_custkey AS id, 'orders' AS origin FROM orders), b AS (SELECT c_custkey AS id, 'customer' AS origin FROM customer)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)""",
)
def union_by_identity(spark, sf_dir):
    first = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("orders"))
    second = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    return joins.union_by_identity(first, second)


MAIL_NUMBER = "CAST(o_orderkey AS STRING) || '7001'"
MAIL_MERCHANT = "'Clerk#' || CAST(o_custkey AS STRING)"
MAIL_TEXTS = {
    1: f"CASE o_orderkey % 4 WHEN 0 THEN 'no. ' || {MAIL_NUMBER} || ' sent' WHEN 1 THEN 'x1' || {MAIL_NUMBER} WHEN 2 THEN {MAIL_NUMBER} || '5 from ' || replace({MAIL_MERCHANT}, '#', ' # ') ELSE 'paid ' || {WHOLE} || ' yuan' END",
    2: f"CASE o_orderkey % 4 WHEN 0 THEN 'from ' || {MAIL_MERCHANT} || ' and paid ' || {WHOLE} WHEN 1 THEN 'paid 1' || {WHOLE} || '0, order: ' || {MAIL_NUMBER} || '.' || {MAIL_MERCHANT} ELSE '' END",
}


@register(
    "mail_hits",
    """SELECT o_orderkey AS item, mail, reasons, CAST(CASE WHEN o_orderkey % 4 = 0 THEN mail ELSE 1 END AS INTEGER) AS place FROM orders JOIN (VALUES
        (0, 1, 'order'), (2, 1, 'merchant'), (3, 1, 'amount'), (0, 2, 'merchant,amount'), (1, 2, 'order,merchant')) v(k, mail, reasons) ON o_orderkey % 4 = k""",
)
def mail_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    items = rows.select(F.col("o_orderkey").alias("item"), F.expr(MAIL_NUMBER).alias("order"), F.expr(MAIL_MERCHANT).alias("merchant"), F.expr(WHOLE).alias("amount"))
    texts = F.array(*[F.struct(F.lit(k).alias("mail"), F.expr(t).alias("text")) for k, t in MAIL_TEXTS.items()])
    mails = rows.select(F.col("o_orderkey").alias("item"), F.inline(texts))
    return joins.search_hits(items, mails).withColumn("reasons", F.array_join("reasons", ","))


LINE_ROLE = "CASE number % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'payment' WHEN 2 THEN 'trip' ELSE 'purchase' END"


@register(
    "printed_attachments",
    f"""WITH m AS ({adapters.MATERIAL_SQL}), a AS (SELECT pool, rn, CAST(cents AS VARCHAR) AS name, {LINE_ROLE} AS role FROM m WHERE blocked = 'O'),
    s AS (SELECT pool, CASE WHEN pool % 5 IN (0, 4) THEN string_agg(CAST(rn AS VARCHAR), ',' ORDER BY rn)
        ELSE string_agg(CAST(rn AS VARCHAR), ',' ORDER BY role IN ('invoice', 'payment'), name, rn) END AS selected FROM a
        WHERE CASE pool % 5 WHEN 0 THEN role = 'payment' WHEN 1 THEN role IN ('invoice', 'payment') WHEN 2 THEN role IN ('purchase', 'invoice') WHEN 3 THEN role IN ('trip', 'invoice') ELSE true END GROUP BY pool)
    SELECT p.pool AS id, coalesce(s.selected, '') AS selected FROM (SELECT DISTINCT pool FROM m) p LEFT JOIN s ON p.pool = s.pool""",
)
def printed_attachments(spark, sf_dir):
    lines = adapters.material(spark, sf_dir).select("pool", "rn", F.col("cents").cast("string").alias("name"), F.expr(LINE_ROLE).alias("role"), (F.col("blocked") == "O").alias("available"))
    rows = lines.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("rn", "name", "role", "available"))).alias("lines"))
    as_id = lambda x: F.struct(x["rn"].cast("string").alias("id"), x["name"].alias("name"), x["role"].alias("role"), x["available"].alias("available"))
    turn = F.col("pool") % 5
    rows = rows.select(
        F.col("pool").alias("id"), F.transform("lines", as_id).alias("attachments"), F.lit(None).cast("array<string>").alias("support"), (turn == 4).alias("acknowledged"),
        F.lit(False).alias("complete"), F.when(turn == 0, "payment_only").alias("basis"), (turn == 3).alias("trip_required"), F.lit(False).alias("waybill_required"),
        F.lit(False).alias("legacy"), F.lit(False).alias("alternative"), F.when(turn == 1, "hotel").otherwise("materials").alias("category"),
    )
    return rules.selected_attachments(rows).select("id", F.array_join("selected", ",").alias("selected"))


@register(
    "category_pending",
    f"""WITH e AS ({adapters.EXPENSE_SQL}), t AS (SELECT *, CASE cents % 3 WHEN 0 THEN 'saved' WHEN 1 THEN 'manual' ELSE 'failed' END AS status FROM e WHERE owner <> 'BUILDING'),
    j AS (SELECT e.id, t.status, e.cents % 11 = 0 AS manual, e.stage = 'draft' AND e.cents % 11 <> 0 AND coalesce(t.status <> 'manual', true)
        AND (e.category = '5-LOW' OR coalesce(t.status = 'saved', false)) AS eligible, t.id IS NULL OR e.cents % 5 = 0 AS changed FROM e LEFT JOIN t ON e.id = t.id)
    SELECT id, CASE WHEN manual THEN 'manual' ELSE status END AS status, eligible, eligible AND changed AS pending FROM j""",
)
def category_pending(spark, sf_dir):
    rows = adapters.expense(spark, sf_dir).withColumn("category", F.when(F.col("category") == "5-LOW", "other").otherwise(F.col("category")))
    cents = F.col("cents")
    items = rows.select("id", "stage", F.lit(False).alias("verified"), F.lit(False).alias("closed"), "category", (cents % 11 == 0).alias("manual"), cents.alias("input_key"))
    status = F.when(cents % 3 == 0, "saved").when(cents % 3 == 1, "manual").otherwise("failed")
    tried = rows.filter(F.col("owner") != "BUILDING").select(F.col("id").alias("item"), status.alias("status"), "category", F.lit(None).cast("string").alias("managed"), F.when(cents % 5 != 0, cents).alias("input_key"))
    return rules.category_status(items, tried)
