"""Typed transaction identifiers that a text states under their labels, and keys by which they may be compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions.evidence import filled, has, nfkc, rows_of

# -- Fixed values: labels and what kind of number they stand for, kinds that a key may have, and scopes that are none.
LABELS = {
    "支付宝交易号": "payment_transaction", "微信支付交易号": "payment_transaction", "微信支付订单号": "payment_order", "支付订单号": "payment_order",
    "商家订单号": "merchant_order", "商户订单号": "merchant_order", "商家单号": "merchant_order", "商户单号": "merchant_order",
    "交易流水号": "payment_transaction", "支付流水号": "payment_transaction", "交易单号": "payment_transaction", "交易号": "payment_transaction",
    "支付单号": "payment_order", "订单编号": "order", "订单号": "order",
}
KINDS = ("shopping_order", "payment_order", "merchant_order", "payment_transaction")
NO_SCOPE = ("unknown", "未知", "未识别", "未指定", "平台", "店铺", "商家", "支付渠道")
SHOPPING_ROLES, SHOPPING_TEXT = ("order", "purchase", "receipt", "voucher"), "订单已送达|订单详情|下单时间|订单创建时间"

_BY_LENGTH = "|".join(sorted(LABELS, key=len, reverse=True))
#: A label alone, with a value after a colon or a space, or joined to a number.
_ROW = rf"^({_BY_LENGTH})(?:(?:\s*:\s*|\s+)(.+)|(\d.*))?$"


def _tight(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def identifier_value(raw: Column) -> Column:
    """A number in normal form, or null: it is 6 to 64 letters, digits and hyphens, 4 digits at least, and no phone number, day or zeros.

    ``raw`` has compatibility characters replaced already.
    """
    value = _tight(F.regexp_replace(_tight(raw), "(?:[|丨│])?复制$", ""))
    good = has(value, "^[A-Za-z0-9-]{6,64}$") & (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 4)
    good = good & ~has(value, r"^1[3-9]\d{9}$") & ~has(value, r"^\d{4}-\d{1,2}-\d{1,2}$") & ~has(value, "^0+$")
    return F.when(good, value)


def typed_identifiers(text: Column, role: Column, platform: Column, channel: Column, shop: Column) -> Column:
    """An array of (kind, namespace, value, label) in order of the text, each kind and value once.

    A number's scope is the platform for shopping orders, the channel for payments, the platform or else the shop for merchants' orders, and
    none otherwise. If a text states several values of one kind, none of them has a scope: which is the right one isn't known.
    """
    # Python functions can't be called within a lambda, so each row is paired with the next one first.
    rows = filled(F.transform(rows_of(nfkc(text)), lambda r: F.regexp_replace(r, r"(?U)^\s+|\s+$", "")))
    pairs = F.zip_with(rows, F.slice(rows, F.lit(2), F.size(rows)), lambda row, after: F.struct(row.alias("row"), after.alias("after")))
    orders = F.when(F.lower(role) == "payment", "payment_order").when(F.lower(role).isin(*SHOPPING_ROLES) | has(text, SHOPPING_TEXT), "shopping_order").otherwise("untyped_order")
    kinds = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    empty = lambda c: F.coalesce(c, F.lit(""))

    def read(pair):
        label, own, joined = (F.regexp_extract(pair["row"], _ROW, i) for i in (1, 2, 3))
        raw = F.when(pair["row"] == label, pair["after"]).when(own != "", own).otherwise(joined)
        kind = F.when(kinds[label] == "order", orders).otherwise(kinds[label])
        return F.when(label != "", F.struct(kind.alias("kind"), identifier_value(raw).alias("value"), label.alias("label")))

    none = F.array().cast("array<struct<kind:string,value:string,label:string>>")

    def once(seen, i):
        fresh = ~F.exists(seen, lambda j: (j["kind"] == i["kind"]) & (j["value"] == i["value"]))
        return F.when(fresh, F.array_append(seen, i)).otherwise(seen)

    def scoped(seen):
        def one(i):
            several = F.exists(seen, lambda j: (j["kind"] == i["kind"]) & (j["value"] != i["value"]))
            own = F.when(i["kind"] == "shopping_order", platform).when(i["kind"].isin("payment_order", "payment_transaction"), channel)
            own = own.when(i["kind"] == "merchant_order", F.when(empty(platform) != "", platform).otherwise(shop))
            return F.struct(i["kind"].alias("kind"), F.when(several, "").otherwise(empty(own)).alias("namespace"), i["value"].alias("value"), i["label"].alias("label"))

        return F.transform(seen, one)

    found = F.filter(F.transform(pairs, read), lambda i: i.isNotNull() & i["value"].isNotNull())
    return F.aggregate(found, none, once, scoped)


def identifier_keys(identifiers: Column) -> Column:
    """Keys (JSON of kind, scope and value) of the identifiers that have a scope, each once: equal keys mean one transaction."""
    scope = lambda i: _tight(F.coalesce(i["namespace"], F.lit("")))
    usable = lambda i: i["kind"].isin(*KINDS) & (scope(i) != "") & ~F.lower(scope(i)).isin(*NO_SCOPE) & i["value"].isNotNull()
    return F.array_distinct(F.transform(F.filter(identifiers, usable), lambda i: F.to_json(F.array(i["kind"], scope(i), i["value"]))))
