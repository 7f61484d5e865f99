"""Queries on where evidence comes from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark import adapters
from ledgerlark.functions import identifiers as ids
from ledgerlark.operators import provenance as ops
from ledgerlark.plans.core import register
from ledgerlark.session import table, tasks_for

LINE = "(l_orderkey * 10 + l_linenumber)"
MAIL_SQL = f"""e AS (SELECT CASE WHEN l_suppkey % 50 = 0 THEN l_orderkey ELSE {LINE} END AS id, CASE WHEN l_suppkey % 2 = 0 THEN 'mail' ELSE 'agent' END AS source, l_orderkey AS batch, CASE WHEN l_suppkey % 7 = 0 THEN l_partkey + 1 ELSE l_partkey END AS digest FROM lineitem),
    m AS (SELECT o_orderkey AS id, o_custkey % 20 AS account, 'INBOX' AS mailbox, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS uidvalidity, o_orderkey AS uid, o_custkey AS message_id, list(l_partkey) AS digests FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


@register(
    "trusted_origins",
    f"""WITH {MAIL_SQL}, u AS (SELECT id, min(source) AS source, min(batch) AS batch, min(digest) AS digest FROM e GROUP BY id HAVING count(*) = 1),
    d AS (SELECT DISTINCT m.* EXCLUDE (digests, id), unnest(digests) AS digest FROM m),
    o AS (SELECT * FROM d WHERE digest IN (SELECT digest FROM d GROUP BY digest HAVING count(*) = 1))
    SELECT u.id, account, mailbox, uidvalidity, uid, message_id, 'agent' AS authority FROM u JOIN m ON u.batch = m.id WHERE source = 'agent' AND uidvalidity = 2 AND account % 5 > 0
        AND len(digests) = len(list_distinct(digests)) AND list_contains(digests, u.digest)
    UNION ALL SELECT u.id, account, mailbox, uidvalidity, uid, message_id, 'manifest' FROM u JOIN o ON u.digest = o.digest WHERE source = 'mail'""",
)
def trusted_origins(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    own = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    entries = lines.select(
        F.when(F.col("l_suppkey") % 50 == 0, F.col("l_orderkey")).otherwise(own).alias("id"), F.when(F.col("l_suppkey") % 2 == 0, "mail").otherwise("agent").alias("source"),
        F.col("l_orderkey").alias("batch"), F.when(F.col("l_suppkey") % 7 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("digest"),
    )
    parts = lines.select("l_orderkey", "l_partkey").repartition(tasks_for(lines), "l_orderkey").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("digests"))
    messages = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("account"), F.lit("INBOX").alias("mailbox"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("uidvalidity"),
        F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("message_id"), "digests",
    )
    accounts = messages.select("account", "mailbox", F.when(F.col("account") % 5 > 0, 2).otherwise(3).alias("uidvalidity")).distinct()
    return ops.trusted_origins(entries, messages, accounts)


SHARDS = "(SELECT o_custkey AS chat, o_orderkey % 3 AS shard, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) // 90 AS second, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS seq, o_orderkey AS local_id FROM orders)"


def sharded_messages(spark, sf_dir):
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    messages = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("chat"), (F.col("o_orderkey") % 3).alias("shard"), F.floor(day / 90).alias("second"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("seq"), F.col("o_orderkey").alias("local_id")
    )
    windows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat"), F.lit(8).alias("start"), (F.lit(30) + F.col("c_nationkey") % 9).alias("end"))
    return ops.merge_shards(messages, windows, most=4)


@register(
    "merged_shards",
    f"""WITH i AS (SELECT s.* FROM {SHARDS} s JOIN customer ON c_custkey = chat WHERE second >= 8 AND second < 30 + c_nationkey % 9)
    SELECT chat, shard, second, seq, local_id, EXISTS (SELECT 1 FROM i j WHERE j.chat = i.chat AND j.second = i.second AND j.seq = i.seq AND j.shard <> i.shard) AS tied,
        row_number() OVER (PARTITION BY chat ORDER BY second, seq, shard, local_id) AS place
    FROM i WHERE chat NOT IN (SELECT chat FROM i GROUP BY chat, shard HAVING count(*) > 4)""",
)
def merged_shards(spark, sf_dir):
    return sharded_messages(spark, sf_dir)[0].select("chat", "shard", "second", "seq", "local_id", "tied", "place")


@register(
    "shard_windows",
    f"""WITH i AS (SELECT s.* FROM {SHARDS} s JOIN customer ON c_custkey = chat WHERE second >= 8 AND second < 30 + c_nationkey % 9),
    f AS (SELECT chat, max(n) AS fullest, sum(n) AS scanned FROM (SELECT chat, shard, count(*) AS n FROM i GROUP BY ALL) GROUP BY chat),
    t AS (SELECT DISTINCT chat FROM (SELECT chat FROM i GROUP BY chat, second, seq HAVING count(DISTINCT shard) > 1))
    SELECT c_custkey AS chat, CAST(coalesce(scanned, 0) AS BIGINT) AS scanned, concat_ws(',', CASE WHEN fullest > 4 THEN 'overflow' END, CASE WHEN t.chat IS NOT NULL THEN 'order_across_shards' END) AS issues,
        coalesce(fullest, 0) <= 4 AND t.chat IS NULL AS safe FROM customer LEFT JOIN f ON f.chat = c_custkey LEFT JOIN t ON t.chat = c_custkey""",
)
def shard_windows(spark, sf_dir):
    return sharded_messages(spark, sf_dir)[1]


def receipts(spark, sf_dir):
    """Texts with one to three labelled numbers; labels, separators, order and doubt follow from the order's columns."""
    o, labels = table(spark, sf_dir, "orders"), F.array(*[F.lit(x) for x in ids.LABELS])
    pick = lambda seed: labels[F.pmod(F.xxhash64(F.lit(seed), "o_orderkey"), F.lit(len(ids.LABELS))).cast("int")]
    gap = lambda seed: F.array(*[F.lit(x) for x in ("：", ": ", " ", "\n", "", "x")])[F.pmod(F.xxhash64(F.lit(seed), "o_custkey", "o_orderkey"), F.lit(6)).cast("int")]
    number = lambda c: F.lpad(c.cast("string"), 9, "4")
    rows = [F.concat(pick(1), gap(2), number(F.col("o_custkey"))), F.concat(F.lit(" "), pick(3), gap(4), number(F.col("o_orderkey")), F.when(F.col("o_orderkey") % 4 == 0, "|复制").otherwise("")),
            F.concat(pick(5), gap(6), F.when(F.col("o_orderkey") % 3 == 0, number(F.col("o_custkey"))).when(F.col("o_orderkey") % 3 == 1, F.lit("13812345678")).otherwise(F.lit("２０２４ＡＢ-77")))]
    text = F.array_join(F.slice(F.array(*rows), F.lit(1), (1 + F.col("o_orderkey") % 3).cast("int")), "\n")
    role = F.when(F.col("o_orderstatus") == "F", "payment").when(F.col("o_orderstatus") == "O", "order").otherwise("other")
    return o.select(
        F.col("o_orderkey").alias("id"), text.alias("text"), role.alias("role"), F.when(F.col("o_custkey") % 3 > 0, "美团").otherwise("").alias("platform"),
        F.when(F.col("o_custkey") % 5 > 0, "支付宝").alias("channel"), F.when(F.col("o_custkey") % 2 > 0, "红谷商行").otherwise("平台").alias("shop"),
    )


@register("typed_identifiers")
def typed_identifiers(spark, sf_dir):
    found = ids.typed_identifiers(*[F.col(c) for c in ("text", "role", "platform", "channel", "shop")])
    rows = receipts(spark, sf_dir).withColumn("found", found)
    listed = F.array_join(F.transform("found", lambda i: F.concat_ws("/", i["kind"], i["namespace"], i["value"], i["label"])), "|")
    return rows.select("id", listed.alias("identifiers"), F.array_join(ids.identifier_keys(F.col("found")), "|").alias("keys"))


@register(
    "category_migration",
    f"""WITH e AS ({adapters.EXPENSE_SQL}), r AS (SELECT id, CASE category WHEN '1-URGENT' THEN '顺丰' WHEN '2-HIGH' THEN '快递' ELSE category END AS c, CASE WHEN stage = 'ready' THEN 'sf' ELSE stage END AS s FROM e)
    SELECT id, CASE c WHEN '顺丰' THEN '快递' ELSE c END AS category, '顺丰' AS merchant, CASE s WHEN 'sf' THEN 'express' ELSE s END AS section, CASE c WHEN '顺丰' THEN '快递' ELSE c END AS preference,
        c = '顺丰' OR s = 'sf' AS changed FROM r""",
)
def category_migration(spark, sf_dir):
    category = F.when(F.col("category") == "1-URGENT", "顺丰").when(F.col("category") == "2-HIGH", "快递").otherwise(F.col("category"))
    section = F.when(F.col("stage") == "ready", "sf").otherwise(F.col("stage"))
    kept = F.struct(F.lit("category").alias("kind"), category.alias("value"))
    data = F.to_json(F.struct(F.lit("顺丰").alias("merchant"), F.struct(F.array(F.struct(category.alias("goods_category"))).alias("rows"), section.alias("report_section")).alias("choice"), F.array(kept).alias("preferences")))
    rows = adapters.expense(spark, sf_dir).select("id", data.alias("data"))
    done, _ = ops.migrate(rows, ["data"], spark.createDataFrame([], "name string"), "category")
    at = lambda path: F.get_json_object("data", path)
    return done.select("id", at("$.choice.rows[0].goods_category").alias("category"), at("$.merchant").alias("merchant"), at("$.choice.report_section").alias("section"), at("$.preferences[0].value").alias("preference"), "changed")
