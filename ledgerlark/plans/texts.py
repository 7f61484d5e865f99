"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import text as fn
from ledgerlark.plans.core import register
from ledgerlark.session import table


@register(
    "href_extract",
    """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
)
def href_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(fn.hrefs(F.col("html"))).alias("href"))


CATEGORY_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b{words}\\b') THEN '{name}' END" for name, words in fn.CATEGORIES.items())


@register(
    "message_category",
    f"""WITH c AS (SELECT conv_id, turn, list_filter([{CATEGORY_SQL}], lambda x: x IS NOT NULL) AS hits FROM conversations)
    SELECT conv_id, turn, CASE WHEN len(hits) = 1 THEN hits[1] END AS category FROM c""",
)
def message_category(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.category(F.col("text")).alias("category"))


@register(
    "redact",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[mail]', 'g'),
    '\+?[0-9]+ \([0-9]+\) [0-9]+-[0-9]+', '[phone]', 'g'), '[0-9]{8,}', '[number]', 'g')) AS digest FROM documents""",
)
def redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.redact(F.col("text")), 256).alias("digest"))


@register(
    "count_phrase",
    """WITH p AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '增加' || user_id || '人' WHEN 1 THEN '走了' || (user_id % 30) || '人' WHEN 2 THEN '没有变化'
        WHEN 3 THEN '改成' || user_id || '份' WHEN 4 THEN CAST(user_id AS VARCHAR) ELSE user_id || '份' END AS t, user_id FROM events)
    SELECT id, CASE id % 6 WHEN 0 THEN 'add' WHEN 1 THEN 'subtract' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'set' ELSE 'clarify' END AS kind,
        CASE id % 6 WHEN 0 THEN 21 + user_id WHEN 1 THEN CASE WHEN user_id % 30 <= 21 THEN 21 - user_id % 30 END WHEN 2 THEN 21 WHEN 3 THEN user_id END AS n FROM p""",
)
def count_phrase(spark, sf_dir):
    user, at = F.col("user_id").cast("string"), F.col("event_id") % 6
    text = (
        F.when(at == 0, F.concat(F.lit("增加"), user, F.lit("人")))
        .when(at == 1, F.concat(F.lit("走了"), (F.col("user_id") % 30).cast("string"), F.lit("人")))
        .when(at == 2, "没有变化").when(at == 3, F.concat(F.lit("改成"), user, F.lit("份"))).when(at == 4, user).otherwise(F.concat(user, F.lit("份")))
    )
    kind, number = fn.count_change(F.col("t"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("t")).select("id", kind.alias("kind"), number.alias("number"))
    return rows.select("id", "kind", fn.apply_change(F.lit(21).cast("bigint"), F.col("kind"), F.col("number")).alias("n"))


@register(
    "money_cents",
    """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 1 THEN '-' || o_custkey WHEN 2 THEN o_custkey || '.125' WHEN 3 THEN 'n/a' ELSE o_custkey || '.5' END AS s FROM orders),
    v AS (SELECT id, TRY_CAST(s AS DECIMAL(18,4)) AS v FROM t)
    SELECT id, CASE WHEN v >= 0 AND v <= 999999999 AND v * 100 = floor(v * 100) THEN CAST(v * 100 AS BIGINT) END AS cents FROM v""",
)
def money_cents(spark, sf_dir):
    at, cust = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    text = (
        F.when(at == 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).when(at == 1, F.concat(F.lit("-"), cust))
        .when(at == 2, F.concat(cust, F.lit(".125"))).when(at == 3, "n/a").otherwise(F.concat(cust, F.lit(".5")))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fn.cents(text).alias("cents"))


@register(
    "comparison_text",
    r"SELECT item_id, lower(regexp_replace(text, '\s+', '', 'g')) AS normal FROM benchmark",
)
def comparison_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", fn.compact(F.col("text")).alias("normal"))


@register(
    "unique_number_in_text",
    r"""WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '([0-9]{3,})', 1)) AS x FROM documents)
    SELECT doc_id, CASE WHEN len(x) = 1 THEN x[1] END AS number FROM f""",
)
def unique_number_in_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.unique_match(F.col("text"), r"([0-9]{3,})").alias("number"))


@register(
    "json_projection",
    "SELECT event_id AS id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events",
)
def json_projection(spark, sf_dir):
    data = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), data["k"].alias("k"))


@register(
    "csv_safe_cells",
    r"SELECT doc_id, sha256(CASE WHEN regexp_matches(ltrim(text), '^[=+\-@]') THEN chr(39) || text ELSE text END) AS digest FROM documents",
)
def csv_safe_cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.safe_cell(F.col("text")), 256).alias("digest"))


@register(
    "canonical_fingerprint",
    "SELECT o_custkey AS key, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY 1",
)
def canonical_fingerprint(spark, sf_dir):
    part = F.struct("o_orderkey", F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("s"))
    parts = F.transform(F.sort_array(F.collect_list(part)), lambda p: p["s"])
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sha2(F.array_join(parts, ","), 256).alias("fingerprint"))


@register("compatibility_text")
def compatibility_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.compatibility_form(F.col("text")), 256).alias("digest"))


@register("merchant_identity")
def merchant_identity(spark, sf_dir):
    at, name = F.col("c_custkey") % 4, F.col("c_name")
    text = F.when(at == 0, F.concat(F.lit("闪购："), name)).when(at == 1, F.concat(F.lit(" ·"), name, F.lit("（总店）:"))).when(at == 2, F.concat(F.lit("闪购"), name)).otherwise(name)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fn.merchant_identity(text).alias("merchant"))


@register("invoice_date")
def invoice_date(spark, sf_dir):
    at, day = F.col("o_orderkey") % 5, lambda pattern: F.date_format("o_orderdate", pattern)
    text = (
        F.when(at == 0, F.concat(F.lit("2001年2月3日 开票日期： "), day("yyyy年M月d日"))).when(at == 1, F.concat(F.lit("Invoice Date: "), day("yyyy/MM/dd")))
        .when(at == 2, F.concat(day("yyyy-MM-dd"), F.lit(" 共 "), day("yyyy.MM.dd"))).when(at == 3, F.concat(day("yyyy年MM月dd日"), F.lit(",2001年2月3日")))
        .otherwise(F.concat(F.lit("开票日期:2001年2月30日 "), day("yyyy-MM-dd")))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fn.invoice_date(text).alias("date"))
