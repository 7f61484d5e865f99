"""Where evidence comes from: trusted mail origins, shards of one chat, and tables under a renamed category."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.session import tasks_for

ORIGIN = ("account", "mailbox", "uidvalidity", "uid", "message_id")


def trusted_origins(entries: DataFrame, messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, account, mailbox, uidvalidity, uid, message_id, authority) of the entries whose mail can't be mistaken.

    ``entries`` (id, source, batch, digest) name the message (``batch``) that an agent took them from, or came by hand (source ``mail``).
    ``messages`` are (id, account, mailbox, uidvalidity, uid, message_id, digests), ``accounts`` (account, mailbox, uidvalidity) by now.

    Any doubt voids it: an entry's or message's identifier that occurs twice; for an agent's entry a digest that isn't one of the
    message's, a message that lists one twice, or an account that has started another epoch since; for one by hand, bytes
    that several messages have. Each side meets the other by equality, and what claims something twice is counted, never paired.
    Of accounts, a row per mailbox is sent to all tasks.
    """
    tasks = tasks_for(entries)
    # As a number, the source goes through an aggregation by hash.
    source = F.when(F.col("source") == "agent", 1).when(F.col("source") == "mail", 2).alias("source")
    once = entries.select("id", source, "batch", "digest").repartition(tasks, "id").groupBy("id").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("source", "batch", "digest")]
    ).filter("n = 1 AND digest IS NOT NULL")
    # Messages are counted where they are sorted by identifier; their lists are never gathered.
    known = messages.withColumn("n", F.count("*").over(Window.partitionBy("id"))).filter("n = 1")
    now = accounts.select("account", "mailbox", "uidvalidity").distinct()
    single = now.groupBy("account", "mailbox").agg(F.count("*").alias("n"), F.first("uidvalidity").alias("uidvalidity")).filter("n = 1").drop("n")
    plain = known.filter(F.size("digests") == F.size(F.array_distinct("digests"))).join(F.broadcast(single), ["account", "mailbox", "uidvalidity"])
    by_agent = once.filter("source = 1").repartition(tasks, "batch").join(plain.select(F.col("id").alias("batch"), *ORIGIN, "digests"), "batch").filter(F.array_contains("digests", F.col("digest")))
    seen = messages.select(*ORIGIN, F.explode(F.array_distinct("digests")).alias("digest")).repartition(tasks, "digest").distinct()
    one = seen.groupBy("digest").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ORIGIN]).filter("n = 1")
    by_hand = once.filter("source = 2").join(one.drop("n"), "digest")
    return by_agent.select("id", *ORIGIN, F.lit("agent").alias("authority")).union(by_hand.select("id", *ORIGIN, F.lit("manifest").alias("authority")))


def merge_shards(messages: DataFrame, windows: DataFrame, *, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Messages of chats' windows from all their shards in order, and what is wrong with each window.

    ``messages`` are (chat, shard, second, seq, local_id and more), ``windows`` (chat, start, end) half open, one per chat. The first result
    has ``place`` within the chat, by (second, seq, shard, local_id), and ``tied``: another shard has a message of the same second and
    sequence, so their order isn't known. The second is (chat, scanned, issues, safe). A shard with more than ``most`` messages in the window
    makes it ``overflow``: it gives no message at all and the reader must not go on from its end, but ask for a shorter one.
    """
    inside = messages.join(windows, "chat").filter("second >= start AND second < end").drop("start", "end")
    fullest = inside.groupBy("chat", "shard").agg(F.count("*").alias("n")).groupBy("chat").agg(F.max("n").alias("fullest"), F.sum("n").alias("scanned"))
    torn = inside.groupBy("chat", "second", "seq").agg(F.count_distinct("shard").alias("shards")).filter("shards > 1").select("chat", "second", "seq", F.lit(True).alias("tied"))
    kept = inside.join(fullest.filter(F.col("fullest") > most).select("chat"), "chat", "left_anti")
    order = Window.partitionBy("chat").orderBy("second", "seq", "shard", "local_id")
    rows = kept.join(torn, ["chat", "second", "seq"], "left").withColumns({"tied": F.coalesce("tied", F.lit(False)), "place": F.row_number().over(order)})
    ties = torn.select("chat").distinct().withColumn("ties", F.lit(True))
    over = F.coalesce(F.col("fullest") > most, F.lit(False))
    issues = F.array_compact(F.array(F.when(over, "overflow"), F.when(F.col("ties"), "order_across_shards")))
    states = windows.join(fullest, "chat", "left").join(ties, "chat", "left")
    return rows, states.select("chat", F.coalesce("scanned", F.lit(0)).alias("scanned"), F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("safe"))


#: What is renamed: names of fields with their old and new values, also where an object has the name as ``kind`` and the value as ``value``. Fixed values.
RENAMED = {"category": ("顺丰", "快递"), "managed_category": ("顺丰", "快递"), "goods_category": ("顺丰", "快递"), "report_section": ("sf", "express")}
BY_KIND = ("category", "report_section")


def renamed(value: Any, inverse: bool = False) -> Any:
    """A parsed JSON value with fields renamed at any depth; names of people and shops, and any other field, stay."""
    if isinstance(value, list):
        return [renamed(v, inverse) for v in value]
    if not isinstance(value, dict):
        return value
    out = {k: renamed(v, inverse) for k, v in value.items()}
    for name, pair in RENAMED.items():
        old, new = pair[::-1] if inverse else pair
        if out.get(name) == old:
            out[name] = new
        if name in BY_KIND and out.get("kind") == name and out.get("value") == old:
            out["value"] = new
    return out


def _rewrite(inverse: bool):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            before = json.loads(text)
            after = renamed(before, inverse)
            out.append(text if before == after else json.dumps(after, ensure_ascii=False))
        return pa.array(out, pa.string())

    return run


def rename_json(text: Column, inverse: bool = False) -> Column:
    """JSON text with fields renamed at any depth; unchanged texts stay as they are, to the byte. Text that isn't JSON stays.

    Only texts that may hold an old value are parsed; an escape sequence may be one.
    """
    old = {pair[1 if inverse else 0] for pair in RENAMED.values()}
    may = F.lit(False)
    for word in (*old, "\\u"):
        may = may | F.contains(text, F.lit(word))
    parsed = F.when(may & F.try_parse_json(text).isNotNull(), text)
    return F.coalesce(F.when(parsed.isNotNull(), _rewrite(inverse)(F.coalesce(parsed, F.lit("null")))), text)


def migrate(rows: DataFrame, columns: list[str], applied: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with JSON ``columns`` renamed and ``changed``, and the markers with this migration's; done once.

    If ``applied`` (name) has the migration already, rows stay as they are: later rows may use the old words on purpose.
    """
    done = not applied.filter(F.col("name") == name).isEmpty()
    if done:
        return rows.withColumn("changed", F.lit(False)), applied
    fresh = rows.withColumns({f"_{c}": rename_json(F.col(c)) for c in columns})
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = fresh.withColumn("changed", changed).withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
    return out, applied.select("name").union(rows.sparkSession.createDataFrame([(name,)], "name string"))


def same_version(text: Column, version: Column) -> Column:
    """Whether a hash taken before or after the migration is that of ``text``."""
    return F.coalesce((F.sha2(text, 256) == version) | (F.sha2(rename_json(text, inverse=True), 256) == version), F.lit(False))
