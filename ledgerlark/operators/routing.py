"""Routing of rows by names, dates and identities: a route exists only if it is the only one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_interval(rows: DataFrame, periods: DataFrame, *, at: str, key: list[str], name: str = "project", until: str | None = None, by_days: int = 31, bound: Column | None = None) -> DataFrame:
    """``rows`` with the one period (name, start, end or null) that holds ``at`` (to ``until``, if given), null if none or several do.

    Both sides meet in cells of ``by_days`` days, so the interval join is an equality join first; open periods
    reach to ``bound`` (the last of ``until`` or ``at``, if not given).
    """
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / by_days)
    last = until or at
    top = rows.agg(F.max(last).alias("_top"))
    ends = periods.crossJoin(F.broadcast(top)).withColumn("_end", F.coalesce("end", "_top" if bound is None else bound))
    ends = ends.filter(F.col("start") <= F.col("_end")).withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("_end")))))
    hits = rows.withColumn("_cell", cell(F.col(at))).join(ends.select(name, "start", "_end", "_cell"), "_cell")
    hits = hits.filter((F.col(at) >= F.col("start")) & (F.col(last) <= F.col("_end")))
    found = hits.groupBy(*key).agg(F.min(name).alias("_low"), F.countDistinct(name).alias("matches"))
    route = F.when(F.col("matches") == 1, F.col("_low"))
    return rows.join(found, key, "left").select(*rows.columns, route.alias(name), F.coalesce("matches", F.lit(0)).alias("matches"))


def reroute_unassigned(messages: DataFrame, periods: DataFrame, default: str | None = None) -> DataFrame:
    """(id, project, reason) of messages that can be routed now that projects have changed.

    Only untouched messages (id, status, touched, first, last) with status ``unassigned`` and known days are looked at again. They go to the one
    project (project, start, end, reimbursed) that isn't reimbursed and holds all their days, else to ``default``, if that exists.
    Null flags count as false; a project without a start holds no day.
    """
    untouched = messages.filter((F.col("status") == "unassigned") & ~F.coalesce("touched", F.lit(False)) & F.col("first").isNotNull())
    free = periods.filter(~F.coalesce("reimbursed", F.lit(False)))
    found = unique_interval(untouched, free, at="first", until="last", key=["id"])
    exists = default is not None and not periods.filter(F.col("project") == default).isEmpty()
    reason = F.when(F.col("project").isNotNull(), "date").otherwise("default")
    routed = found.select("id", F.coalesce("project", F.lit(default if exists else None)).alias("project"), reason.alias("reason"))
    return routed.filter("project IS NOT NULL")


def unique_lookup(rows: DataFrame, groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` whose keys stand for exactly one ``value`` in ``groups``, with that value."""
    one = groups.groupBy(*keys).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(one, keys)


def duplicates_by_any(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that share at least one of ``keys`` with ``known``, with the keys that match, by one equality join per key."""
    hits = None
    for key in keys:
        own = rows.filter(F.col(key).isNotNull()).join(known.select(key).dropna().distinct(), key, "left_semi").select("id", F.lit(key).alias("reason"))
        hits = own if hits is None else hits.union(own)
    return hits.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def owners_elsewhere(rows: DataFrame, item: str, key: str) -> DataFrame:
    """Per item and key: how many other items have the key."""
    owners = rows.groupBy(key).agg(F.countDistinct(item).alias("owners"))
    return rows.select(item, key).distinct().join(owners, key).select(item, key, (F.col("owners") - 1).alias("others"))


def canonical(people: DataFrame, *, rounds: int = 40) -> DataFrame:
    """(person, root) where merged_into leads in the end. A missing person or a cycle is an error.

    Each round doubles how far the pointers reach.
    """
    missing = people.filter("merged_into IS NOT NULL").join(people.select(F.col("person").alias("merged_into")), "merged_into", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a person is merged into one that doesn't exist")
    state = people.select("person", "merged_into", F.coalesce("merged_into", "person").alias("root"))
    for _ in range(rounds):
        step = state.select(F.col("person").alias("root"), F.col("root").alias("_next"))
        moved = state.join(step, "root").select("person", "merged_into", F.col("_next").alias("root")).checkpoint()
        changed = not moved.select("person", "root").exceptAll(state.select("person", "root")).isEmpty()
        state = moved
        if not changed:
            break
    else:
        raise ValueError("people are merged in a cycle")
    tops = people.filter("merged_into IS NULL").select(F.col("person").alias("root"))
    if not state.join(tops, "root", "left_anti").isEmpty():
        raise ValueError("people are merged in a cycle")
    return state.select("person", "root")


def closure(seeds: DataFrame, edges: DataFrame, *, cut_every: int = 16) -> DataFrame:
    """Nodes (node) that ``edges`` (src, dst) lead to from ``seeds``, repeated until nothing is new. Null nodes and ends are left out.

    Every round adds a frame to what is found; every ``cut_every`` rounds that is written as one.
    """
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    found = frontier = seeds.select("node").filter("node IS NOT NULL").distinct().checkpoint()
    rounds = 0
    while not frontier.isEmpty():
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = new.join(found, "node", "left_anti").checkpoint()
        found, rounds = found.union(frontier), rounds + 1
        if rounds % cut_every == 0:
            found = found.checkpoint()
    return found


def with_priority(cached: DataFrame, recovered: DataFrame, keys: list[str]) -> DataFrame:
    """All cached rows, and recovered ones only where nothing is cached."""
    return cached.unionByName(recovered.join(cached.select(*keys).distinct(), keys, "left_anti"))


def consistent_preference(rows: DataFrame, keys: list[str], kind: str, value: str) -> DataFrame:
    """Per key and kind the value all rules agree on; where they don't, null and a conflict."""
    found = rows.groupBy(*keys, kind).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    same = F.col("low") == F.col("high")
    return found.select(*keys, kind, F.when(same, F.col("low")).alias(value), (~same).alias("conflict"))


def strongest_pairs(pairs: DataFrame, left: str, right: str, rank: str) -> DataFrame:
    """Pairs that are the strongest of both their ends."""
    best = lambda c: F.max(rank).over(Window.partitionBy(c))
    ranked = pairs.withColumns({"_l": best(left), "_r": best(right)})
    return ranked.filter((F.col(rank) == F.col("_l")) & (F.col(rank) == F.col("_r"))).drop("_l", "_r")
