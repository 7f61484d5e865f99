"""What several operators share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII spaces.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Narrow rows that one task takes.
TASK_ROWS = 50_000


def cut(df: DataFrame, per_task: int | None = None) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so lost executors don't matter.

    With ``per_task``, what follows reads it in as many tasks as its rows need, where that is fewer than its partitions.
    The cluster's ``spark.checkpoint.dir`` is used. Where none is set, a local folder is in local mode, as in tests; on a
    cluster that is an error, as executors wouldn't see each other's files.
    """
    use_checkpoint_folder(df.sparkSession)
    kept = df.checkpoint()
    return kept if per_task is None else kept.coalesce(tasks_for(kept.count(), per_task))


def pack(df: DataFrame, per_task: int | None = None) -> DataFrame:
    """As ``cut``, for rows of numbers: kept as Parquet, whose encoded columns take about half of a checkpoint's rows."""
    path = shared_folder(df.sparkSession, "packed")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return kept if per_task is None else kept.coalesce(tasks_for(kept.count(), per_task))


def use_checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), context.master))


def checkpoint_folder(given: str | None, master: str) -> str:
    """``given``, or in local mode a new local folder."""
    if given is None and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all nodes share")
    return given or tempfile.mkdtemp(prefix="checkpoint-")


def look_up(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` inner-joined with ``facts``, which has one row per ``key``, where one key may hold a large part of ``rows``.

    A key's rows are dealt by a salt made from ``by``, and its fact is sent once per salt that it has.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(max(32, partitions(rows)))).cast("int")
    salted = rows.withColumn("_salt", salt)
    places = salted.select(key, "_salt").distinct().join(facts, key)
    return salted.join(places, [key, "_salt"]).drop("_salt")


def tasks_for(rows: int, per_task: int = TASK_ROWS) -> int:
    return max(1, -(-rows // per_task))


def partitions(df: DataFrame) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path that isn't there yet, in the folder where ``cut`` keeps what it cuts."""
    use_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
