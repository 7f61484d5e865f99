"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ledgerlark.functions.text import safe_cell

#: A folder with more files than this is refused, not cut. A fixed value.
MOST_FILES = 500


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line. Blank lines and lines with another JSON value are skipped; a malformed line raises."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    lines = lines.filter(F.substring(F.trim("value"), 1, 1).isin("{") | ~F.trim("value").rlike(r'^(\[.*\]|".*"|-?[0-9.eE+-]+|true|false|null)$'))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    df.withColumns({c: safe_cell(F.col(c)) for c in texts}).write.mode("overwrite").option("header", True).csv(path)


def read_folder(spark: SparkSession, path: str, pattern: str = "*", *, most: int = MOST_FILES) -> DataFrame:
    """Files under ``path`` with their SHA-256, first copy of each content marked; too many files fail the read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    if files.select("path").limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files")
    rows = files.select("path", "length", F.sha2("content", 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("path").alias("first"))
    return rows.join(first, "digest").select("path", "length", "digest", (F.col("path") == F.col("first")).alias("added"))


class MailboxSource(DataSource):
    """Messages of a mailbox kept as JSON lines ``{"epoch", "uid", "subject", "size"}``: ``format("mailbox").load(path)``.

    As a stream its offset is (epoch, uid): a batch has the next messages of one epoch, and a new epoch starts again from its
    first message.
    """

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "epoch bigint, uid bigint, subject string, size bigint, issue string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MailboxReader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _MailboxStream(self.options)


def _messages(options) -> list[tuple]:
    import json

    most = int(options.get("mostBytes", 1 << 20))
    with open(options["path"], encoding="utf-8") as f:
        rows = [json.loads(line) for line in f if line.strip()]
    return sorted((r["epoch"], r["uid"], r.get("subject"), r.get("size", 0), "oversized" if r.get("size", 0) > most else None) for r in rows)


class _MailboxReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _messages(self.options)


class _MailboxStream(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"epoch": 0, "uid": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = _messages(self.options)
        newest = max((r[0] for r in rows), default=start["epoch"])
        after = start["uid"] if newest == start["epoch"] else 0
        part = [r for r in rows if r[0] == newest and r[1] > after][: int(self.options.get("limit", 20))]
        end = {"epoch": newest, "uid": part[-1][1] if part else after}
        return iter(part), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        after = start["uid"] if start["epoch"] == end["epoch"] else 0
        return iter([r for r in _messages(self.options) if r[0] == end["epoch"] and after < r[1] <= end["uid"]])

    def commit(self, end: dict) -> None:
        pass


