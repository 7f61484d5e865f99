import json

import pytest

from ledgerlark.sources import files


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n"x"\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a long").collect()


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2), ("plain", 3)], "t string, n long")
    files.write_csv(df, str(tmp_path / "csv"))
    assert {r.t for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=1+1", "plain"}
    for _ in range(2):
        files.append_jsonl(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_folder(spark, tmp_path):
    for name, text in (("a.txt", "x"), ("b.txt", "x"), ("c.txt", "y")):
        (tmp_path / name).write_text(text)
    rows = files.read_folder(spark, str(tmp_path)).collect()
    assert sorted(r.added for r in rows) == [False, True, True]
    with pytest.raises(ValueError):
        files.read_folder(spark, str(tmp_path), most=2)


def test_mailbox(spark, tmp_path):
    path = tmp_path / "mail.jsonl"
    path.write_text("\n".join(json.dumps({"epoch": 1, "uid": u, "subject": f"s{u}", "size": u * 600_000}) for u in range(1, 4)))
    spark.dataSource.register(files.MailboxSource)
    got = spark.read.format("mailbox").load(str(path)).collect()
    assert [r.issue for r in sorted(got, key=lambda r: r.uid)] == [None, "oversized", "oversized"]
    stream = files.MailboxSource({"path": str(path), "limit": "2"}).simpleStreamReader(None)
    rows, end = stream.read(stream.initialOffset())
    assert [r[1] for r in rows] == [1, 2] and end == {"epoch": 1, "uid": 2}
    path.write_text(json.dumps({"epoch": 2, "uid": 1}))
    rows, end = stream.read(end)
    assert [r[:2] for r in rows] == [(2, 1)] and end == {"epoch": 2, "uid": 1}
