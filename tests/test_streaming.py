import pandas as pd

from ledgerlark.streaming import folds, ingest


def test_rate_limit_ignores_what_it_suppressed():
    assert ingest.limit_rate([0, 1, 2, 3, 86_400, 86_401]) == [True, True, True, False, True, True]


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(o, i, i * 20_000 + o) for o in (1, 2) for i in range(12)]
    schema = "object long, id long, second long"
    for part in range(3):
        spark.createDataFrame(rows[part * 8 : part * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.rate_limited_stream(stream).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("limited").orderBy("object", "id").toPandas()
    want = ingest.rate_limited(spark.createDataFrame(rows, schema)).orderBy("object", "id").toPandas()
    # Files are read in the order they were written, which is the order of time within each object.
    pd.testing.assert_frame_equal(got, want)


def test_stream_keeps_conflicts(spark, tmp_path):
    for part in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]):
        spark.createDataFrame(part, "key long, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["key"], "payload").awaitTermination(120)
    got = {r.key: r.conflict for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_outbox_supersedes(spark):
    rows = [(1, 1, 7, True, 1), (1, 2, 7, True, 1), (1, 3, 8, True, 1), (1, 4, 7, False, 1), (1, 5, 8, False, 1), (2, 1, 1, False, 1)]
    got = ingest.outbox(spark.createDataFrame(rows, "project long, seq long, item long, verified boolean, version long")).orderBy("version").collect()
    assert [(r.project, r.version, r.status, r.verified_items) for r in got] == [
        (1, 1, "superseded", 1), (1, 2, "superseded", 2), (1, 3, "superseded", 1), (1, 4, "pending", 0),
    ]


def test_returning_to_an_earlier_set_is_a_new_version(spark):
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate("aaba")], "key long, seq long, fingerprint string")
    got = [r.version for r in ingest.version_chain(rows).orderBy("seq").collect()]
    assert got[0] == got[1] and len(set(got)) == 3


def test_event_fold(spark):
    rows = [(1, 10, 1, "add", 5), (1, 10, 2, "set", 20), (1, 20, 3, "add", 2), (1, 15, 4, "add", 9), (1, 20, 5, "add", 1)]
    events = spark.createDataFrame(rows, "task long, at long, id long, kind string, number long")
    got = ingest.apply_in_order(events.select("task").distinct(), events).first()
    assert (got.value, got.revision, got.kept, got.clarify) == (22, 2, 1, 2)


def test_a_key_over_many_batches_is_one_fold(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(600).selectExpr("CASE WHEN id % 3 > 0 THEN 1 WHEN id % 5 = 0 THEN NULL ELSE id END AS key", "-id AS place", "id")
        seen = lambda state, row: state.append(row["id"]) or (row["key"], len(state), min(state))
        got = folds.ordered_fold(rows, "key", ["place"], "key bigint, n bigint, least bigint", list, seen).collect()
        hot = sorted((r.n, r.least) for r in got if r.key == 1)
        ids = sorted((i for i in range(600) if i % 3), reverse=True)
        assert hot == [(n + 1, i) for n, i in enumerate(ids)] and len(got) == 600 - 40
        count = folds.ordered_fold(rows, "key", ["place"], "key bigint, n bigint", lambda: [0], lambda s, r: s.__setitem__(0, s[0] + 1), lambda k, s: (k, s[0])).collect()
        assert {r.key: r.n for r in count}[1] == 400 and len(count) == 161 and folds.ordered_fold(rows.limit(0), "key", ["place"], "key bigint", list, seen).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
