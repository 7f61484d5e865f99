import pytest

from ledgerlark.plans import registry
from tests.helpers import HAVE_DATA, SF, agrees

pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    agrees(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_message_categories_of_odd_letters(spark, tmp_path):
    import duckdb

    texts = ["the", "éthe", "theé", "zimmerübersicht", "une_", "une‿", "9taxi", "TAXİ", "ZİMMER", "İnvoice x the", "VOL\u0301", "der٣", "hotel.room", "un\u0130e", "lunch ordеr", "ſthe", "K the", "\u0000the\u0000x", "", None]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.sql(registry.ORACLES["message_category"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["message_category"](spark, str(tmp_path)).collect()) == want
    assert dict((w[0], w[2]) for w in want)[1] == "transport"
