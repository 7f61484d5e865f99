"""Queries over whole tables, against SQL of the whole job."""

import datetime
import hashlib
import unicodedata

import pytest

from ledgerlark.plans import registry
from ledgerlark.session import table
from tests.helpers import HAVE_DATA, SF, agrees

pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")

#: Queries that were cut once; each reads all rows of its tables, at every size.
WHOLE = ("merge_duplicates", "csv_safe_cells", "linked_closure", "ordered_point_lookup", "duplicate_lookup_or", "zero_filled_summary", "json_projection")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_larger_tables(spark, name):
    agrees(spark, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.01")


def test_compatibility_text_of_all_documents(spark):
    flat = lambda t: "".join(unicodedata.normalize("NFKC", t).split())
    want = {r.doc_id: hashlib.sha256(flat(r.text).encode()).hexdigest() for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.digest for r in registry.QUERIES["compatibility_text"](spark, SF).collect()} == want


def test_merchant_identity_of_all_customers(spark):
    flat = lambda t: "".join(t.split())
    want = {r.c_custkey: flat(r.c_name) + ("(总店)" if r.c_custkey % 4 == 1 else "") for r in table(spark, SF, "customer").collect()}
    assert {r.id: r.merchant for r in registry.QUERIES["merchant_identity"](spark, SF).collect()} == want


def test_invoice_date_of_all_orders(spark):
    want = {r.o_orderkey: r.o_orderdate.date() if r.o_orderkey % 5 < 3 or r.o_orderkey % 5 == 3 and r.o_orderdate.date() == datetime.date(2001, 2, 3) else None for r in table(spark, SF, "orders").collect()}
    assert {r.id: r.date for r in registry.QUERIES["invoice_date"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["compatibility_text", "merchant_identity", "invoice_date"])
def test_texts_go_to_workers_a_few_at_a_time(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
