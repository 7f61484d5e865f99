import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import automata, infill, queries
from tests.helpers import HAVE_DATA, agrees
from tests.llm.fixtures import SCHEMA, documents

SPLIT = {
    "code points": lambda t: list(t),
    "words": lambda t: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t),
    "lines": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
}
#: Awkward for chunks: characters of 1 to 4 bytes over borders, markers over borders, near-markers.
TEXTS = ["a😀é日" * 40_000, "é" * 70_001, "<" * 65_535 + "P>" + "x" * 80_000, "<P<S<M" * 30_000, "x" * 65_536, "x" * 65_537, "<S", "<<P>>", "", None, "日", "\n\n", " a  b \n", "\x00é\n" * 900]


def units_of(texts, units, cut_at):
    """Byte offsets by splitting the text: what stands before its first word goes with the first unit."""
    out = []
    for t, k in zip(texts, cut_at, strict=True):
        parts = SPLIT[units](t)
        head = len(t) - sum(map(len, parts))
        out.append(0 if k == 0 else len((t[:head] + "".join(parts[:k])).encode()))
    return out


@pytest.mark.parametrize("units", SPLIT)
def test_cuts_of_units(units):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é日😀\n\t") for _ in range(rng.choice([0, 1, 5, 511, 512, 513, 3000]))) for _ in range(60)]
    texts = [t for t in texts if units != "words" or t.strip(" \n\t") or not t]  # with spaces only there is no unit
    found = automata.Texts(infill.UNITS[units](), [t.encode() for t in texts])
    n = [len(SPLIT[units](t)) for t in texts]
    assert found.totals().tolist() == n
    k = np.array([rng.randrange(x + 1) for x in n])
    want = units_of(texts, units, k)
    assert [w if i < x else len(t.encode()) for w, i, x, t in zip(want, k, n, texts, strict=True)] == found.cuts(k).tolist()


def test_any_grouping_of_chunks_composes_alike():
    rng = random.Random(5)
    data = "".join(rng.choice("é日😀x<P>") for _ in range(4000)).encode()
    for automaton in (automata.code_points(), automata.marker_finder(infill.MARKERS), automata.words()):
        whole = automata.Texts(automaton, [data]).whole()
        for _ in range(5):
            at = sorted(rng.randrange(len(data)) for _ in range(7))
            parts = [automata.Texts(automaton, [data[a:b]]).whole() for a, b in zip([0, *at], [*at, len(data)], strict=True)]
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [automata.compose(parts[i], parts[i + 1])]
            assert all((x == y).all() for x, y in zip(parts[0], whole, strict=True))


def expected(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in infill.MARKERS) or h3 % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, t)
    if h4 % 100 < 20:
        return (doc_id, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return (doc_id, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


def run(docs, **how):
    h1, h2, h3, h4 = infill.draws(docs["doc_id"])
    done = infill.fill_in_middle(docs, h1, h2, h3 % 100 >= 90, h4 % 100 < 20, **how)
    return done.withColumn("restored", infill.restore(F.col("infill.output"), F.col("infill.form")))


@pytest.mark.parametrize("chunk", [infill.CHUNK_BYTES, 700])
def test_fill_in_middle(spark, chunk):
    docs = documents(spark, [*TEXTS, *TEXTS, "plain words " * 500, *["copy é" * 300] * 12])
    docs = docs.union(docs.limit(0)).union(spark.createDataFrame([(None, "no id", *[None] * 18)], docs.schema).select(*docs.columns))
    rows = docs.collect()
    got = run(docs, chunk_bytes=chunk).collect()
    key = lambda x: (str(x[0]), x[-1])
    want = sorted((expected(r.doc_id, r.text) for r in rows), key=key)
    assert sorted(((r.doc_id, r.infill.n, r.infill.form, r.infill.prefix_units, r.infill.middle_units, r.infill.output) for r in got), key=key) == want
    assert sorted(r.restored for r in got) == sorted(r.text or "" for r in rows)
    assert set(got[0].asDict()) == {*docs.columns, "infill", "restored"}


def test_words_and_lines_of_long_texts(spark):
    texts = ["ä b\n c" * 400, "\n" * 300 + "日 " * 200, "w" * 1000, " x" * 600]
    docs = documents(spark, texts, repeat=False)
    for units in ("words", "lines"):
        for chunk in (64, infill.CHUNK_BYTES):
            for r in run(docs, units=units, chunk_bytes=chunk).collect():
                assert r.restored == r.text and r.infill.n == len(SPLIT[units](r.text))
                if r.infill.form != "plain":
                    assert len(SPLIT[units](r.infill.prefix)) == r.infill.prefix_units


def test_empty_table_and_null_draws(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(empty).count() == 0
    none = F.lit(None)
    one = documents(spark, ["abc"], repeat=False)
    row = infill.fill_in_middle(one, none, none, none, none).first()
    assert (row.infill.form, row.infill.output) == ("psm", "<P><S>abc<M>")


@pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")
def test_same_rows_as_sql(spark):
    agrees(spark, queries.QUERIES["op11_fill_in_middle"], queries.ORACLES["op11_fill_in_middle"])
