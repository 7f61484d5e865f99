import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import queries, records
from ledgerlark.llm.common import shared_folder
from tests.helpers import HAVE_DATA, SF
from tests.llm.fixtures import SCHEMA, documents
from tests.llm.test_texts import TOKENIZER

NASTY = ["<|endoftext|> A. b", "<|ENDOFTEXT|>", "Ends. With.dots.and,commas;here!", "it's. 'S 've", "ΣΑΣ. İstanbul, ǅ!", "é. é.", "a\x0bb\x1cc\x85d\xa0e", "x.'s y?!", "\n\n", "日本。😀!", "word" * 9000, "A" * 70 + ". tail"]


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(TOKENIZER)
    found.no_padding()
    found.no_truncation()
    return found


def encoded(text, end=True):
    return library().encode(text or "", add_special_tokens=False).ids + [1] * end


def test_words_encode_like_whole_texts():
    encoder = records.WordEncoder(TOKENIZER)
    texts = [*NASTY, *[" ".join(NASTY[i:] + NASTY[:i]) for i in range(len(NASTY))], ""]
    for _ in range(2):  # the second time from the cache
        got = encoder.encode(pa.array(["skipped", *texts])[1:])
        assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [encoded(t, False) for t in texts]


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(records, "CACHE_WORDS", 5)
    encoder = records.WordEncoder(TOKENIZER)
    texts = [f"w{i} w{i % 3} q{i // 2}" for i in range(40)]
    for t in texts:
        assert np.frombuffer(encoder.encode(pa.array([t]))[0], encoder.kind).tolist() == encoded(t, False)
        assert len(encoder.known) <= 5 and len(encoder.older) <= 5


def test_frames_are_checked():
    content = records.frame(7, b"\x01\x00\x02\x00", False) + b"\n" + records.frame(None, b"\x01\x00\x00\x00", True) + b"\n"
    (a, n), (b, m) = records.frames(content)
    assert records.payload(content, a, n)[0] == 7 and records.payload(content, a, n)[1].tolist() == [1, 2]
    assert records.payload(content, b, m)[0] is None and records.payload(content, b, m)[1].tolist() == [1]
    crc = zlib.crc32(content[:8])
    assert struct.unpack("<I", content[8:12])[0] == ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) % 2**32
    for k in range(len(content)):
        bad = bytearray(content)
        bad[k] ^= 4
        with pytest.raises(records.BadRecord):
            for at, size in records.frames(bytes(bad)):
                records.payload(bytes(bad), at, size)
    with pytest.raises(records.BadRecord):
        list(records.frames(content[:-3]))


def test_rows_of_one_identifier_spread_over_files():
    cuts = np.array([5, 5, 5, 9], np.int64)
    crcs = np.array([0, 1 << 31, (1 << 32) - 1] * 3, np.int64)
    found = records.file_of(np.array([4, 4, 4, 5, 5, 5, 10, 10, 10], np.int64), crcs, cuts)
    assert found.tolist() == [0, 0, 0, 0, 2, 3, 4, 4, 4]


def read(spark, folder):
    rows = records.read_records(spark, folder).orderBy("file", "record").collect()
    return [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]


@pytest.mark.parametrize("text_bytes", [1 << 30, 20_000])
def test_round_trip(spark, text_bytes):
    docs = documents(spark)
    more = documents(spark, [*NASTY, None], repeat=False).withColumns({"doc_id": F.lit(3).cast("long")})
    nulls = documents(spark, ["no id", "no id", None], repeat=False).withColumns({"doc_id": F.lit(None).cast("long")})
    docs = docs.union(more.select(*docs.columns)).union(nulls.select(*docs.columns))
    folder = shared_folder(spark, "records")
    records.write_records(docs, folder, TOKENIZER, end_id=1, text_bytes=text_bytes)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), encoded(r.text)) for r in docs.select("doc_id", "text").collect())
    got = read(spark, folder)
    assert sorted(((d is not None, d or 0), ids) for d, ids in got) == want
    assert [(d is not None, d or 0) for d, _ in got] == [d for d, _ in want]  # ascending over all files
    index = records.read_index(spark, folder).orderBy("file", "record").collect()
    assert len({r.file for r in index}) == (1 if text_bytes == 1 << 30 else len({r.file for r in index})) and (text_bytes > 1 << 20 or len({r.file for r in index}) > 2)
    starts = np.cumsum([0, *[len(ids) for _, ids in got]])
    assert [r.start for r in index] == starts[:-1].tolist()
    # A shuffled read gives what its index says.
    asked = records.read_index(spark, folder).filter("record % 3 = 1").select("file", "record", "start", F.xxhash64("file", "record").alias("turn"))
    found = records.read_records(spark, folder, asked).orderBy("turn").collect()
    at = {s: ids for s, (_, ids) in zip(starts.tolist(), got, strict=False)}
    assert len(found) == asked.count() > 0 and all(np.frombuffer(r.ids, "<u4").tolist() == at[r.start] for r in found)


def test_empty_table(spark):
    folder = shared_folder(spark, "records")
    records.write_records(spark.createDataFrame([], SCHEMA), folder, TOKENIZER, end_id=1)
    assert records.read_records(spark, folder).count() == 0 and records.read_index(spark, folder).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")
def test_query_against_the_library(spark):
    docs = sorted((r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect())
    want, start = [], 0
    for (doc_id, _), e in zip(docs, library().encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True):
        ids = [*e.ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op13_record_files"](spark, SF).collect())) == want
