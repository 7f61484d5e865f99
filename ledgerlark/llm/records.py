"""Token ids as length-delimited binary records in ascending order of identifiers, with an offset index beside them.

A record is, little-endian: 8 bytes with the payload's length, 4 bytes with the masked CRC-32 of those 8, the payload, 4 bytes with its
masked CRC-32, and a line feed. A payload is one byte of flags, 8 bytes with the identifier and the ids with 2 or 4 bytes each. Masking
keeps the checksum of data that holds checksums from being a fixed value: rotated right by 15 bits, plus a constant.

Spark writes and reads the files itself (its text writer puts out the bytes of a value and a line feed), so any file system that Spark
knows will do, tasks that are lost or run twice leave nothing behind, and no worker opens a path.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.shingles import slices

#: About so many bytes of text go to one file; a file is read as one value.
TEXT_BYTES = 24 << 20
#: Texts that are worked on at a time.
SLICE_BYTES = 4 << 20
#: Words in the newer half of a worker's cache; at most twice as many are kept, some 60 MB.
CACHE_WORDS, CACHE_BYTES = 150_000, 60
#: New words that are encoded as one text.
JOINED_WORDS = 500
#: Words of which each is one word to the tokenizer too, whatever stands beside it.
ONE_WORD = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
MASK_DELTA = 0xA282EAD8
HEAD, CHECK, PAYLOAD = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")
HAS_ID, WIDE = 1, 2
#: Null identifiers come first, where this one would.
LEAST = -(1 << 63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """A record without its line feed; ``ids`` are little-endian."""
    payload = PAYLOAD.pack((doc_id is not None) * HAS_ID | wide * WIDE, doc_id or 0) + ids
    length = len(payload).to_bytes(8, "little")
    return length + CHECK.pack(masked(length)) + payload + CHECK.pack(masked(payload))


class BadRecord(ValueError):
    pass


def frames(content: bytes | memoryview, name: str = "", at: int = 0):
    """(offset, size) of each record's payload; lengths are held against their checksums."""
    while at < len(content):
        head = bytes(content[at : at + HEAD.size])
        if len(head) < HEAD.size:
            raise BadRecord(f"{name}: cut off at {at}")
        length, check = HEAD.unpack(head)
        end = at + HEAD.size + length + CHECK.size
        if masked(head[:8]) != check or content[end : end + 1] != b"\n":
            raise BadRecord(f"{name}: no record at {at}")
        yield at, length
        at = end + 1


def payload(content: bytes | memoryview, at: int, length: int, name: str = "") -> tuple[int | None, np.ndarray]:
    """Identifier and ids of the record at ``at``, held against its checksum."""
    start = at + HEAD.size
    data = bytes(content[start : start + length])
    if content[start + length : start + length + CHECK.size] != CHECK.pack(masked(data)):
        raise BadRecord(f"{name}: the record at {at} differs from its checksum")
    flags, doc_id = PAYLOAD.unpack_from(data)
    ids = np.frombuffer(data, "<u4" if flags & WIDE else "<u2", offset=PAYLOAD.size)
    return doc_id if flags & HAS_ID else None, ids


class WordEncoder:
    """The tokenizers library on the distinct words of many texts.

    For tokenizers that lower-case and drop white space, what stands between ASCII spaces is encoded on its own, as is ASCII
    punctuation after an ASCII letter, and A-Z as a-z. Texts that hold an added token in any case are encoded whole, as are
    all texts where a probe shows that the tokenizer isn't of this kind.
    """

    PROBE = ("Aa.bB, c\tD!", ("aa", ".", "bb", ",", "c", "d", "!"))

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u4" if self.size > 1 << 16 else "<u2")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        text, parts = self.PROBE
        self.by_word = self.spell([text])[0] == b"".join(self.spell(list(parts)))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True

    def spell(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def spell_words(self, words: list[str]) -> list[bytes]:
        """Ids of words; those of letters only are encoded many at a time and told apart by the tokens that end words."""
        out = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if ONE_WORD.fullmatch(w)] if self.ends.any() else []
        texts = [" ".join([words[i] for i in plain[k : k + JOINED_WORDS]]) for k in range(0, len(plain), JOINED_WORDS)]
        done = 0
        for e in self.library.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, self.kind)
            starts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                out[plain[done]] = ids[a:b].tobytes()
                done += 1
        rest = sorted({*range(len(words))}.difference(plain))
        for i, ids in zip(rest, self.spell([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def words(self, found: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        out = [self.known.get(w) for w in found]
        missing = [i for i, x in enumerate(out) if x is None]
        fresh = []
        for i in missing:
            out[i] = self.older.get(found[i])
            if out[i] is None:
                fresh.append(i)
        for i, ids in zip(fresh, self.spell_words([found[i] for i in fresh]), strict=True):
            out[i] = ids
        for i in missing:
            if len(found[i]) <= CACHE_BYTES:
                if len(self.known) >= CACHE_WORDS:
                    self.known, self.older = {}, self.known
                self.known[found[i]] = out[i]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text of a string array without nulls."""
        if not self.by_word:
            return self.spell(texts.to_pylist())
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        if whole.any():
            for i, ids in zip(np.flatnonzero(whole).tolist(), self.spell(texts.filter(pa.array(whole)).to_pylist()), strict=True):
                out[i] = ids
            texts = texts.filter(pa.array(~whole))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([.,!?;:])", r"\1 \2"))
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        spelt = self.words(words.dictionary.to_pylist())
        lengths = np.array([len(s) for s in spelt], np.int64) // self.kind.itemsize
        ids = np.frombuffer(b"".join(spelt), self.kind)
        at = words.indices.to_numpy()
        sizes = lengths[at]
        ends = np.cumsum(sizes)
        starts = (np.cumsum(lengths) - lengths)[at]
        total = int(ends[-1]) if len(ends) else 0
        found = ids[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)] if total else ids[:0]
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        for i, a, b in zip(np.flatnonzero(~whole).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = found[a:b].tobytes()
        return out


@lru_cache(maxsize=1)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def file_of(keys: np.ndarray, crcs: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The file of each row: by its key among the cuts, and where cuts equal the key, by its checksum among the files they part."""
    low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
    return low + ((high - low + 1) * crcs >> 32)


def framed(docs: DataFrame, path: str, end_id: int | None, cuts: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(file, key, tie, frame) of each row."""
    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))

    def run(batches):
        encoder = load(path)
        end = b"" if end_id is None else end_id.to_bytes(encoder.kind.itemsize, "little")
        wide = encoder.kind.itemsize == 4
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for i, j in slices([range(n) for n in sizes], SLICE_BYTES):
                part = batch.slice(i, j - i)
                doc_ids = part.column(0).to_pylist()
                made = [frame(d, ids + end, wide) for d, ids in zip(doc_ids, encoder.encode(part.column(1)), strict=True)]
                keys = np.array([LEAST if d is None else d for d in doc_ids], np.int64)
                ties = np.array([zlib.crc32(x) for x in made], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file_of(keys, ties, cuts), pa.int32()), pa.array(keys), pa.array(ties), pa.array(made, pa.binary())],
                    ["file", "key", "tie", "frame"],
                )
        pa.default_memory_pool().release_unused()  # a worker may wait for long

    return rows.mapInArrow(run, "file int, key bigint, tie bigint, frame binary")


def file_cuts(docs: DataFrame, id_col: str, text_col: str, text_bytes: int) -> np.ndarray:
    """Identifiers that part the rows into files of about equal numbers of rows: one number per file but the last."""
    key = F.coalesce(docs[f"`{id_col}`"].cast("bigint"), F.lit(LEAST))
    total = docs.agg(F.sum(F.octet_length(docs[f"`{text_col}`"]) + 1)).first()[0] or 0
    files = max(1, -(-total // text_bytes))
    if files == 1:
        return np.empty(0, np.int64)
    shares = F.array(*[F.lit(k / files) for k in range(1, files)])
    return np.array(docs.agg(F.percentile_approx(key, shares, F.lit(20 * files))).first()[0], np.int64)


def write_records(
    docs: DataFrame, folder: str, path: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = TEXT_BYTES
) -> None:
    """Writes the token ids of each whole text to ``folder``/records, and ``folder``/index with each record's place.

    ``path`` is a file of the tokenizers library that every executor has; special tokens aren't added, but ``end_id`` is
    after each text. Null and empty texts have no ids but that one. Files and the records in them ascend by identifier, null
    identifiers first; rows that share an identifier go by a checksum and then by content, over several files where they
    are many, and none are dropped. Other columns are left out, whatever their names. An empty table gives no record.

    The driver holds one identifier per file. The index is made from the files that were committed, by following lengths.
    """
    spark = docs.sparkSession
    cuts = file_cuts(docs, id_col, text_col, text_bytes)
    rows = framed(docs, path, end_id, cuts, id_col, text_col).repartitionById(len(cuts) + 1, F.col("file"))
    rows = rows.sortWithinPartitions("key", "tie", "frame").select(F.col("frame").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").text(f"{folder}/records")
    walked = record_files(spark, folder).mapInArrow(walk, "file int, record bigint, doc_id bigint, offset bigint, size bigint, n_ids bigint, before bigint")
    walked.write.parquet(f"{folder}/index")


def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content); a file's number is its place in the order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records")
    return files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("file"), "content")


def walk(batches):
    """The place of each record, without looking at ids."""
    for batch in batches:
        for row in range(batch.num_rows):
            file = batch.column(0)[row].as_py()
            content = memoryview(batch.column(1)[row].as_buffer()).cast("B")
            found = list(frames(content, str(file)))
            if found:
                flags, doc_ids = zip(*[PAYLOAD.unpack_from(content, at + HEAD.size) for at, _ in found], strict=True)
                sizes = np.array([n for _, n in found], np.int64)
                n_ids = (sizes - PAYLOAD.size) // np.where(np.array(flags) & WIDE, 4, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), file, np.int32)), pa.array(np.arange(len(found))),
                     pa.array([d if f & HAS_ID else None for f, d in zip(flags, doc_ids, strict=True)], pa.int64()),
                     pa.array([at for at, _ in found], pa.int64()), pa.array(sizes), pa.array(n_ids), pa.array(np.cumsum(n_ids) - n_ids)],
                    ["file", "record", "doc_id", "offset", "size", "n_ids", "before"],
                )


def file_starts(index: DataFrame) -> DataFrame:
    """(file, ahead): ids in all files before each. It has one row per file, and is sorted by one task."""
    files = index.groupBy("file").agg(F.sum("n_ids").alias("all"))
    return files.select("file", (F.sum("all").over(Window.orderBy("file")) - F.col("all")).alias("ahead"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(file, record, doc_id, offset, size, n_ids, before, start): each record's place, and the ids before it in its file and in all."""
    index = spark.read.parquet(f"{folder}/index")
    return index.join(F.broadcast(file_starts(index)), "file").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead")


def read_records(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(file, record, doc_id, before, ids) of each record, or of those that ``wanted`` (file, record and more) asks for.

    ``ids`` are bytes, four to an id, little-endian; ``before`` counts the ids before it in its file. Each record is held
    against its checksums. With ``wanted``, in any order that the caller gives to its rows by a column of its own, the index says
    where the records are; a file's wanted offsets are gathered, which are as many as it has records. Columns of ``wanted`` are kept.
    """
    schema = "file int, record bigint, doc_id bigint, before bigint, ids binary"
    if wanted is None:
        return record_files(spark, folder).mapInArrow(read_all, schema)
    index = spark.read.parquet(f"{folder}/index")
    places = wanted.select("file", "record").distinct().join(index.select("file", "record", "offset", "size", "before"), ["file", "record"])
    places = places.groupBy("file").agg(F.collect_list(F.struct("record", "offset", "size", "before")).alias("places"))
    found = record_files(spark, folder).join(places, "file").mapInArrow(read_places, schema)
    return wanted.join(found, ["file", "record"])


def record_batches(file: int, content: memoryview, places):
    """Batches of the records at ``places`` (record, offset, size, ids before it)."""
    for i, j in slices([range(p[2]) for p in places], SLICE_BYTES):
        here = places[i:j]
        read = [payload(content, at, size, str(file)) for _, at, size, _ in here]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(read), file, np.int32)), pa.array([p[0] for p in here], pa.int64()), pa.array([d for d, _ in read], pa.int64()),
             pa.array([p[3] for p in here], pa.int64()), pa.array([ids.astype("<u4").tobytes() for _, ids in read], pa.binary())],
            ["file", "record", "doc_id", "before", "ids"],
        )


def read_all(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            content = memoryview(batch.column(1)[row].as_buffer()).cast("B")
            file, before = batch.column(0)[row].as_py(), 0
            places = []
            for i, (at, size) in enumerate(frames(content, str(file))):
                places.append((i, at, size, before))
                before += (size - PAYLOAD.size) // (4 if content[at + HEAD.size] & WIDE else 2)
            yield from record_batches(file, content, places)
    pa.default_memory_pool().release_unused()


def read_places(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            places = [(p["record"], p["offset"], p["size"], p["before"]) for p in batch.column(2)[row].as_py()]
            yield from record_batches(batch.column(0)[row].as_py(), memoryview(batch.column(1)[row].as_buffer()).cast("B"), places)
