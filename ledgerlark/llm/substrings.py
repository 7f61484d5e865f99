"""Removal of repeated long substrings: threshold-bounded backward extension over right-sorted contexts."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import partitions
from ledgerlark.llm.shingles import BYTE_VALUE, ODD, mix, slices

LENGTH = 400
#: Bytes of an anchor; each string of LENGTH bytes has one that its content alone decides.
ANCHOR = 32
#: Contexts that are extended together, unless one anchor has more.
CONTEXTS = 20_000
SALT = mix(np.array([77], np.uint64))[0]

OCCURRENCE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("at", "<i4"), ("first", "<i4"), ("last", "<i4")])
COVER = np.dtype([("doc", "<i8"), ("hash", "<i8"), ("start", "<i4"), ("end", "<i4")])


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = pow(int(ODD), -1, 1 << 64)
    up, down = np.full(1 << bits, ODD, np.uint64), np.full(1 << bits, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def anchors(texts: list[bytes], length: int = LENGTH, width: int = ANCHOR):
    """(text, at, first, last, key): the anchors of each text and the first and last start of the strings that choose them.

    A string of ``length`` bytes chooses the place in it whose ``width`` bytes have the least hash, the first of equals.
    So equal strings choose the same place, wherever they are.
    """
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    n, span = len(joined), length - width + 1
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    up, down = _powers(max(21, int(n).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[joined] * up[:n])])
    count = n - width + 1
    keys = mix((sums[width:] - sums[:count]) * down[:count])
    bits = np.uint64(int(n).bit_length())
    ranked = ((keys >> bits) << bits) | np.arange(count, dtype=np.uint64)
    padded = np.full(-(-count // span) * span + span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:count] = ranked
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(ends, np.arange(starts), "right")
    valid = np.arange(starts) + length <= ends[np.minimum(text, len(ends) - 1)]
    s = np.flatnonzero(valid)
    if not len(s):
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    chosen, text = chosen[s], text[s]
    head = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    tail = np.append(head[1:], len(s)) - 1
    text, at = text[head], chosen[head]
    offset = np.concatenate([[0], ends])[text]
    return text, at - offset, s[head] - offset, s[tail] - offset, keys[at]


def repeated_starts(key, left, left_len, right, least, length: int = LENGTH):
    """Which strings around an anchor occur twice: a matrix over (context, bytes of the string left of the anchor).

    ``right`` holds the bytes from the anchor on and ``left`` those before it, backwards; a context's strings take ``least``
    to ``left_len`` bytes from the left. The contexts are sorted by what is right of them, so the byte before each is
    the column of a Burrows-Wheeler transform, and rows that share a right prefix are an interval. Breadth first, all
    intervals are extended backward by one byte a step; strings with t bytes on the left need a common right prefix
    of length - t. Intervals of one row are dropped, and nothing is extended beyond what the minimum length asks.
    """
    words = np.ascontiguousarray(np.pad(right, ((0, 0), (0, -right.shape[1] % 8)))).view(">u8")
    order = np.lexsort([*words.T[::-1], key])
    key, left, left_len, right, least = key[order], left[order], left_len[order], right[order], least[order]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
    common = np.concatenate([[-1], np.where(key[1:] == key[:-1], common, -1)])
    found = np.zeros((len(key), left.shape[1] + 1), bool)
    rows = np.arange(len(key))
    group = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]])).astype(np.int64)
    for t in range(left.shape[1] + 1):
        if t:
            rows, group = rows[left_len[rows] >= t], group[left_len[rows] >= t]
            group = group * 256 + left[rows, t - 1]
        if not len(rows):
            break
        _, group, size = np.unique(group, return_inverse=True, return_counts=True)
        more = size[group] > 1
        rows, group = rows[more], group[more]
        interval = np.cumsum(common < length - t)
        here = least[rows] <= t
        both = group[here] * (len(key) + 1) + interval[rows[here]]
        _, where, size = np.unique(both, return_inverse=True, return_counts=True)
        found[rows[here][size[where] > 1], t] = True
    out = np.zeros_like(found)
    out[order] = found
    return out


def _by_target(rec: np.ndarray, target: np.ndarray, buckets: int):
    order = np.argsort(target, kind="stable")
    bounds = np.searchsorted(target[order], np.arange(buckets + 1))
    rec = rec[order]
    full = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
    return [pa.array(full, pa.int32()), pa.array([rec[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary())]


def _of_doc(rec: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(rec["doc"].astype(np.uint64) ^ mix(rec["hash"].astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _by_doc(batches, dtype: np.dtype):
    """One row (doc, hash, packed records) per document."""
    found = [np.frombuffer(x, dtype) for b in batches for x in b.column(1).to_pylist()]
    if found:
        rec = np.concatenate(found)
        rec = rec[np.lexsort((rec["hash"], rec["doc"]))]
        at = np.flatnonzero(np.concatenate([[True], (rec["doc"][1:] != rec["doc"][:-1]) | (rec["hash"][1:] != rec["hash"][:-1])]))
        ends = np.append(at[1:], len(rec))
        for x in range(0, len(at), 4096):
            packed = [rec[a:b].tobytes() for a, b in zip(at[x : x + 4096], ends[x : x + 4096], strict=True)]
            heads = rec[at[x : x + 4096]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(heads["doc"])), pa.array(np.ascontiguousarray(heads["hash"])), pa.array(packed, pa.binary())],
                ["_doc", "_hash", "packed"],
            )


def _find_anchors(buckets: int, length: int, width: int):
    def run(batches):
        for batch in batches:
            docs, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for x, y in slices(texts):
                text, at, first, last, key = anchors(texts[x:y], length, width)
                rec = np.empty(len(at), OCCURRENCE)
                rec["key"], rec["doc"], rec["hash"] = key, docs[x:y][text], hashes[x:y][text]
                rec["at"], rec["first"], rec["last"] = at, first, last
                yield pa.RecordBatch.from_arrays(_by_target(rec, (key % np.uint64(buckets)).astype(np.int64), buckets), ["bucket", "packed"])

    return run


def _repeated_anchors(buckets: int):
    def run(batches):
        found = [np.frombuffer(x, OCCURRENCE) for b in batches for x in b.column(1).to_pylist()]
        if found:
            rec = np.concatenate(found)
            _, where, size = np.unique(rec["key"], return_inverse=True, return_counts=True)
            rec = rec[size[where] > 1]
            # Repeated rows give equal records; they meet again as rows.
            yield pa.RecordBatch.from_arrays(_by_target(np.unique(rec), _of_doc(np.unique(rec), buckets), buckets), ["bucket", "packed"])

    return run


def _contexts(buckets: int, length: int):
    """Contexts of repeated anchors by bucket; of equal ones in a batch, one, and the others are covered at once."""

    def run(batches):
        for batch in batches:
            texts, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y in slices(texts, 1 << 20):
                seen: dict[bytes, int] = {}
                out, blobs, covers = [], [], []

                def cover(r, covers=covers):
                    covers.append((r["doc"], r["hash"], r["first"], r["last"] + length))

                for text, raw in zip(texts[x:y], packed[x:y], strict=True):
                    for r in np.frombuffer(raw, OCCURRENCE):
                        blob = text[r["first"] : r["last"] + length]
                        name = hashlib.blake2b(blob + int(r["at"] - r["first"]).to_bytes(4, "little"), digest_size=16).digest()
                        if name not in seen:
                            seen[name] = len(out)
                            out.append(r)
                            blobs.append(blob)
                            continue
                        if seen[name] >= 0:
                            cover(out[seen[name]])
                            seen[name] = -1
                        cover(r)
                if covers:
                    rec = np.array(covers, COVER)
                    t, p = _by_target(rec, _of_doc(rec, buckets), buckets)
                    yield pa.RecordBatch.from_arrays([pa.array([True] * len(t)), t, p, pa.array([b""] * len(t), pa.binary())], ["cover", "bucket", "packed", "bytes"])
                rec = np.array(out, OCCURRENCE)
                target = (rec["key"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                t, p = _by_target(rec, target, buckets)
                bounds = np.searchsorted(target[order], np.arange(buckets + 1))
                joined = [b"".join([blobs[i] for i in order[bounds[b] : bounds[b + 1]]]) for b in t.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([False] * len(t)), t, p, pa.array(joined, pa.binary())], ["cover", "bucket", "packed", "bytes"])

    return run


def _extend(buckets: int, length: int, width: int):
    """Covered stretches of the contexts of each bucket."""

    def emit(rec):
        return pa.RecordBatch.from_arrays(_by_target(rec, _of_doc(rec, buckets), buckets), ["bucket", "packed"])

    def run(batches):
        recs, blobs = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["cover"]:
                    yield emit(np.frombuffer(row["packed"], COVER))
                else:
                    recs.append(np.frombuffer(row["packed"], OCCURRENCE))
                    blobs.append(np.frombuffer(row["bytes"], np.uint8))
        if not recs:
            return
        rec, data = np.concatenate(recs), np.concatenate(blobs)
        sizes = rec["last"].astype(np.int64) + length - rec["first"]
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(rec["key"], kind="stable")
        keys = rec["key"][order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(heads[1:], len(keys))
        x = 0
        reach = length - width
        while x < len(heads):
            y = max(x + 1, int(np.searchsorted(heads, heads[x] + CONTEXTS)))
            part = order[heads[x] : ends[min(y, len(ends)) - 1]]
            x = y
            r = rec[part]
            left_len, least = (r["at"] - r["first"]).astype(np.int64), (r["at"] - r["last"]).astype(np.int64)
            at = starts[part] + left_len
            steps = np.arange(reach)[None, :]
            left = np.where(steps < left_len[:, None], data[np.maximum(at[:, None] - 1 - steps, 0)], 0).astype(np.uint8)
            steps = np.arange(length)[None, :]
            inside = steps < (sizes[part] - left_len)[:, None]
            right = np.where(inside, data[np.minimum(at[:, None] + steps, len(data) - 1)], 0).astype(np.uint8)
            found = repeated_starts(r["key"], left, left_len, right, least, length)
            edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            out = np.empty(len(row), COVER)
            out["doc"], out["hash"] = r["doc"][row], r["hash"][row]
            out["start"], out["end"] = r["at"][row] - (high - 1), r["at"][row] - low + length
            if len(out):
                yield emit(out)

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, width: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Removes each byte that is covered by a string of ``length`` bytes which also starts anywhere else in any text, this
    one included; what repeats is judged on the input. Every such string chooses an anchor by its content, so all its
    occurrences meet in one bucket: anchors that occur once are dropped, the bytes around the others are sent to
    their buckets, and backward extension there finds which strings repeat (``repeated_starts``). Equal contexts of one
    batch are sent once.

    Null and empty texts have no bytes. Texts shorter than ``length`` lose nothing. Repeated rows repeat each other. An
    empty table gives no rows; other columns are ignored. A text has to fit a task's memory.
    """
    buckets = partitions(docs)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    packed = "bucket int, packed binary"
    by_doc = "_doc bigint, _hash bigint, packed binary"
    once = rows.select("_doc", "_hash", "text").mapInArrow(_find_anchors(buckets, length, width), packed).repartitionById(buckets, "bucket")
    twice = once.mapInArrow(_repeated_anchors(buckets), packed).repartitionById(buckets, "bucket")
    twice = twice.mapInArrow(lambda it: _by_doc(it, OCCURRENCE), by_doc)
    near = rows.join(twice, ["_doc", "_hash"]).select("text", "packed")
    near = near.mapInArrow(_contexts(buckets, length), "cover boolean, bucket int, packed binary, bytes binary").repartitionById(buckets, "bucket")
    covers = near.mapInArrow(_extend(buckets, length, width), packed).repartitionById(buckets, "bucket")
    covers = covers.mapInArrow(lambda it: _by_doc(it, COVER), by_doc)
    return rows.join(covers, ["_doc", "_hash"], "left").select("doc_id", "text", "packed").mapInArrow(
        _cut_out, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches covered by [start, end); touching ones are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _cut_out(batches):
    for batch in batches:
        done = []
        for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if packed is None:
                done.append((len(text), 0, 0, text))
                continue
            rec = np.frombuffer(packed, COVER)
            gone = spans(rec["start"], rec["end"])
            edges = [0, *(e for span in gone for e in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            done.append((len(text), len(text) - len(kept), len(gone), kept))
        n, removed, count, kept = zip(*done) if done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, count)), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )
