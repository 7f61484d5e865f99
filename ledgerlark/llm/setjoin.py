"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole (Deng et al. 2015, adapted)."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import TASK_ROWS, cut, look_up, partitions
from ledgerlark.llm.components import components
from ledgerlark.llm.shingles import SHINGLE_WORDS, Slice, mix, overlap, shingle_slice, slices

#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
#: Signatures of up to LIGHT different sets give all their pairs; larger groups are compared with HUBS sets first.
LIGHT, HUBS = 32, 1
#: Pairs that are compared at a time.
PAIR_ROWS = 1000
#: Sets that one task takes.
SET_ROWS = 4000
#: The second level's segments have at least so many elements.
DEEP_LEAST = 2
#: Signatures that hidden sets may meet are told by a filter of 2**FILTER_BITS bits (16 MB), whatever the input's size.
FILTER_BITS, FILTER_CHUNK = 27, 1 << 15
#: What is then still apart is compared in blocks of so many sets and so many queries.
BLOCK_SETS, BLOCK_QUERIES = 2000, 500
#: What a stored signature has to leave over, as a factor of what the guarantee needs.
SLACK = 1.25
#: For the cost of an allocation: how likely a shingle of one set is in another one, and a false pair against an entry.
SHARE, PAIR_COST = 1e-3, 1.0
SIG_BYTES = 4
FREE = 1 << 30
K = [mix(np.array([i], np.uint64))[0] for i in range(11, 19)]

FOUND = np.dtype([("kind", "u1"), ("a", "<i8"), ("b", "<i8"), ("n", "<i4"), ("qa", "<i4"), ("qb", "<i4")])
PAIR, STAR, HEAVY = 0, 1, 2


@dataclass(frozen=True)
class Threshold:
    num: int = NUMERATOR
    den: int = DENOMINATOR

    def differ(self, sizes):
        """Most elements in which two similar sets with sizes that add to ``sizes`` differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def bands(self, top: int = 1 << 40) -> np.ndarray:
        """First sizes of the bands: a similar set is in the same band or the next."""
        out = [1]
        while out[-1] < top:
            out.append(max(out[-1] + 1, -(-out[-1] * self.den // self.num)))
        return np.array(out, np.int64)


def allocate(lo: int, hi: int, population: int, t: Threshold, *, deep: bool = False) -> tuple[int, int]:
    """For sizes lo to hi - 1: the number of segments, and how many of them carry one-deletion neighbourhoods.

    A filled segment tells of one difference, one with its neighbourhood (and two elements or more) of two. Among the
    choices whose sum is expected to exceed what similar sets can differ in, takes the one that costs least: entries to
    store, and false pairs, which grow with the band's population and shrink with a segment's elements. ``deep`` leaves only
    the choices with few long segments that all carry neighbourhoods.
    """
    wide = (hi - 1) * t.den // t.num
    best, least = None, DEEP_LEAST if deep else 1
    need_own, need_next = int(t.differ(2 * (hi - 1))) + 1, int(t.differ(wide + hi - 1)) + 1
    for factor in (0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.35, 1.5, 1.75, 2.0, 2.5, 3.0):
        m = max(1, math.ceil(need_own * factor))
        for d in [m] if deep else sorted({0, m // 4, m // 2, 3 * m // 4, m}):

            def sums(n, m=m, d=d):
                """What the segments tell and the entries they make, expected for n elements."""
                p = [math.comb(n, w) * (1 / m) ** w * (1 - 1 / m) ** (n - w) for w in range(min(n, least) + 1)]
                short, held = sum(p[:least]), n / m - sum(w * x for w, x in enumerate(p))
                return (m - d) * (1 - short) + d * (1 - short + 1 - sum(p)), m * (1 - short) + d * max(0.0, held)

            if any(sums(n)[0] < need * (SLACK if need > 3 else 1) for n, need in ((hi - 1, need_own), (wide, need_next))):
                continue
            n = (lo + hi - 1) / 2
            pairs = (m - d) * SHARE ** (n / m) + d * (n / m + 1) * SHARE ** max(n / m - 1, 0.5)
            cost = sums((lo + hi - 1) // 2)[1] + PAIR_COST * population * pairs
            if best is None or cost < best[0]:
                best = cost, m, d
    return (best[1], best[2]) if best else (4 * hi, 0)


def signatures(sets: Slice, chosen: np.ndarray, m: np.ndarray, d: np.ndarray, salt: np.ndarray, least: int = 1):
    """(signatures, owners, weights): ``weights`` sums per set what its segments can tell. m = 0: one segment per element.

    Segments with fewer elements than ``least`` are left out.
    """
    sizes = np.where(chosen, sets.sizes, 0)
    owner = np.repeat(np.arange(len(sizes)), sets.sizes)
    use = chosen[owner]
    owner, h = owner[use], sets.hashes[use]
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
    mm = m[owner].astype(np.uint64)
    seg = np.where(mm > 0, ((h >> np.uint64(32)) * mm) >> np.uint64(32), h)
    head = np.ones(len(h), bool)
    head[1:] = (seg[1:] != seg[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(head)
    value = mix(h ^ K[0])
    total = np.add.reduceat(value, at)
    width = np.diff(np.append(at, len(h)))
    name = mix(seg[at] ^ K[1]) + salt[owner[at]]
    used = (width >= least) | (mm[at] == 0)
    sigs, owners = [mix(total + name)[used]], [owner[at][used]]
    lower = (seg[at] < d[owner[at]].astype(np.uint64)) & (mm[at] > 0) & (width > least)
    weights = np.bincount(owner[at], weights=used.astype(int) + lower, minlength=len(sizes)).astype(np.int64)
    if lower.any():
        group = np.repeat(np.arange(len(at)), width)
        member = lower[group]
        sigs.append(mix(total[group[member]] - value[member] + name[group[member]]))
        owners.append(owner[member])
    return np.concatenate(sigs), np.concatenate(owners), weights


def digest(sets: Slice, salt: np.uint64) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.hashes ^ salt))])
    return mix(total[sets.starts[1:]] - total[sets.starts[:-1]] + sets.sizes.astype(np.uint64) * salt)


def entries(sets: Slice, ids: np.ndarray, plan: dict[int, tuple[int, int]], edges: np.ndarray, t: Threshold, buckets: int, least: int = 1, only: np.ndarray | None = None):
    """Rows (bucket, signatures, references, and per reference id, class, quota and role) of one slice of sets.

    A set enters its own band (role 0) and, if a set of the band below can be similar, that one too (role 1).
    ``quota`` is the least number of its signatures that a similar smaller set shares. A set that may share none
    enters once more with each element as a segment.
    """
    n = sets.sizes
    band = np.searchsorted(edges, n, "right") - 1
    ms, ds = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64)
    for k, (m, d) in plan.items():
        ms[k], ds[k] = m, d
    cls = digest(sets, K[2])
    parts = []
    for role in (0, 1):
        key = band - role
        below = edges[np.maximum(band, 0)] - 1  # the largest size in the band below
        chosen = (n > 0) & (key >= 0) & ((role == 0) | (below * t.den >= n * t.num))
        key = np.maximum(key, 0)
        m = np.where(ms[key] > 0, ms[key], 1)
        most = t.differ(2 * n if role == 0 else n + below)
        bound = t.differ(n + n * t.den // t.num) if role == 0 else most
        salt = mix(key.astype(np.uint64) + K[3])
        sig, owner, weights = signatures(sets, chosen, m, ds[key], salt, least)
        quota = np.where(ds[key] > 0, -(-(weights - most) // 2), weights - most)
        again = chosen & (weights <= bound)
        sig2, owner2, _ = signatures(sets, again, np.zeros_like(m), ds[key], salt + K[4])
        parts.append((np.concatenate([sig, sig2]), np.concatenate([owner, owner2]) * 2 + role, quota))
    sig = np.concatenate([p[0] for p in parts])
    ref = np.concatenate([p[1] for p in parts])
    if only is not None:
        cell = _cell(sig)
        found = (only[cell >> 3] >> (cell & 7)) & 1 > 0
        sig, ref = sig[found], ref[found]
    bucket = (sig >> np.uint64(48)).astype(np.int64) % buckets
    order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    low = sig[order].view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
    ref = ref[order]
    for b in range(buckets):
        x, y = bounds[b], bounds[b + 1]
        if x < y:
            names, where = np.unique(ref[x:y], return_inverse=True)
            doc, role = names >> 1, names & 1
            quota = np.where(role == 0, parts[0][2][doc], parts[1][2][doc])
            yield (
                b, low[x:y].tobytes(), planes(where.astype("<u4")), planes(ids[doc].astype("<i8")), cls[doc].astype("<u8").tobytes(),
                planes(quota.astype("<i4")), role.astype("u1").tobytes(),
            )


def planes(numbers: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: high bytes are alike, and the shuffle's compression finds them."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def of_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _cell(sig: np.ndarray) -> np.ndarray:
    return (sig & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


ENTRY = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sig", "ref", "id", "cls", "quota", "role"))])
PACKED = pa.schema([("target", pa.int32()), ("found", pa.binary())])
MERGED = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("qa", pa.int64()), ("qb", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def group_pairs(sig, ids, cls, quota, role, light: int, hubs: int) -> np.ndarray:
    """What one bucket's entries find: pairs from small groups, stars from large ones, and what the large ones hide."""
    order = np.argsort(sig)
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    twice = np.zeros(len(sig), bool)
    twice[1:] |= same
    twice[:-1] |= same
    order, sig = order[twice], sig[twice]
    ids, cls, quota, role = ids[order], cls[order], quota[order], role[order].astype(np.int64)
    order = np.lexsort((ids, cls, sig))
    sig, ids, cls, quota, role = sig[order], ids[order], cls[order], quota[order], role[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, ids, quota, role = sig[fresh], ids[fresh], quota[fresh], role[fresh]
    if not len(sig):
        return np.empty(0, FOUND)
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(at, len(sig)))
    own = np.add.reduceat(1 - role, at)
    at, sizes = at[(sizes > 1) & (own > 0)], sizes[(sizes > 1) & (own > 0)]
    out = []

    def add(kind, a, b, n, qa, qb):
        rec = np.empty(len(a), FOUND)
        rec["kind"], rec["a"], rec["b"], rec["n"], rec["qa"], rec["qb"] = kind, a, b, n, qa, qb
        out.append(merge_found(rec))

    for g in np.unique(sizes[sizes <= light]).tolist():
        rows = at[sizes == g][:, None] + np.arange(g)
        i, j = np.triu_indices(g, 1)
        for step in range(0, len(rows), max(1, 1_000_000 // len(i))):
            part = rows[step : step + max(1, 1_000_000 // len(i))]
            x, y = part[:, i].ravel(), part[:, j].ravel()
            keep = ((role[x] == 0) | (role[y] == 0)) & (ids[x] != ids[y])
            x, y = x[keep], y[keep]
            swap = ids[x] > ids[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            mixed = role[x] != role[y]  # then the one of role 1 is larger, and its quota counts
            add(PAIR, ids[x], ids[y], 1, np.where(mixed & (role[x] == 0), FREE, quota[x]), np.where(mixed & (role[y] == 0), FREE, quota[y]))
    large = sizes > light
    if large.any():
        start, size = at[large], sizes[large]
        rows = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        add(HEAVY, ids[rows], role[rows], 1, quota[rows], 0)
        # Sets that large groups connect, each with the first ones in an order that is the same in all buckets.
        nodes, where = np.unique(ids[rows], return_inverse=True)
        turn = np.argsort(np.argsort(mix(nodes.astype(np.uint64) ^ K[5])))
        root, heads = turn.copy(), np.concatenate([[0], np.cumsum(size)[:-1]])
        while True:
            new = root.copy()
            np.minimum.at(new, where, np.repeat(np.minimum.reduceat(root[where], heads), size))
            if (new == root).all():
                break
            root = new
        order = np.lexsort((turn, root))
        begin = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1]]))
        many = np.diff(np.append(begin, len(order)))
        for k in range(hubs):
            hub = np.repeat(order[begin + np.minimum(k, many - 1)], many)
            add(STAR, nodes[order], nodes[hub], 1, -int(k == 0), 0)
    return merge_found(np.concatenate(out)) if out else np.empty(0, FOUND)


def merge_found(rec: np.ndarray) -> np.ndarray:
    """One record per (kind, a, b): counts added, of the quotas the least."""
    if not len(rec):
        return rec
    rec = rec[np.lexsort((rec["b"], rec["a"], rec["kind"]))]
    head = np.ones(len(rec), bool)
    head[1:] = (rec["kind"][1:] != rec["kind"][:-1]) | (rec["a"][1:] != rec["a"][:-1]) | (rec["b"][1:] != rec["b"][:-1])
    at = np.flatnonzero(head)
    out = rec[at].copy()
    out["n"] = np.add.reduceat(rec["n"], at)
    for q in ("qa", "qb"):
        out[q] = np.minimum.reduceat(rec[q], at)
    return out


def _texts(batch: pa.RecordBatch):
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
    for a, b in slices(texts):
        yield ids[a:b], texts[a:b]


def _repeated(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For arrays of numbers, which of theirs are in all of them together more than once."""
    if not parts:
        return []
    joined = np.concatenate(parts)
    order = np.argsort(joined)
    same = joined[order[1:]] == joined[order[:-1]]
    again = np.zeros(len(joined), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return np.split(again, np.cumsum([len(p) for p in parts])[:-1])


def meet(entered: DataFrame, light: int, hubs: int) -> DataFrame:
    """Merged findings of all buckets of ``entered`` (ENTRY). Null classes are the ids, null quotas 1, null roles 0, and
    without references entry i has id i."""
    buckets = partitions(entered)

    def match(batches):
        sigs, rest = [], []
        for batch in batches:
            for row in batch.to_pylist():
                sigs.append(np.frombuffer(row.pop("sig"), "<u4"))
                rest.append(row)
        held = {c: [] for c in ("sig", "id", "cls", "quota", "role")}
        # Most signatures occur once, so only those of others are unpacked.
        for sig, again, row in zip(sigs, _repeated(sigs), rest, strict=True):
            n = len(row["id"]) // 8
            ref = np.flatnonzero(again) if row["ref"] is None else of_planes(row["ref"], "<u4")[again]
            held["sig"].append(sig[again])
            ids = of_planes(row["id"], "<i8")
            held["id"].append(ids[ref])
            held["cls"].append((ids.view("<u8") if row["cls"] is None else np.frombuffer(row["cls"], "<u8"))[ref])
            held["quota"].append((np.ones(n, np.int32) if row["quota"] is None else of_planes(row["quota"], "<i4"))[ref])
            held["role"].append((np.zeros(n, np.uint8) if row["role"] is None else np.frombuffer(row["role"], "u1"))[ref])
        if held["sig"]:
            rec = group_pairs(*(np.concatenate(held[c]) for c in ("sig", "id", "cls", "quota", "role")), light, hubs)
            target = (mix(rec["a"].astype(np.uint64) ^ mix(rec["b"].astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            bounds = np.searchsorted(target[order], np.arange(buckets + 1))
            rec = rec[order]
            full = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([rec[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary())], schema=PACKED
            )

    def merge(batches):
        found = [np.frombuffer(x, FOUND) for batch in batches for x in batch.column(1).to_pylist()]
        if found:
            rec = merge_found(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(rec[f.name].astype(f.type.to_pandas_dtype())) for f in MERGED], schema=MERGED)

    found = entered.repartitionById(buckets, "bucket").mapInArrow(match, _ddl(PACKED))
    return found.repartitionById(buckets, "target").mapInArrow(merge, _ddl(MERGED))


def set_entries(rows: DataFrame, plan, edges, t: Threshold, *, width: int, least: int = 1, only=None) -> DataFrame:
    """Entries of (id, text); ``only``: a broadcast filter of signatures."""
    buckets = partitions(rows)

    def enter(batches):
        for batch in batches:
            for ids, texts in _texts(batch):
                found = list(entries(shingle_slice(texts, width), ids, plan, edges, t, buckets, least, None if only is None else only.value))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ENTRY, strict=True)], schema=ENTRY)

    return rows.mapInArrow(enter, _ddl(ENTRY))


def signature_filter(rows: DataFrame, plan, edges, t: Threshold, *, width: int, least: int) -> np.ndarray:
    """The filter of the signatures of (id, text): its chunks are added up on the executors, and their size is fixed."""

    def mark(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for ids, texts in _texts(batch):
                for row in entries(shingle_slice(texts, width), ids, plan, edges, t, 1, least):
                    raw = np.frombuffer(row[1], np.uint8).reshape(-1, SIG_BYTES)
                    sig = np.zeros((len(raw), 8), np.uint8)
                    sig[:, :SIG_BYTES] = raw
                    cell = _cell(sig.view("<u8").ravel())
                    np.bitwise_or.at(bits, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
        chunks = bits.reshape(-1, FILTER_CHUNK)
        full = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([zlib.compress(chunks[i].tobytes(), 1) for i in full], pa.binary())], ["chunk", "bits"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(FILTER_CHUNK, np.uint8)
        for x in part["bits"]:
            total |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "bits": [zlib.compress(total.tobytes(), 1)]})

    marked = rows.mapInArrow(mark, "chunk int, bits binary").groupBy("chunk").applyInPandas(add, "chunk int, bits binary")
    out = np.zeros((1 << (FILTER_BITS - 3)) // FILTER_CHUNK * FILTER_CHUNK, np.uint8).reshape(-1, FILTER_CHUNK)
    for row in marked.collect():
        out[row["chunk"]] = np.frombuffer(zlib.decompress(bytes(row["bits"])), np.uint8)
    return out.ravel()


def is_similar(p: np.ndarray, q: np.ndarray, t: Threshold) -> bool:
    """Whether two ascending arrays of distinct numbers are similar; empty ones never are."""
    if not len(p) or min(len(p), len(q)) * t.den < max(len(p), len(q)) * t.num:
        return False
    common = overlap(p, q)
    return common * t.den >= (len(p) + len(q) - common) * t.num


def verify(pairs: DataFrame, sets: DataFrame, to_sets, t: Threshold) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar, compared in full."""
    left = sets.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    right = sets.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "pa", "pb")

    def check(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAIR_ROWS):
                part = batch.slice(start, PAIR_ROWS)
                one, two = part.column(2).to_pylist(), part.column(3).to_pylist()
                every = list({*one, *two})
                sets = dict(zip(every, to_sets(every), strict=True))
                keep = pa.array([is_similar(sets[p], sets[q], t) for p, q in zip(one, two, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def _block_links(to_sets, t: Threshold):
    """Links of one block's queries to its sets, as many as join its components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        asks, holds, hidden = rows["asks"].to_numpy(), rows["holds"].to_numpy(), rows["hidden"].to_numpy()
        sets = to_sets(list(rows["packed"]))
        sizes = np.array([len(x) for x in sets])
        held = np.flatnonzero(holds)
        owner = np.repeat(held, sizes[held])
        hashes = np.concatenate([sets[i] for i in held]) if len(held) else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        out, joined = [], {}

        def top(label):
            while label in joined:
                label = joined[label]
            return label

        for q in np.flatnonzero(asks):
            low, high = np.searchsorted(hashes, sets[q], "left"), np.searchsorted(hashes, sets[q], "right")
            n = high - low
            hits = owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            common = np.bincount(hits, minlength=len(sets))
            good = (common > 0) & (common * t.den >= (sizes + sizes[q] - common) * t.num) & (labels != labels[q]) & (hidden | hidden[q])
            found = np.flatnonzero(good)
            _, first = np.unique(labels[found], return_index=True)
            for i in found[first]:
                x, y = top(labels[q]), top(labels[i])
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    out.append((ids[q], ids[i]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _findings(found: DataFrame):
    """(pairs with their counts, stars, hidden sets (x)) of one level's findings.

    A pair counts from the view of its larger set, which one of the two views is: it needs that set's quota, less what large
    groups hide. A set whose whole quota could be hidden is left to what follows for large groups; without a common large
    group, though, a pair has the whole quota.
    """
    heavy = found.filter(F.col("kind") == HEAVY).select("a", F.col("b").alias("role"), F.col("n").alias("h"), F.col("qa").alias("quota"))
    stars = found.filter(F.col("kind") == STAR).select("a", "b")
    role = F.when((F.col("qa") == FREE) | (F.col("qb") == FREE), 1).otherwise(0).cast("bigint")
    pairs = found.filter(F.col("kind") == PAIR).withColumn("role", role)
    pairs = pairs.join(heavy.select("a", "role", F.col("h").alias("ha")), ["a", "role"], "left")
    pairs = pairs.join(heavy.select(F.col("a").alias("b"), "role", F.col("h").alias("hb")), ["b", "role"], "left")
    pairs = pairs.withColumns({"la": F.col("qa") - F.coalesce("ha", F.lit(0)), "lb": F.col("qb") - F.coalesce("hb", F.lit(0))})
    view = lambda q, left: ((F.col(left) >= 1) & (F.col("n") >= F.col(left))) | (F.col("n") >= F.greatest(F.lit(1), F.col(q)))
    kept = pairs.filter(view("qa", "la") | view("qb", "lb"))
    return kept.select("a", "b", "n"), stars, heavy.filter("quota <= h").select(F.col("a").alias("x")).distinct()


def settle(entered: DataFrame, load, to_sets, t: Threshold, *, deeper=None, light: int = LIGHT, hubs: int = HUBS) -> DataFrame:
    """(node, component) of all nodes with links, from the entries of all nodes.

    ``load`` gives (id, packed) for wanted ids, ``to_sets`` the ascending sets of packed contents, ``deeper`` (if any)
    entries with longer segments, as far as they may meet those of given ids.

    Pairs of groups of up to ``light`` sets are kept if they share enough signatures. Where larger groups could hide all that a
    set has to share, all sets are entered again with longer segments, as far as they may meet its own. What is hidden
    even then is in clusters, which common large groups connect: their sets are compared with a hub first, and if a cluster
    isn't within one component then, all that may still link is compared in blocks. A missing link joins two
    components and has an end that was hidden, so the queries are the cluster's hidden sets or its sets outside of
    its largest component, whichever are fewer. So no limit loses a link.
    """
    pairs, stars, hidden = _findings(cut(meet(entered, light, hubs), TASK_ROWS))
    hidden = cut(hidden, TASK_ROWS)
    if deeper is not None and not hidden.isEmpty():
        more, stars, also = _findings(cut(meet(deeper(hidden.withColumnRenamed("x", "id")), light, hubs), TASK_ROWS))
        one, two = hidden.select(F.col("x").alias("a"), F.lit(1).alias("ka")), hidden.select(F.col("x").alias("b"), F.lit(1).alias("kb"))
        more = more.join(one, "a", "left").join(two, "b", "left").filter("ka = 1 OR kb = 1").select("a", "b", "n")
        pairs, hidden = pairs.union(more), cut(hidden.join(also, "x", "left_semi"), TASK_ROWS)
    if hidden.isEmpty():
        stars = stars.limit(0)
    # Stars lead to the first set of what large groups connect; those of one component of stars are a cluster.
    clusters = components(stars.filter("a <> b"))
    kept = clusters.join(hidden, F.col("node") == F.col("x"), "left_semi").select("component").distinct()
    clusters = look_up(clusters, kept, "component", "node")
    ties = cut(clusters.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")), TASK_ROWS)
    todo = cut(pairs.union(ties.withColumn("n", F.lit(FREE).cast("bigint"))).groupBy("a", "b").agg(F.max("n").alias("n")), TASK_ROWS)
    sets = cut(load(todo.select(F.col("a").alias("id")).union(todo.select("b")).distinct()), SET_ROWS)
    # Each set's likeliest pair first; of the others only those that could still join two components.
    likely = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    ranked = todo.withColumn("rank", F.row_number().over(likely))
    links = cut(verify(ranked.filter("rank = 1 OR n = " + str(FREE)), sets, to_sets, t), TASK_ROWS)
    labels = components(links)
    rest = _labelled(ranked.filter("rank > 1 AND n < " + str(FREE)), labels).filter("la <> lb")
    # Each node's link to the first of its component stands for the links that led there.
    links = cut(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verify(rest, sets, to_sets, t)), TASK_ROWS)
    labels = components(links)
    split = _labelled(ties, labels).filter("la <> lb").select(F.col("b").alias("node"))
    if split.isEmpty():
        return labels
    clusters = clusters.select("node", F.col("component").alias("cluster"))
    broken = clusters.join(split, "node", "left_semi").select("cluster").distinct()
    members = look_up(clusters, broken, "cluster", "node").join(labels, "node", "left")
    members = members.join(hidden.select(F.col("x").alias("node"), F.lit(True).alias("hidden")), "node", "left")
    members = cut(members.select("cluster", F.col("node").alias("id"), F.coalesce("component", "node").alias("label"), F.coalesce("hidden", F.lit(False)).alias("hidden")), TASK_ROWS)
    counts = members.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum(F.col("hidden").cast("bigint")).alias("h"))
    counts = counts.groupBy("cluster").agg(F.sum("n").alias("sets"), F.sum("h").alias("hiding"), F.max(F.struct("n", "label")).alias("top"))
    asks = F.when(F.col("hiding") < F.col("sets") - F.col("top.n"), F.col("hidden")).otherwise(F.col("label") != F.col("top.label"))
    rows = look_up(members, counts, "cluster", "id").withColumn("asks", asks)
    queries = F.least(F.col("hiding"), F.col("sets") - F.col("top.n"))
    rows = rows.withColumns({
        "nm": F.ceil(F.col("sets") / BLOCK_SETS).cast("int"), "nq": F.greatest(F.lit(1), F.ceil(queries / BLOCK_QUERIES).cast("int")),
    }).join(sets, "id")
    spread = F.xxhash64("id")
    held = rows.select("cluster", "id", "label", "hidden", "packed", F.lit(False).alias("asks"), F.lit(True).alias("holds"),
        F.pmod(spread, "nm").cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"))
    asking = rows.filter("asks").select("cluster", "id", "label", "hidden", "packed", F.lit(True).alias("asks"), F.lit(False).alias("holds"),
        F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"), F.pmod(spread, "nq").cast("int").alias("q"))
    more = held.union(asking).groupBy("cluster", "m", "q").applyInPandas(_block_links(to_sets, t), "a bigint, b bigint")
    return components(links.union(more))


def only_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose id is in ``wanted``. Most others go before the shuffle, by cells of ids, of which there are 2**20 at most."""
    cell = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")
    cells = F.broadcast(wanted.select(cell.alias("cell")).distinct())
    return rows.withColumn("cell", cell).join(cells, "cell", "left_semi").drop("cell").join(wanted, "id", "left_semi")


def unpack(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(p, "<u8") for p in packed]


def similar_components(
    docs: DataFrame,
    *,
    num: int = NUMERATOR,
    den: int = DENOMINATOR,
    width: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that its links reach).

    1. Equal sets are one class, and the smallest id stands for it.
    2. Sizes fall into bands such that a similar set is in the same band or the next. A band's universe is cut by hash
       into segments; each set's filled segments, and for some also what is left after any one deletion, are
       signatures (``allocate``). Similar sets differ in so few elements that at least ``quota`` signatures are shared.
    3. Signatures meet by bucket. Pairs of a signature with few sets are counted over all buckets and kept if the count
       reaches the larger set's quota, less its signatures that many sets share.
    4. Kept pairs are compared in full, and components follow; what signatures of many sets could hide is compared, too (``settle``).

    Null and empty texts have no shingles and are linked with nothing. Rows with equal ids are one node. Rows with a null
    id are returned with a null component. An empty table gives no rows. Other columns are ignored.
    """
    t = Threshold(num, den)
    edges = t.bands()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def describe(batches):
        for batch in batches:
            nulls = batch.column(0).is_null()
            at = 0
            for part, texts in _texts(batch):
                sets = shingle_slice(texts, width)
                given = pa.array(part, mask=nulls.slice(at, len(part)).to_numpy(zero_copy_only=False))
                at += len(part)
                columns = [given, pa.array(sets.sizes.astype(np.int64)), *(pa.array(digest(sets, k).view(np.int64)) for k in (K[2], K[6]))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "h1", "h2"])

    nodes = cut(rows.mapInArrow(describe, "id bigint, n bigint, h1 bigint, h2 bigint"))
    band = F.floor(F.log(F.greatest("n", F.lit(1))) * 8).alias("k")  # a few hundred groups at most
    counts = nodes.filter("n > 0").groupBy(band).agg(F.count("*").alias("c"), F.max("n").alias("n")).collect()
    population: dict[int, int] = {}
    for c in counts:
        k = int(np.searchsorted(edges, c["n"], "right")) - 1
        population[k] = population.get(k, 0) + c["c"]
    top = max(population, default=0)
    plan, deep = ({k: allocate(int(edges[k]), int(edges[k + 1]), population.get(k, 1), t, deep=d) for k in range(top + 1)} for d in (False, True))

    source = rows.filter("id IS NOT NULL")

    def deeper(hidden):
        options = {"width": width, "least": DEEP_LEAST}
        bits = signature_filter(only_ids(source, hidden), deep, edges, t, **options)
        return set_entries(source, deep, edges, t, only=docs.sparkSession.sparkContext.broadcast(bits), **options)

    labels = settle(
        set_entries(source, plan, edges, t, width=width),
        lambda wanted: only_ids(source, wanted).mapInArrow(_to_sets(width), "id bigint, packed binary"),
        unpack, t, deeper=deeper,
    )

    salts = max(32, partitions(docs))
    keys = ["h1", "h2", "n"]
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    parts = salted.groupBy(*keys, "salt").agg(F.min("id").alias("head"))
    parts = parts.withColumn("rep", F.min("head").over(Window.partitionBy(*keys)))
    parts = parts.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    parts = parts.select(*keys, "salt", F.coalesce("component", "rep").alias("component_id"))
    mine = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return salted.join(parts, [*keys, "salt"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), mine.alias("component_id"))


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component, and those without an identifier."""
    found = similar_components(docs, id_col=id_col, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no name clashes
    rows = rows.withColumn("id", F.col("row")[id_col].cast("bigint"))
    kept = rows.join(found, "id", "left_semi").select("row").union(rows.filter("id IS NULL").select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _to_sets(width: int):
    def run(batches):
        for batch in batches:
            for ids, texts in _texts(batch):
                s = shingle_slice(texts, width)
                packed = [s.hashes[x:y].astype("<u8").tobytes() for x, y in zip(s.starts[:-1], s.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(packed, pa.binary())], ["id", "packed"])

    return run


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` with the components of both ends; a node without links is its own."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
    out = pairs.join(one, "a", "left").join(two, "b", "left")
    return out.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")})
