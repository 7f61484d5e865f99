"""Fill-in-middle: a text is cut into prefix, middle and suffix, which are written in another order between markers.

Cuts lie between units (code points, words or lines), which an automaton counts; see ``automata``. Texts up to a chunk are
scanned where they are. Longer ones are cut into chunks at any byte and dealt to all tasks; each chunk gives its state function and
counts, these compose to entry states and counts before each chunk, and only the chunk that holds a cut is looked at again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import automata
from ledgerlark.llm.common import look_up, partitions, text_or_empty
from ledgerlark.llm.shingles import slices

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Texts with more bytes are scanned in chunks of this size by several tasks.
CHUNK_BYTES = 64 << 10
UNITS = {"code points": automata.code_points, "words": automata.words, "lines": automata.lines}


def draws(key: Column, seed: str = "1", n: int = 4) -> list[Column]:
    """``n`` numbers below 2^32 made from ``key``: the 8-digit groups of the hex SHA-256 of seed, colon and key (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(n)]


def smaller_and_larger(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = first % (n + 1), second % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def cut_texts(units: str):
    """A function of text and two draws: units, whether a marker occurs, and units and bytes before both cuts."""

    @F.arrow_udf("n bigint, marked boolean, a bigint, b bigint, a_bytes bigint, b_bytes bigint")
    def run(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        unit, finder = UNITS[units](), automata.marker_finder(MARKERS)
        whole = text.cast(pa.binary()).to_pylist()
        draw = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
        parts = []
        for i, j in slices(whole):
            texts = automata.Texts(unit, whole[i:j])
            n = texts.totals()
            a, b = smaller_and_larger(n, draw[0][i:j], draw[1][i:j])
            marked = automata.Texts(finder, whole[i:j]).totals() > 0
            parts.append((n, marked, a, b, texts.cuts(a), texts.cuts(b)))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64, bool, np.int64, np.int64, np.int64, np.int64)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "marked", "a", "b", "a_bytes", "b_bytes"])

    return run


def scan_chunks(units: str):
    """A function of a chunk: exit states and counts by entry state, for units and for markers."""

    @F.arrow_udf("exits array<int>, counts array<bigint>, marker_exits array<int>, marker_counts array<bigint>")
    def run(chunk: pa.Array) -> pa.Array:
        found = chunk.to_pylist()
        columns = []
        for automaton in (UNITS[units](), automata.marker_finder(MARKERS)):
            exits, counts = automata.Texts(automaton, found).whole() if found else (np.zeros((0, 1), int), np.zeros((0, 1), int))
            columns += [pa.array(exits.tolist(), pa.list_(pa.int32())), pa.array(counts.tolist(), pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["exits", "counts", "marker_exits", "marker_counts"])

    return run


def compose_chunks():
    """A function of the scans of a text's chunks in order: entry state and units before each, all units, whether a marker occurs."""

    @F.arrow_udf("entry array<int>, before array<bigint>, n bigint, marked boolean")
    def run(scans: pa.Array) -> pa.Array:
        out = []
        for parts in scans.to_pylist():
            place, total = np.arange(len(parts)), []
            for name in ("", "marker_"):
                exits = np.array([p[f"{name}exits"] for p in parts], np.int64)
                counts = np.array([p[f"{name}counts"] for p in parts], np.int64)
                entry, before = automata.prefixes(exits, counts, place)
                total.append((entry, before, int(before[-1] + counts[-1, entry[-1]])))
            (entry, before, n), (_, _, marks) = total
            out.append({"entry": entry.tolist(), "before": before.tolist(), "n": n, "marked": marks > 0})
        kind = pa.struct([("entry", pa.list_(pa.int32())), ("before", pa.list_(pa.int64())), ("n", pa.int64()), ("marked", pa.bool_())])
        return pa.array(out, kind)

    return run


def cut_chunk(units: str):
    """A function of a chunk, its entry state and the rank of a report in it: bytes before that cut."""

    @F.arrow_udf("bigint")
    def run(chunk: pa.Array, entry: pa.Array, rank: pa.Array) -> pa.Array:
        found = chunk.to_pylist()
        if not found:
            return pa.array([], pa.int64())
        texts = automata.Texts(UNITS[units](), found)
        return pa.array(texts.cuts(rank.to_numpy(zero_copy_only=False), entry.to_numpy(zero_copy_only=False)))

    return run


def below(limit: Column):
    return lambda x: x < limit


def giant_cuts(docs: DataFrame, units: str, chunk_bytes: int) -> DataFrame:
    """``docs`` (_text, _first, _second and more), of long texts, with the struct ``_cut`` that ``cut_texts`` gives.

    Chunks are dealt to tasks whatever text they are of. What is gathered for one text is a few numbers per chunk; a text
    is below 2 GB, as it is one value, so that is a few MB at most. Equal texts share one entry.
    """
    docs = docs.withColumn("_digest", F.sha2("_text", 256))
    raw = F.col("_text").cast("binary")
    ends = F.sequence(F.lit(0), F.expr(f"(octet_length(_text) - 1) div {chunk_bytes}").cast("int"))
    pieces = docs.select("_digest", F.explode(ends).alias("_seq"), raw.alias("_raw"))
    pieces = pieces.select("_digest", "_seq", F.col("_raw").substr(F.col("_seq") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("_chunk"))
    scans = pieces.repartition(partitions(docs)).select("_digest", "_seq", scan_chunks(units)("_chunk").alias("_scan"))
    scans = scans.dropDuplicates(["_digest", "_seq"]).groupBy("_digest").agg(F.sort_array(F.collect_list(F.struct("_seq", "_scan"))).alias("_scans"))
    known = scans.select("_digest", compose_chunks()(F.transform("_scans", lambda s: s["_scan"])).alias("_all"))
    out = look_up(docs.withColumn("_by", F.xxhash64("_first", "_second")), known, "_digest", "_by")
    n = F.col("_all.n")
    ranks = F.col("_first") % (n + 1), F.col("_second") % (n + 1)
    out = out.withColumns({"_a": F.least(*ranks), "_b": F.greatest(*ranks)})
    cut, early = cut_chunk(units), UNITS[units]().at_start
    for name in ("_a", "_b"):
        rank = F.col(name) + int(early)
        inner = (F.col(name) > 0) & (F.col(name) < n)
        # Before the first unit and after the last there is nothing to look for; the first chunk's first report stands in.
        seq = F.when(inner, F.size(F.filter("_all.before", below(rank))) - 1).otherwise(0)
        out = out.withColumn("_seq", seq)
        chunk = raw.substr(F.col("_seq") * chunk_bytes + 1, F.when(inner, chunk_bytes).otherwise(1).cast("int"))
        entry = F.element_at("_all.entry", F.col("_seq") + 1)
        left = F.when(inner, rank - F.element_at("_all.before", F.col("_seq") + 1)).otherwise(1)
        at = F.col("_seq").cast("bigint") * chunk_bytes + cut(chunk, entry, left)
        out = out.withColumn(f"{name}_bytes", at)
        out = out.withColumn(f"{name}_bytes", F.when(inner, F.col(f"{name}_bytes")).when(F.col(name) >= n, F.octet_length("_text")).otherwise(0).cast("bigint"))
    fields = F.struct(n.alias("n"), F.col("_all.marked").alias("marked"), *[F.col(f"_{x}").alias(x) for x in ("a", "b", "a_bytes", "b_bytes")])
    return out.withColumn("_cut", fields)


def fill_in_middle(
    docs: DataFrame, first: Column, second: Column, plain: Column, spm: Column, *,
    text_col: str = "text", units: str = "code points", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``docs`` with the struct ``infill``: n (units), form, prefix_units, middle_units, prefix, middle, suffix and output.

    ``first`` and ``second`` are numbers of at least 0 and choose the cuts: the prefix ends after the smaller of first % (n + 1)
    and second % (n + 1) units, the middle after the larger. Where ``plain`` holds, for empty or null texts and for texts that
    contain a marker, the form is plain and the output the text; else it is spm where ``spm`` holds and psm otherwise. Null
    ``first`` or ``second`` count as 0, null ``plain`` or ``spm`` as false. Parts and their units are null for plain.

    Rows are worked on one by one, so repeated rows, ties and null identifiers are nothing special; an empty table stays empty. Texts of
    any length are scanned whole. A column named ``infill`` is replaced; others are kept, whatever their names.
    """
    kept = [c for c in docs.columns if c != "infill"]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), text_or_empty(f"`{text_col}`").alias("_text"),
        F.coalesce(first.cast("bigint"), F.lit(0)).alias("_first"), F.coalesce(second.cast("bigint"), F.lit(0)).alias("_second"),
        F.coalesce(plain, F.lit(False)).alias("_plain"), F.coalesce(spm, F.lit(False)).alias("_spm"),
    )
    long = F.octet_length("_text") > chunk_bytes
    done = rows.filter(~long).withColumn("_cut", cut_texts(units)("_text", "_first", "_second"))
    names = ("_row", "_text", "_plain", "_spm", "_cut")
    done = done.select(*names).union(giant_cuts(rows.filter(long), units, chunk_bytes).select(*names))
    raw, cut = F.col("_text").cast("binary"), lambda x: F.col(f"_cut.{x}").cast("int")
    is_plain = F.col("_plain") | (F.length("_text") == 0) | F.col("_cut.marked")
    form = F.when(is_plain, "plain").when(F.col("_spm"), "spm").otherwise("psm")
    parts = {
        "prefix": raw.substr(F.lit(1), cut("a_bytes")),
        "middle": raw.substr(cut("a_bytes") + 1, cut("b_bytes") - cut("a_bytes")),
        "suffix": raw.substr(cut("b_bytes") + 1, F.octet_length("_text")),
    }
    done = done.withColumns({"_form": form, **{f"_{k}": F.when(~is_plain, v.cast("string")) for k, v in parts.items()}})
    written = {
        "psm": F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle"),
        "spm": F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle"),
    }
    output = F.when(F.col("_form") == "plain", F.col("_text")).when(F.col("_form") == "psm", written["psm"]).otherwise(written["spm"])
    infill = F.struct(
        F.col("_cut.n").alias("n"), F.col("_form").alias("form"), F.when(~is_plain, F.col("_cut.a")).alias("prefix_units"),
        F.when(~is_plain, F.col("_cut.b") - F.col("_cut.a")).alias("middle_units"),
        *[F.col(f"_{k}").alias(k) for k in parts], output.alias("output"),
    )
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], infill.alias("infill"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` wrote as ``output`` in this form: each marker's first place bounds a part."""
    part = lambda s, at, k: F.split_part(s, F.lit(at), F.lit(k))
    after = lambda s, at: F.substr(s, F.locate(at, s) + len(at))
    behind_s = after(output, SUFFIX)
    psm = F.concat(F.substr(part(output, SUFFIX, 1), F.lit(len(PREFIX) + 1)), after(behind_s, MIDDLE), part(behind_s, MIDDLE, 1))
    behind_p = after(output, PREFIX)
    spm = F.concat(part(behind_p, MIDDLE, 1), after(behind_p, MIDDLE), F.substr(part(output, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
