"""Language identification: script ranges, letter-group scores per word, and Viterbi over words."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: First and last code points of scripts. Fixed values.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s[0] for s in SCRIPTS))
FEATURE_BITS = 16
SMOOTHING = 0.5
#: A script belongs to a language if it writes so much of its letters.
SCRIPT_SHARE = 0.01
#: What a change of language costs, in natural logarithms of likelihood.
SWITCH = 8.0
#: About so many labelled rows of each language are fitted on.
FIT_ROWS = 1500
UNKNOWN = "und"
#: Characters for which features are held, and characters whose words Viterbi steps through together.
FEATURE_CHARS, VITERBI_CHARS = 1 << 20, 12 << 20


@lru_cache(maxsize=1)
def _tables():
    """Of each code point below 65,536: lower case, whether it is a letter, script."""
    lower, letter, script = np.arange(65536, dtype=np.uint32), np.zeros(65536, bool), np.zeros(65536, np.uint8)
    for i in range(65536):
        c = chr(i)
        letter[i] = c.isalpha()
        if len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return lower, letter, script


@dataclass
class Words:
    """Words (runs of letters) of some texts: text, first and last character, script, and their features' tables' rows."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    triples: np.ndarray  # of each letter
    whole: np.ndarray  # of each word
    heads: np.ndarray  # where each word's letters start


def words_of(texts: list[str]) -> Words:
    lower, letter, script = _tables()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = np.minimum(points, 65535)
    is_letter = letter[low]
    beyond = points > 65535
    if beyond.any():
        is_letter = is_letter | np.array([b and chr(p).isalpha() for p, b in zip(points.tolist(), beyond.tolist(), strict=True)])
    small = np.where(is_letter, np.where(beyond, points, lower[low]), 0).astype(np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    at = np.flatnonzero(is_letter)
    padded = np.concatenate([[np.uint64(0)], small, [np.uint64(0)]])
    mixed = (padded[at] * np.uint64(0x9E3779B1) + padded[at + 1] * np.uint64(0x85EBCA77) + padded[at + 2] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    triples = (mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    lengths = end - start
    heads = np.cumsum(lengths) - lengths
    if len(start):
        place = (np.arange(len(at)) - np.repeat(heads, lengths)).astype(np.uint64)
        spelt = np.add.reduceat(small[at] * (place * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x9E3779B97F4A7C15)), heads)
        whole = ((spelt * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    else:
        whole = np.empty(0, np.int64)
    text = np.searchsorted(ends, start, "right")
    offset = np.concatenate([[0], ends])[text]
    return Words(text, start - offset, end - offset, script[low[start]] if len(start) else np.empty(0, np.uint8), triples, whole, heads)


@dataclass
class Model:
    langs: list[str]
    triples: np.ndarray  # (features, languages)
    whole: np.ndarray
    scripts: np.ndarray  # (scripts, languages), 0 or 1


def _count(langs: list[str]):
    """Counts of a partition's rows (lang, text), one row per language."""
    width = (2 << FEATURE_BITS) + len(SCRIPT_NAMES)

    def run(batches):
        counts = np.zeros((len(langs), width), np.int64)
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                own = counts[langs.index(lang)]
                texts = rows["text"].fillna("").tolist()
                for a, b in _runs(texts, FEATURE_CHARS):
                    w = words_of(texts[a:b])
                    own[: 1 << FEATURE_BITS] += np.bincount(w.triples, minlength=1 << FEATURE_BITS)
                    own[1 << FEATURE_BITS : 2 << FEATURE_BITS] += np.bincount(w.whole, minlength=1 << FEATURE_BITS)
                    own[2 << FEATURE_BITS :] += np.bincount(w.script, weights=w.end - w.start, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang, own in zip(langs, counts, strict=True):
            if own.any():
                yield pd.DataFrame({"lang": [lang], "counts": [zlib.compress(own.tobytes(), 1)]})

    return run


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in rows["counts"])
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def fit(rows: DataFrame, *, fit_rows: int = FIT_ROWS, seed: int = 7) -> Model:
    """A model from rows (doc_id, lang, text); rows without lang are left out.

    Languages have about ``fit_rows`` rows each, or all they have: those with a small hash of doc_id, so the choice is the same
    however rows are dealt. Counts are added up on the executors; the driver gets one fixed-size row per language.
    """
    rows = rows.filter("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << FEATURE_BITS, 0), np.float32), np.zeros((1 << FEATURE_BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0)))
    place = F.xxhash64(F.lit(seed), "doc_id") / F.lit(2.0**64) + 0.5
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_rows / sizes[lang]))).otherwise(share)
    counted = rows.filter(place <= share).select("lang", "text").mapInPandas(_count(langs), "lang string, counts binary")
    found = counted.groupBy("lang").applyInPandas(_add, "lang string, counts binary").collect()
    counts = {r["lang"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64) for r in found}
    langs = [lang for lang in langs if lang in counts]
    table = np.stack([counts[lang] for lang in langs], axis=1).astype(np.float64)
    size = 1 << FEATURE_BITS

    def logs(part):
        part = part + SMOOTHING
        return np.log(part / part.sum(axis=0)).astype(np.float32)

    letters = table[2 * size :]
    return Model(langs, logs(table[:size]), logs(table[size : 2 * size]), letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log-likelihoods (word, language). Languages that don't write a word's script are out, unless none does."""
    if not len(words.text) or not model.langs:
        return np.zeros((len(words.text), len(model.langs)), np.float32)
    scores = np.add.reduceat(model.triples[words.triples], words.heads, axis=0) + model.whole[words.whole]
    scores -= scores.max(axis=1, keepdims=True)
    allowed = model.scripts[words.script].astype(bool)
    none = ~allowed.any(axis=1)
    scores[none] = 0
    scores[~allowed & ~none[:, None]] = -1e6
    return scores


def best_path(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word that is likeliest for its text as a whole, where each change costs ``switch``.

    ``counts`` are the texts' words. All texts step together, longest first, so those still running are a prefix.
    """
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    changed, came = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    value = np.zeros((len(counts), scores.shape[1]), np.float64)
    steps = int(counts[0]) if len(counts) else 0
    running = len(counts) - np.searchsorted(counts[::-1], np.arange(steps), "right")
    for t in range(steps):
        k = running[t]
        at, v = starts[:k] + t, value[:k]
        if t:
            top = v.argmax(axis=1)
            best = v[np.arange(k), top][:, None] - switch
            changed[at], came[at] = best > v, top
            np.maximum(v, best, out=v)
        v += scores[at]
    label = np.zeros(len(scores), np.int16)
    now = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = running[t]
        at, cur = starts[:k] + t, now[:k]
        label[at] = cur
        now[:k] = np.where(changed[at, cur], came[at], cur)
    return label


def _runs(texts: list[str], limit: int):
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def identify(texts: list[str], model: Model, switch: float = SWITCH):
    """Per text: (language, score, spans), spans being (language, first character, end) lists."""
    out = []
    for a, b in _runs(texts, VITERBI_CHARS):
        part = texts[a:b]
        held = []
        for x, y in _runs(part, FEATURE_CHARS):
            w = words_of(part[x:y])
            held.append((w.text + x, w.start, w.end, word_scores(w, model)))
        text, start, end, scores = (np.concatenate(c) for c in zip(*held, strict=True))
        label = best_path(scores, np.bincount(text, minlength=len(part)), switch) if model.langs else np.zeros(len(text), np.int16)
        letters = np.zeros((len(part), max(1, len(model.langs))))
        np.add.at(letters, (text, label), end - start)
        head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (label[1:] != label[:-1])])[: len(text)])
        tail = np.append(head[1:], len(text))[: len(head)] - 1
        spans: list[list] = [[] for _ in part]
        for h, t in zip(head.tolist(), tail.tolist(), strict=True):
            spans[text[h]].append((model.langs[label[h]] if model.langs else UNKNOWN, int(start[h]), int(end[t])))
        total, best = letters.sum(axis=1), letters.argmax(axis=1)
        for i in range(len(part)):
            if total[i] and model.langs:
                out.append((model.langs[best[i]], float(letters[i, best[i]] / total[i]), spans[i]))
            else:
                out.append((UNKNOWN, 0.0, spans[i]))
    return out


def label_documents(docs: DataFrame, model: Model, *, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """``docs`` (without columns lang_pred, score and spans) with those added.

    lang_pred writes most letters of the text, score is its share of them, spans are the stretches (lang, start, end) in
    characters. A null text, one without a letter, or a model without languages gives ``und``, 0 and no spans of languages.
    Ties go to the first language by name. Rows stay where they are; the model has a fixed size per language.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "spans")]
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    stretch = StructType([StructField("lang", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(stretch))]
    schema = StructType([*kept, *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about half a MB per language

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            found = identify(texts, shared.value, switch)
            lang, score, spans = zip(*found) if found else ((), (), ())
            spans = [[{"lang": n, "start": a, "end": b} for n, a, b in s] for s in spans]
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "spans"])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)
