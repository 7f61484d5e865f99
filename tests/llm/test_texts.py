import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, exact_dedup, language, quality, queries, substrings
from tests.helpers import HAVE_DATA, SF, agrees
from tests.llm.fixtures import SCHEMA, WORDS, awkward_texts, documents, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    agrees(spark, queries.QUERIES[name], queries.ORACLES[name])


# -- exact dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    ids: dict[str, list[int]] = {}
    for r in rows:
        ids.setdefault(norm(r.text), []).append(r.doc_id)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: norm(r.text) for r in rows}
    for r in got:
        own = ids[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(own), len(own), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    assert sum(r.kept for r in got) == len(ids)
    kept = exact_dedup.drop_exact_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(v) for v in ids.values()) and kept.columns == docs.columns


def test_exact_groups_of_nothing_and_null_ids(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {None: (None, 2, True), 1: (None, 2, False), 2: (2, 1, True)}


# -- quality rules


def repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), len(hit)


def test_quality_counts(spark):
    texts = [t for t in awkward_texts() if t is None or len(t) < 20_000] + [" ".join(random.Random(4).choice("abc") for _ in range(400))]
    got = {r.doc_id: r.quality for r in quality.judge(documents(spark, texts, repeat=False)).collect()}
    for i, text in enumerate(texts):
        assert (got[i].n_words, got[i].n_repeat_words) == repeats(text)
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].base_failed == (got[i].n_words < 50 or 2 * got[i].n_repeat_words > got[i].n_words)


def test_bad_lines_go_and_bad_documents_with_them(spark):
    good = prose(random.Random(8), 70)
    texts = [f"{good}\nHome | About | News | Contact\n{good[::-1]}.", "\n".join(["Menu | a | b | c"] * 30), f"{good}\nAll rights reserved."]
    got = {r.doc_id: r.quality for r in quality.judge(documents(spark, texts, repeat=False)).collect()}
    assert "About" not in got[0].cleaned and got[0].kept and not got[1].kept
    assert got[2].cleaned == good and got[2].kept


# -- repeated substrings


def brute_cut(texts, length):
    seen: dict[bytes, int] = {}
    data = [(t or "").encode() for t in texts]
    for t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("length, width", [(40, 8), (64, 16), (400, 32)])
def test_substrings_by_brute_force(spark, length, width):
    rng = random.Random(length)
    passage = prose(rng, 30 if length < 100 else 140)
    texts = awkward_texts()[:-2] + [f"{prose(rng, rng.randint(1, 30))}{passage[rng.randint(0, 9):]}{prose(rng, 9)}" for _ in range(6)]
    texts += ["ab" * 500, "abc" * 400, passage[:length], passage[: length - 1], passage[:length] + "\0\0" + passage[:length]]
    got = substrings.remove_repeats(documents(spark, texts, repeat=False), length=length, width=width).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == dict(enumerate(brute_cut(texts, length)))


def test_repeated_rows_repeat_each_other(spark):
    text = prose(random.Random(1), 150)
    docs = spark.createDataFrame([(1, text), (1, text), (2, "other"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (1, len(text), len(text)), (1, len(text), len(text)), (2, 5, 0)]
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


# -- BPE


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(TOKENIZER)
    out.no_truncation()
    out.no_padding()
    return out


def test_bpe_of_awkward_documents(spark, reference):
    docs = documents(spark)
    for r in bpe.encode_documents(docs, TOKENIZER).collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == reference.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


def test_bpe_of_random_strings(reference):
    own, rng = bpe.load(TOKENIZER), random.Random(6)
    pieces = [*"abcdeABCDE 'st'rell019.,!?-_<>|\n\t", "<|endoftext|>", "é", "İ", "Σ", "ß", "日本", "😀", "​", "\xa0", "\x1c", "\x85", "²", "Ⅷ", "ΑΣ ", "'LL", "\0"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        ids = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text.encode()).tolist() == ids, repr(text)
        assert own.decode(own.encode(text.encode())).decode() == reference.decode(ids, skip_special_tokens=False)


def test_pairs_are_compatible_exactly_if_merging_keeps_them(reference):
    own, rng = bpe.load(TOKENIZER), random.Random(9)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 12))) for _ in range(400)] + WORDS
    for word in words:
        ids = reference.encode(word, add_special_tokens=False).ids
        assert all(own.compatible(a, b) for a, b in zip(ids, ids[1:], strict=False))
        assert own.encode_word(word) == ids


def test_bpe_cache_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small, text = bpe.WordBpe(TOKENIZER), prose(random.Random(2), 300).encode()
    assert small.encode(text).tolist() == bpe.load(TOKENIZER).encode(text).tolist() and len(small.known) <= 3
    json.dumps(small.encode(text).tolist())


# -- language


def corpus():
    rng = random.Random(11)
    make = {"en": ["the", "and", "thing", "with", "hand"], "fr": ["les", "être", "queue", "oiseau", "dans"], "ru": ["это", "что", "мир", "дом"]}
    return make, [(i, " ".join(rng.choice(make[lang]) for _ in range(30)), lang) for i, lang in enumerate(rng.choices(list(make), k=90))]


def test_language_of_held_out_and_mixed_texts(spark):
    make, rows = corpus()
    model = language.fit(spark.createDataFrame(rows[:60], "doc_id long, text string, lang string"))
    mixed = " ".join(make["en"] * 6 + make["fr"] * 6 + make["ru"] * 6)
    tests = [*rows[60:], (900, None, "en"), (901, "", "en"), (902, "123 !?", "en"), (903, mixed, "en"), (904, "日本", None)]
    docs = spark.createDataFrame([(*r, "s") for r in tests], "doc_id long, text string, lang string, spans string")
    got = {r.doc_id: r for r in language.label_documents(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[60:])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert [s.lang for s in got[903].spans] == ["en", "fr", "ru"] and 0 < got[903].score < 1
    assert mixed[got[903].spans[2].start : got[903].spans[2].end] == " ".join(make["ru"] * 6)
    assert 0 <= got[904].score <= 1


def test_language_without_labels(spark):
    model = language.fit(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert language.label_documents(docs, model).first().lang_pred == "und"
    assert language.label_documents(docs.limit(0), model).count() == 0


def test_viterbi_by_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    counts = np.array([5, 0, 1, 4])
    scores = rng.normal(size=(10, 3)) * 3
    got, start = language.best_path(scores, counts, 2.0), 0
    for n in counts:
        part = scores[start : start + n]
        worth = lambda p: sum(part[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        if n:
            best = max(itertools.product(range(3), repeat=n), key=worth)
            assert abs(worth(tuple(got[start : start + n])) - worth(best)) < 1e-9
        start += n


@pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")
def test_language_accuracy_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op3_language_spans"](spark, SF).join(docs, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


# -- names, nulls and sizes


def test_clashing_names_pass_through(spark):
    names = ["_text", "_doc", "words", "row", "k", "range", "named", "key", "_own", "_keep", "_words", "_copy", "_times", "_row", "id", "a.b"]
    rows = [(i, t, "en", "s", *(f"{n}{i}" for n in names)) for i, t in enumerate([prose(random.Random(5), 80), "x", None, prose(random.Random(6), 90)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    from ledgerlark.llm import mixing, setjoin

    for out in (exact_dedup.drop_exact_copies(docs), setjoin.drop_similar(docs), mixing.repeat_rows(docs), quality.judge(docs).drop("quality")):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


@pytest.mark.parametrize("sampled", [1, 3, 40])
def test_copies_that_splitters_cut(spark, sampled):
    texts = ["hot  text"] * 150 + [f"hot text {i % 40}" for i in range(60)] + ["hot\ttext"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = {}
    for i, t in enumerate(texts):
        ids.setdefault(norm(t), []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, sampled=sampled).collect()}
    assert got == {i: (min(v), len(v), i == min(v)) for v in ids.values() for i in v}


def test_copies_are_found_without_digests(spark, monkeypatch):
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: real(F.lit("same"), bits))
    docs = spark.createDataFrame(list(enumerate(["a  b", "c", "a b", "c", "d", "a b"])), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4, 5: 0}


def test_bpe_of_one_very_long_word(reference):
    own = bpe.load(TOKENIZER)
    for word in ("ab" * 30_000, "é日" * 5_000, "x" * 50_000):
        want = reference.encode(word, add_special_tokens=False).ids
        assert own.encode(word.encode()).tolist() == want and own.decode(np.array(want)).decode() == reference.decode(want, skip_special_tokens=False)


def test_language_of_repeated_and_very_long_rows(spark):
    english, french = "the cat is on the table with his friend ", "le chat est sur la table avec son ami "
    docs = spark.createDataFrame([(i, "en", english * 4) for i in range(20)] + [(20 + i, "fr", french * 4) for i in range(20)], "doc_id long, lang string, text string")
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, english * 4), (1, english * 4), (2, french * 20_000), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in language.label_documents(asked, model).collect())
    assert got == [(1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und")]


def test_bpe_shorter_tokens():
    """Of the matches at a place only the longest is kept; the others follow from it."""
    own = bpe.load(TOKENIZER)
    for word in ("unbelievable", "internationally" + bpe.END, "zzz"):
        here = [found for last, found in own.matcher.iter(word) if last == found[1]]  # those that start the word, by length
        chain = [here[-1][0]]
        while own.shorter[chain[-1]] >= 0:
            chain.append(own.shorter[chain[-1]])
        assert chain == [number for number, _ in here[::-1]] and [own.lengths[t] - 1 for t in chain] == [back for _, back in here[::-1]]


def test_bpe_keeps_the_words_of_a_slice_of_prose(monkeypatch):
    own, rng = bpe.WordBpe(TOKENIZER), random.Random(12)
    text = " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(150_000)).encode()
    first, spelt = own.encode(text), []
    monkeypatch.setattr(own, "encode_word", spelt.append)
    assert own.encode(text).tolist() == first.tolist() and not spelt
