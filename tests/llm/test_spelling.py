import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlark.llm import queries, spelling
from tests.helpers import HAVE_DATA, SF
from tests.llm.fixtures import SCHEMA, documents


def distance_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def near_pairs(words):
    """By lists of words with one letter left out: these meet for any two that one error parts."""
    meet = defaultdict(set)
    for w in words:
        meet[w].add(w)
        for i in range(len(w)):
            meet[w[:i] + w[i + 1 :]].add(w)
    return {(a, b) for group in meet.values() for a in group for b in group if distance_one(a, b)}


def brute_counts(rows, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(counts):
    near = defaultdict(list)
    for a, b in near_pairs(counts):
        near[a].append(b)
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted((w, forms[w], root(w), n, len(near[w]), counts.get(forms[w])) for w, n in counts.items())


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def made_words(rng, n, letters="abcéÿ"):
    found = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(n)}
    return found | {"aaaaa" * k for k in range(1, 5)} | {"a" * k for k in range(5, 12)} | {"ab" * 40, "ab" * 40 + "a", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}


def test_automaton_is_minimal_and_numbers_words():
    words = sorted(made_words(random.Random(1), 400))
    graph = spelling.WordGraph()
    for w in words:
        graph.add(w)
    graph.finish()
    for number, w in enumerate(words):
        state, passed = graph.follow(w, len(w))
        assert graph.final[state] and passed == number
    # No two states accept the same endings.
    assert len({(f, *((c, t) for c, (t, _) in e.items())) for f, e in zip(graph.final, graph.edges, strict=True)}) == len(graph.edges)
    assert graph.size[graph.root] == len(words)
    for w in words:
        for exact in {0, len(w) // 2}:
            want = {i for i, v in enumerate(words) if distance_one(w, v) and v[:exact] == w[:exact] and distance_one(w[exact:], v[exact:])}
            assert graph.near(w, exact) == want


@pytest.mark.parametrize("cell_words", [spelling.CELL_WORDS, 7])
def test_variants(spark, cell_words):
    rng = random.Random(2)
    counts = {w: rng.choice([3, 4, 5, 6, 7, 12, 24, 24, 100, 1000]) for w in made_words(rng, 1500)}
    counts |= {f"shared{w}": 3 for w in made_words(rng, 200, "ab")}  # one half of very many words
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(df, cell_words)) == brute_variants(counts)


def test_chains_of_forms(spark):
    counts = {"a" * (5 + k): 3 * 2**k for k in range(12)} | {"zzzzz": 3}
    got = rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[2] for r in got} == {"a" * 16, "zzzzz"} and got == brute_variants(counts)


def test_texts(spark, monkeypatch):
    texts = [None, "", "Éclair éclair ÉCLAIR ×÷×÷× naïve_naïve-NAÏVE", "ab1cdefg hij́klm abcdeſ", "color colour " * 30, "w" * 70_000] * 5
    docs = documents(spark, [*texts, *[f"recieve receive receive{'s' * (i % 3)} {'long' * 300}" for i in range(40)]])
    docs = docs.union(docs.limit(1).selectExpr("CAST(NULL AS bigint)", "'receive receive colour'", *docs.columns[2:]))
    for held in (spelling.HELD_WORDS, 3):
        monkeypatch.setattr(spelling, "HELD_WORDS", held)
        want = brute_variants(brute_counts([(r.doc_id, r.text) for r in docs.collect()]))
        assert rows_of(spelling.spelling_variants(docs, delete_every=97)) == want and len(want) > 5
    want = brute_counts([(r.doc_id, r.text) for r in docs.collect()], every=1 << 40)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want


def test_a_result_that_is_a_hit_run_of_its_text_is_not_hit_again(spark):
    def hit(doc_id, run):
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        return None if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]

    rng = random.Random(5)
    made = ((d, "".join(rng.choice("abcdefgh") for _ in range(8))) for d in range(10**6))
    doc_id, run, shorter = next((d, r, s) for d, r in made if (s := hit(d, r)) and hit(d, s))
    texts = [(doc_id, f"{run} {run} {run} {shorter} {shorter} {shorter} {shorter}")]
    want = brute_variants(brute_counts(texts))
    assert {(r[0], r[3]) for r in want} == {(shorter, 3), (hit(doc_id, shorter), 4)}
    assert rows_of(spelling.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string"), delete_every=97)) == want


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")
def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    assert rows_of(queries.QUERIES["op12_spelling_variants"](spark, SF)) == brute_variants(brute_counts(rows))
