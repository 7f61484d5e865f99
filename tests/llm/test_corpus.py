import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import bpe, chat, exact_dedup, mixing, quality, queries, setjoin, sharding
from tests.helpers import HAVE_DATA, SF
from tests.llm.fixtures import SCHEMA, documents
from tests.llm.test_sets import brute_components, shingle_set
from tests.llm.test_texts import TOKENIZER, norm

MESSAGES = "tree long, node long, parent long, score double, role string, text string, rank string, pos string"


# -- chat


def brute_paths(rows):
    nodes = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows}
    out = {}
    for (tree, node), _ in nodes.items():
        if (tree, node) in parents:
            continue
        path, at = [], (tree, node)
        while at in nodes and at[1] not in path:
            path.append(at[1])
            at = (tree, nodes[at][2])
        if at not in nodes:
            out[tree, node] = (sum(nodes[tree, n][3] or 0 for n in path), path[::-1])
    return out


@pytest.mark.parametrize("top", [None, 1, 2])
def test_reply_trees(spark, top):
    rng = random.Random(4)
    rows = []
    for tree in range(6):
        rows += [(tree, n, rng.randrange(n) if n and rng.random() < 0.9 else rng.choice([None, 99]), rng.choice([None, 1.0, 2.0, 5.0]), "user", "t", "r", "p") for n in range(25)]
    rows += [(7, n, n - 1 if n else None, 1.0, "user", "t", "r", "p") for n in range(70)] + [(8, 1, 2, 1.0, "user", "t", "r", "p"), (8, 2, 1, 1.0, "user", "t", "r", "p")]
    want = brute_paths(rows)
    if top:
        best = {}
        for (tree, leaf), (score, _) in want.items():
            best.setdefault(tree, []).append((-score, leaf))
        keep = {(tree, leaf) for tree, found in best.items() for _, leaf in sorted(found)[:top]}
        want = {k: v for k, v in want.items() if k in keep}
    got = {}
    for r in chat.leaf_paths(spark.createDataFrame(rows, MESSAGES), top=top).collect():
        got.setdefault((r.tree, r.leaf), {})[r.pos] = r.node
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\[INST]", "\\\\</s>", "ends \\", "[INST] ", "", None, "<s>\n[/ROLE] x [ROLE]", "[/MSG]", "ä😀[OUT]", "x" * 50_000]
    roles = ["user", "assistant", "system", "tool", "a [/ROLE] b", None]
    rows = [(c, t, roles[(c + t) % 6], nasty[(c * 3 + t) % len(nasty)]) for c in range(12) for t in range(9)] + [(50, 0, "user", "x"), (50, 0, "user", "x")]
    messages = chat.conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = chat.format_paths(chat.leaf_paths(messages), messages)
    done = done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.tree: r for r in done.collect()}
    for c in range(12):
        own = [(role or "", text or "") for conv, _, role, text in rows if conv == c]
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert got[c].loss == "".join(text for role, text in own if role == "assistant")
    assert got[50].n_turns == 2 and len(got) == 13


def test_chat_of_nothing(spark):
    messages = chat.conversation_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.format_paths(chat.leaf_paths(messages), messages).count() == 0


# -- mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            held |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            held[s] = float(most * sizes[s])
        left -= sum(held[s] for s in over)
        free -= over
    return held


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 500, None: 7}, {"a": 0, "b": 0}, {"a": 5}, {"a": 1, "b": 1, "c": 1000, "d": 1}])
def test_water_filling(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == brute_targets(sizes)


@pytest.mark.parametrize("slices", [1, 64])
def test_mix_takes_what_targets_say(spark, slices):
    docs = documents(spark)
    got = mixing.mix(docs, slices=slices).collect()
    assert len(got) == docs.count()
    size, taken = {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(size)
    assert {s: abs(taken[s] - want[s]) <= 0.5001 for s in want} == {s: True for s in want}
    again = sorted(map(tuple, mixing.mix(docs.repartition(7), slices=slices).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)


def test_mix_of_nothing_and_of_other_columns(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    repeated = mixing.repeat_rows(documents(spark))
    assert repeated.columns == documents(spark).columns and repeated.count() > 0


# -- sharding


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3)])
def test_hilbert_curve_moves_by_one_cell(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = sharding.hilbert_index(points, bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("count", [0, 1, 5, 35])
def test_shards_are_even(spark, count):
    from tests.llm.fixtures import awkward_texts

    rows = sharding.document_shards(documents(spark, awkward_texts()[:count], repeat=count > 10)).collect()
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(s == list(range(len(s))) for s in sizes) and sum(map(len, sizes)) == len(rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in rows)


# -- pipeline


def test_stages(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumn("n_chars", F.col("n_chars"))
    good = corpus_pipeline.quality_rules(spark, docs, "")
    verdict = {r.doc_id: r.quality for r in quality.judge(docs).collect()}
    assert sorted((r.doc_id, r.text) for r in good.collect()) == sorted((r.doc_id, verdict[r.doc_id].cleaned) for r in docs.collect() if verdict[r.doc_id].kept)
    once = corpus_pipeline.exact_copies(spark, good, "").cache()
    first = {}
    for r in good.collect():
        first[norm(r.text)] = min(r.doc_id, first.get(norm(r.text), r.doc_id))
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())
    near = corpus_pipeline.near_copies(spark, once, "").cache()
    parts = brute_components({r.doc_id: shingle_set(r.text) for r in once.collect()})
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(parts.values()))
    mixed = corpus_pipeline.source_mix(spark, near, "").cache()
    times = {r.doc_id: r.epochs + (2 * r.extra >= r.size > 0 and r.extra > 0) for r in mixing.mix(near).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in times.items() if v}
    own = bpe.load(TOKENIZER)
    for r in corpus_pipeline.tokens(spark, mixed, "").join(mixed.select("doc_id", "text").distinct(), "doc_id").collect():
        assert list(r.ids) == own.encode(r.text.encode()).tolist() and r.n_tokens == len(r.ids)


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")
def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    assert exact_dedup.SALTS and setjoin.LIGHT


def test_chat_of_a_null_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", None), (None, 2, None, "c")]
    messages = chat.conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = chat.format_paths(chat.leaf_paths(messages), messages)
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in done.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got == {None: [("user", "a"), ("assistant", "b"), ("", "c")], 3: [("user", "")]}


@pytest.mark.skipif(not HAVE_DATA, reason="no driver tables")
def test_op5_on_the_tables_by_brute_force(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in queries.documents(spark, SF).collect()}
    rows = queries.QUERIES["op5_hilbert_shards"](spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in texts.items()}
    place = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in place] == sorted(r.hilbert for r in rows)
    assert [r.shard for r in place] == sorted(i * 8 // len(rows) for i in range(len(rows))) and len(rows) % 8 == 0
