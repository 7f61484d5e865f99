"""The operators over the driver's tables, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, chat, exact_dedup, fuzzy_lines, infill, language, mixing, quality, records, setjoin, sharding, spelling, substrings
from ledgerlark.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register(
    "op1_reply_trees",
    r"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, length(regexp_replace(text, '(<s>|</s>|\[/?INST\]|\[/?SYS\]|\[OUT\]|\[/?ROLE\]|\[/MSG\])', '\\\1', 'g'))
      + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 11 ELSE 23 + length(role) END AS chars FROM m)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id""",
)
def op1_reply_trees(spark, sf_dir):
    control = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    messages = chat.conversation_messages(rows.union(extra))
    done = chat.format_paths(chat.leaf_paths(messages), messages)
    done = done.withColumn("turns", chat.read_back(F.col("formatted")))
    done = done.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@register("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    return setjoin.similar_components(documents(spark, sf_dir))


@register("op3_language_spans")
def op3_language_spans(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(0))
    model = language.fit(docs.filter(fold != 2).select("doc_id", "lang", "text"))
    done = language.label_documents(docs.select("doc_id", (fold == 2).alias("held_out"), "text"), model)
    return done.select("doc_id", "held_out", "lang_pred", "score")


@register("op4_mix_sources")
def op4_mix_sources(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@register("op5_hilbert_shards")
def op5_hilbert_shards(spark, sf_dir):
    return sharding.document_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


@register(
    "op6_line_rules",
    rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    tri AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) > 3),
    spelt AS (SELECT doc_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS s FROM tri),
    dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM spelt) WHERE c > 1),
    cov AS (SELECT doc_id, CAST(sum(least(3, p - before)) AS BIGINT) AS r FROM
        (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -3) AS before FROM dup) GROUP BY doc_id),
    ln AS (SELECT doc_id, l, regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS b FROM
        (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)),
    judged AS (SELECT doc_id, l, b <> '' AS filled,
        b = '' OR NOT (NOT regexp_matches(b, '[.!?:;…。！？][''")\]»”’*_]*$')
          OR len(regexp_extract_all(b, '[|»›>·•]')) >= 3 OR len(regexp_extract_all(b, '[!?][!?]+')) >= 3
          OR regexp_matches(b, '{quality.BOILERPLATE}')) AS good FROM ln),
    doc AS (SELECT doc_id, sum(CASE WHEN good THEN length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) ELSE 0 END) AS kept_chars,
        CAST(count(*) FILTER (WHERE filled) - count(DISTINCT l) FILTER (WHERE filled) AS BIGINT) AS n_dup_lines FROM judged GROUP BY doc_id),
    f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(r, 0) AS n_repeat_words, kept_chars
        FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN doc USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept FROM f""",
)
def op6_line_rules(spark, sf_dir):
    verdicts = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return verdicts.select("doc_id", *[F.col(f"quality.{f}") for f in fields])


@register(
    "op7_content_sort",
    r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY norm)""",
)
def op7_content_sort(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@register("op8_fuzzy_lines")
def op8_fuzzy_lines(spark, sf_dir):
    done = fuzzy_lines.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op9_repeated_substrings")
def op9_repeated_substrings(spark, sf_dir):
    done = substrings.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))


@register("op10_backtracking_bpe")
def op10_backtracking_bpe(spark, sf_dir):
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    done = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register(
    "op11_fill_in_middle",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    d AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
        CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM p""",
)
def op11_fill_in_middle(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    h1, h2, h3, h4 = infill.draws(docs["doc_id"])
    done = infill.fill_in_middle(docs, h1, h2, plain=h3 % 100 >= 90, spm=h4 % 100 < 20)
    return done.select(
        "doc_id", "infill.n", "infill.form", F.col("infill.prefix_units").alias("prefix_chars"), F.col("infill.middle_units").alias("middle_chars"),
        F.sha2("infill.output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("infill.output"), F.col("infill.form")), 256).alias("restored_sha256"),
    )


@register("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    done = spelling.spelling_variants(documents(spark, sf_dir).select("doc_id", "text"), delete_every=spelling.DELETE_EVERY)
    return done.select("word", "form", "root", "n", "n_near", "form_n")


@register("op13_record_files")
def op13_record_files(spark, sf_dir):
    import public_tokenizers

    folder = shared_folder(spark, "records")
    records.write_records(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    starts = F.broadcast(records.file_starts(spark.read.parquet(f"{folder}/index")))  # one row per file
    return records.read_records(spark, folder).join(starts, "file").select(
        "doc_id", (F.col("ahead") + F.col("before")).alias("start"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
