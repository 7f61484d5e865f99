"""A corpus pipeline of the operators in ``ledgerlark.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for the last, returns
the columns of ``documents``. SQL can express neither the mix's seeded order nor the encoding, so there is no SQL for the result.

For all stages: an empty table stays empty; columns besides those of ``documents`` are left out, whatever their names; texts are
worked on whole, and one text has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, exact_dedup, mixing, quality, setjoin
from ledgerlark.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines.

    Null and empty texts have no words and go. Repeated rows and ties are judged row by row, alike. Null lang and source stay null.
    """
    judged = quality.judge(docs.select(*COLUMNS)).filter("quality.kept")
    text = F.col("quality.cleaned")
    return judged.withColumns({"text": text, "n_chars": F.length(text).cast("bigint")}).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest identifier.

    Null and empty texts are equal. A null identifier comes before others. Of rows with equal text and identifier one stays.
    """
    return exact_dedup.drop_exact_copies(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest identifier.

    Null and empty texts are similar to nothing and stay, as do rows without an identifier. Rows that share the identifier that
    stays all stay.
    """
    return setjoin.drop_similar(docs).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null sources are one source. Null and empty texts have no words and are taken as often as their source is, whole times. Rows alike in
    identifier, source and words are taken alike; ties in the seeded order go by identifier.
    """
    return mixing.repeat_rows(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each row, repeated rows included; null and empty texts have no ids."""
    import public_tokenizers

    done = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents. What a stage gives is written once to the shared checkpoint folder, as stages read it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
