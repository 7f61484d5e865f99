"""Line-first quality rules, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import SPACES, WORD

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line of prose ends in one of these, quotes and brackets after it allowed.
LINE_END = r"[.!?:;…。！？]['\")\]»”’*_]*$"
SHOUTS = r"[!?][!?]+"
MENU = r"[|»›>·•]"
BOILERPLATE = (
    r"(?i)(cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|licensed under|"
    r"general public license|under the mit license|click here|subscribe now|sign (in|up) |log in to|follow us)"
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def line_fails(line: Column) -> Column:
    """Whether a line that has words fails: no sentence end, a menu, shouting or boilerplate."""
    line = F.btrim(line, F.lit(BLANKS))
    return (
        ~line.rlike(LINE_END)
        | (F.regexp_count(line, F.lit(MENU)) >= 3)
        | (F.regexp_count(line, F.lit(SHOUTS)) >= 3)
        | line.rlike(BOILERPLATE)
    )


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_words and n_repeat_words for the array column ``words``.

    n_repeat_words counts words in windows of three words that the text has twice or more. A window's hash and
    place are one number each; sorted, windows that may be equal are neighbours. Those few are then compared as
    words, so the count is exact.
    """
    n = F.col("n_words")
    top = F.floor(F.lit(9e18) / F.greatest(n, F.lit(1)))
    key = lambda i: F.pmod(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)), top) * n + i
    places = F.sequence(F.lit(0), (n - 3).cast("int"))
    df = df.withColumn("n_words", F.size("words").cast("bigint"))
    df = df.withColumn("_keys", F.when(n >= 4, F.sort_array(F.transform(places, key))))
    near = F.expr(
        "filter(_keys, (x, k) -> (k > 0 AND x div n_words = get(_keys, k - 1) div n_words)"
        " OR (k < size(_keys) - 1 AND x div n_words = get(_keys, k + 1) div n_words))"
    )
    df = df.withColumn("_near", near)
    df = df.withColumn(
        "_spelt",
        F.expr(
            "CASE WHEN size(_near) > 0 THEN array_sort(transform(_near, x -> named_struct("
            "'t', concat_ws(' ', get(words, CAST(x % n_words AS INT)), get(words, CAST(x % n_words AS INT) + 1), get(words, CAST(x % n_words AS INT) + 2)),"
            "'p', x % n_words))) END"
        ),
    )
    df = df.withColumn(
        "_places",
        F.expr(
            "array_sort(transform(filter(_spelt, (x, k) -> (k > 0 AND x.t = get(_spelt, k - 1).t)"
            " OR (k < size(_spelt) - 1 AND x.t = get(_spelt, k + 1).t)), x -> x.p))"
        ),
    )
    covered = F.expr(
        "aggregate(_places, named_struct('last', -3L, 'sum', 0L),"
        " (a, p) -> named_struct('last', p, 'sum', a.sum + least(3L, p - a.last)), a -> a.sum)"
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_keys", "_near", "_spelt", "_places")


def judge(
    docs: DataFrame,
    *,
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """``docs`` with a struct column ``quality`` (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    kept_chars, cleaned).

    Each line with a word is judged by itself; ``cleaned`` is the text without those that fail, and a
    document whose lines keep less than ``min_kept_percent`` of its word characters is rejected, as is one with
    fewer than ``min_words`` words or more than ``max_repeat_percent`` of them in repeated three-word windows.

    A null or empty text has no words, fails, and its ``cleaned`` is empty. Every row gets its own verdict, so
    ties and repeated rows need no rule. Columns may have any names; one named ``quality`` is replaced. Nothing is shuffled;
    one row is judged within one task.
    """
    n_cols = docs.columns
    text = F.col("_text")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in n_cols]).alias("_doc"))  # so that no name clashes
    df = df.withColumn("_text", F.coalesce(F.col("_doc")[text_col], F.lit(""))).withColumn("words", _words(text))
    df = with_repeats(df).drop("words")
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("_good", F.filter(F.split("_text", "\n"), lambda x: ~x.rlike(WORD) | ~line_fails(x)))

    def chars(column: Column) -> Column:
        for blank in BLANKS:
            column = F.replace(column, F.lit(blank), F.lit(""))
        return F.length(column).cast("bigint")

    cleaned = F.array_join("_good", "\n")
    df = df.withColumn("_cleaned", cleaned).withColumn("word_chars", chars(text)).withColumn("kept_chars", chars(F.col("_cleaned")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    quality = F.struct(
        "n_words", "word_chars",
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * F.col("kept_chars") >= min_kept_percent * F.col("word_chars"))).alias("kept"),
        "kept_chars", F.col("_cleaned").alias("cleaned"),
    )
    # A row generator, so that later filters on the verdict don't evaluate the arrays again.
    return df.select("_doc", F.explode(F.array(quality)).alias("quality")).select(*[F.col("_doc")[c].alias(c) for c in n_cols if c != "quality"], "quality")
