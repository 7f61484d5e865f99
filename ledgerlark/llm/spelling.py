"""Spelling variants: words one error apart, found in minimal automata of words and of words spelt backward.

If one inserted, deleted or replaced letter parts two words, one half of either is in the other, at its beginning or at its end. Words
are dealt by such halves. A task builds an automaton of the words that it gets, follows the half exactly and completes with one
error; words spelt backward are dealt by their last half in the same way. Numbers of words along the paths say which was found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import cut, tasks_for

#: Fewest letters and occurrences of a word; a form occurs so many times as often as the word, at least.
LETTERS, OCCURRENCES, MARGIN = 5, 3, 2
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Words of one half that meet in one cell; larger halves are laid out as squares of cells.
CELL_WORDS = 20_000
#: Rows of words, as entries or to be looked up, for one task.
TASK_WORDS = 60_000
#: Every so many runs one is given a deletion, by its checksum.
DELETE_EVERY = 97


def run_counts(text: str, doc_id: str, pattern: re.Pattern, delete_every: int) -> Counter:
    """Words of a text and how often each occurs, short ones left out."""
    found = Counter(pattern.findall(text))
    if delete_every:
        before = zlib.crc32(f"{doc_id}:".encode())
        # All hit runs go before any result comes: a result that is itself a hit run of the text is not hit again.
        hit = [(r, found.pop(r)) for r in list(found) if zlib.crc32(r.encode(), before) % delete_every == 0]
        for run, n in hit:
            at = zlib.crc32(run.encode(), before) % len(run)
            word = run[:at] + run[at + 1 :]
            if len(word) >= LETTERS:
                found[word] += n
    return found


def word_counts(docs: DataFrame, *, delete_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words that have LETTERS letters and OCCURRENCES occurrences in all texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z as a-z. With ``delete_every``, of a document's run whose CRC-32 h of
    identifier, colon and run it divides, the letter h % length goes (this plants misspellings).
    """
    rows = docs.select(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("id"), docs[f"`{text_col}`"].alias("text")).filter("text IS NOT NULL")

    def run(batches):
        pattern = re.compile(rf"[a-zÀ-ÿ]{{{LETTERS},}}")
        held: Counter = Counter()

        def hand_on():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                lowered = bytes(text.as_buffer()).lower().decode()  # of bytes, only A-Z change
                for word, n in run_counts(lowered, doc_id.as_py(), pattern, delete_every).items():
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield from hand_on()
        yield from hand_on()

    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= OCCURRENCES) & (F.length("word") >= LETTERS))


class WordGraph:
    """Minimal acyclic automaton of words that are added in ascending order; each word's number is its place in that order.

    A state's edges lead to (state, number of the words that come before those behind this edge).
    """

    def __init__(self) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.known: dict[tuple, int] = {}
        self.open: list[list] = [[{}, False]]  # states along the last word
        self.last = ""
        self.root = -1

    def add(self, word: str) -> None:
        same = 0
        for a, b in zip(word, self.last, strict=False):
            if a != b:
                break
            same += 1
        self.close(same)
        for _ in word[same:]:
            self.open.append([{}, False])
        self.open[-1][1] = True
        self.last = word

    def close(self, depth: int) -> None:
        """States deeper than ``depth`` get no more edges: equal ones become one."""
        while len(self.open) - 1 > depth:
            state = self.keep(*self.open.pop())
            self.open[-1][0][self.last[len(self.open) - 1]] = state

    def keep(self, targets: dict[str, int], final: bool) -> int:
        key = (final, *targets.items())
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.edges)
            total, edges = int(final), {}
            for letter, target in targets.items():
                edges[letter] = target, total
                total += self.size[target]
            self.edges.append(edges)
            self.final.append(final)
            self.size.append(total)
        return state

    def finish(self) -> None:
        self.close(0)
        self.root = self.keep(*self.open[0])
        self.known, self.open = {}, []

    def follow(self, word: str, end: int) -> tuple[int, int] | None:
        """The state after word[:end] and the number of words passed by."""
        state, number = self.root, 0
        for letter in word[:end]:
            edge = self.edges[state].get(letter)
            if edge is None:
                return None
            state = edge[0]
            number += edge[1]
        return state, number

    def complete(self, state: int, word: str, at: int, number: int, found: set[int]) -> None:
        """Adds the number of the word that word[at:] completes exactly, if there is one."""
        edges = self.edges
        for i in range(at, len(word)):
            edge = edges[state].get(word[i])
            if edge is None:
                return
            state = edge[0]
            number += edge[1]
        if self.final[state]:
            found.add(number)

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with word[:exact] and differ from ``word`` by one error after it."""
        found: set[int] = set()
        start = self.follow(word, exact)
        if start is None:
            return found
        state, number = start
        for i in range(exact, len(word) + 1):
            own = word[i] if i < len(word) else ""
            edges = self.edges[state]
            for letter, (target, passed) in edges.items():
                if letter != own:  # the same letter put in after the run of it gives the same word
                    self.complete(target, word, i, number + passed, found)
                    if own:
                        self.complete(target, word, i + 1, number + passed, found)
            if own and (i == exact or own != word[i - 1]):  # of a run of one letter any may go
                self.complete(state, word, i + 1, number, found)
            edge = edges.get(own)
            if edge is None:
                break
            state = edge[0]
            number += edge[1]
        return found


def search(batches):
    """(word, near, near_n) of rows (back, asks, spelt, half, n) that are sorted by direction, entries before questions, and spelling."""
    graph, entries, counts, back, asking = WordGraph(), [], [], None, False
    flip = lambda w: w[::-1] if back else w
    for batch in batches:
        words, nears, near_n = [], [], []
        for was_back, asks, spelt, half, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if was_back != back:
                graph, entries, counts, back, asking = WordGraph(), [], [], was_back, False
            if not asks:
                if not entries or entries[-1] != spelt:
                    graph.add(spelt)
                    entries.append(spelt)
                    counts.append(n)
                continue
            if not asking:
                graph.finish()
                asking = True
            for number in graph.near(spelt, half):
                words.append(flip(spelt))
                nears.append(flip(entries[number]))
                near_n.append(counts[number])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(nears, pa.string()), pa.array(near_n, pa.int64())], ["word", "near", "near_n"])


def halves(words: DataFrame) -> DataFrame:
    """A row per half that a word is dealt by: back, asks, spelt, half (its length), n and the half's hash.

    A word of n letters asks by its first n // 2 letters and by its others, backward. It is an entry for words that are one letter shorter,
    as long, or one longer, so under the halves of all these lengths.
    """
    rows = []
    length = F.length("word")
    for back, up in ((False, 0), (True, 1)):
        half = lambda k, up=up: F.floor((length + (k + up)) / 2).cast("int")
        others = F.array_distinct(F.array(F.when(length > LETTERS, half(-1)).otherwise(half(0)), half(0), half(1)))
        spelt = F.reverse("word") if back else F.col("word")
        rows.append(F.transform(others, asked(back, False, spelt)))
        rows.append(F.transform(F.array(half(0)), asked(back, True, spelt)))
    out = words.select("n", F.explode(F.concat(*rows)).alias("r")).select("r.*", "n")
    return out.withColumn("key", F.xxhash64("back", F.expr("substring(spelt, 1, half)")))


def asked(back: bool, asks: bool, spelt: Column):
    return lambda half: F.struct(F.lit(back).alias("back"), F.lit(asks).alias("asks"), spelt.alias("spelt"), half.alias("half"))


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n) that one error parts, in both directions, each once.

    Words that share a half meet in one cell. Where more do than a cell takes, entries and questions are cut into slices by hash and each
    slice of one meets each of the other, so nothing is lost and no task holds more.
    """
    rows = halves(words)
    sizes = rows.filter("NOT asks").groupBy("key").agg(F.ceil(F.count("*") / cell_words).cast("int").alias("slices")).filter("slices > 1")
    # At most one of these for each cell_words rows.
    rows = rows.join(F.broadcast(sizes), "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own, other = F.pmod(F.xxhash64("spelt"), F.col("slices")), F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    rows = rows.withColumns({"own": own}).withColumn("other", other)
    cell = F.xxhash64("key", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")))
    tasks = tasks_for(6 * words.count(), TASK_WORDS)
    rows = rows.select("back", "asks", "spelt", "half", "n", cell.alias("cell")).repartition(tasks, "cell").drop("cell")
    rows = rows.sortWithinPartitions("back", "asks", "spelt")
    return rows.mapInArrow(search, "word string, near string, near_n bigint").dropDuplicates(["word", "near"])


def follow_forms(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form): where following forms from the word ends.

    Each round doubles how far a row has followed. A form occurs at least twice as often as its word, so there are no
    circles, and chains are as long as the logarithm of the largest count.
    """
    links = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = cut(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("more")))
        if links.filter("more").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of ``words`` (word, n), which are distinct.

    form is the near word with the largest n (of equal ones the first in code-point order) if it has MARGIN times the word's n, else
    null; root is where following forms ends, the word itself without one. Without near words n_near is 0. An empty table gives an empty one.
    """
    words = cut(words.select("word", "n"))
    best = near_words(words, cell_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    likes = F.col("n") * MARGIN <= -F.col("best.less")
    known = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likes, F.col("best.near")).alias("form"), F.when(likes, -F.col("best.less")).alias("form_n"),
    ))
    roots = follow_forms(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, *, delete_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of all texts; see ``word_counts`` and ``variants``.

    Null and empty texts have no words; a null identifier is written as nothing. Repeated rows count each time. Texts and words may be of any
    length that fits a task. Other columns are not looked at, whatever their names.
    """
    return variants(word_counts(docs, delete_every=delete_every, id_col=id_col, text_col=text_col))
