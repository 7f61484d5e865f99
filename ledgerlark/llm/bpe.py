"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table."""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Entries of the newer half of each cache of a worker. At most twice as many are kept, each of CACHE_BYTES at most, so
#: the three caches of a worker take some 250 MB whatever the input.
CACHE_WORDS, CACHE_BYTES = 200_000, 100
#: Entries that a worker keeps between tasks, as it may work on other operators then.
IDLE_WORDS = 10_000
#: Rows that are held as Python objects at a time.
SLICE_ROWS = 256
END = ""  # a word's end; no byte symbol is this character
ENDLESS = 1 << 40


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one free from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Recent(dict):
    """A dict of recent entries: when it is full, they become ``older``, in place of those before. A hit there renews the entry."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def shrink(self) -> None:
        """Leaves the first entries only, which common words have."""
        self.older = {}
        for key in list(self)[IDLE_WORDS:]:
            del self[key]
        rest = dict(self)
        self.clear()  # a dict's own table shrinks only so
        self.update(rest)


class WordBpe:
    """A tokenizer file with word ends: NFC, lower case, words by pattern, byte symbols, merges by rank.

    A sequence of tokens is what merging by rank gives exactly if every two neighbours are compatible, so
    a word is tiled from the left with the longest token that is compatible with the one before; where none is,
    that place is closed and the tile before is shortened. Each place is closed once at most.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        # The library's \s; that of this module differs in control characters.
        space = r"\t-\r \x85\xa0  -     　"
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{space}\p{{L}}\p{{N}}]+")
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.formed: dict[int, int] = {}
        for at, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = vocab[left + right]
            pair = vocab[left], vocab[right]
            self.rank[pair] = at
            self.halves[whole], self.formed[whole] = pair, at
        self.matcher = ahocorasick.Automaton()
        spelt = {token[: -len(suffix)] + END if token.endswith(suffix) and len(token) > len(suffix) else token: number for token, number in vocab.items()}
        for word, number in spelt.items():
            self.matcher.add_word(word, (number, len(word) - 1))
        self.matcher.make_automaton()
        # Of each token its length, and the longest token that is a part of its beginning, or -1.
        self.lengths, self.shorter = [0] * (max(vocab.values()) + 1), [-1] * (max(vocab.values()) + 1)
        for word, number in spelt.items():
            self.lengths[number] = len(word)
            self.shorter[number] = next((spelt[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in spelt), -1)
        self.pairs, self.known, self.spelt = Recent(), Recent(), Recent()
        strings = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.added.items()}}
        spelled = [(strings.get(i, "") + " ").encode() for i in range(max(strings) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` side by side.

        Grows the tokens at the border in the order in which merges form them; the border falls if the two that
        touch at some time have a merge that comes first (of equal ranks, the one further left comes first).
        """
        found = self.pairs[left << 32 | right]
        if found is None:
            a, b = [left], [right]
            while a[-1] in self.halves:
                a.append(self.halves[a[-1]][1])
            while b[-1] in self.halves:
                b.append(self.halves[b[-1]][0])
            while True:
                next_a = self.formed[a[-2]] if len(a) > 1 else ENDLESS
                next_b = self.formed[b[-2]] if len(b) > 1 else ENDLESS
                border = self.rank.get((a[-1], b[-1]), ENDLESS)
                if border < next_a and border <= next_b and border < ENDLESS:
                    found = False
                    break
                if len(a) == len(b) == 1:
                    found = True
                    break
                (a if next_a <= next_b else b).pop()
            self.pairs.put(left << 32 | right, found)
        return found

    def encode_word(self, word: str) -> list[int]:
        """Token ids of a word that is given in byte symbols."""
        n = len(word) + 1
        longest = [-1] * (n + 1)
        for last, (token, back) in self.matcher.iter(word + END):
            longest[last - back] = token  # longer ones come later
        is_open = bytearray(b"\x01") * (n + 1)
        is_open[n - 1] = 0  # the end alone is no token
        pairs, lengths, shorter = self.pairs, self.lengths, self.shorter
        tiles: list[int] = []
        before, at, token = -1, 0, longest[0]
        while at < n:
            while token >= 0:
                after = at + lengths[token]
                if is_open[after]:
                    fits = before < 0 or pairs[before << 32 | token]
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        tiles.append(token)
                        before, at, token = token, after, longest[after]
                        break
                token = shorter[token]
            else:
                is_open[at] = 0
                before = tiles.pop()
                at -= lengths[before]
                token, before = shorter[before], tiles[-1] if tiles else -1
        return tiles

    def encode_chunk(self, chunk: bytes) -> bytes:
        """Ids of text without ASCII spaces, as little-endian 32-bit integers."""
        text = chunk.decode("utf-8", "replace")
        if self.added_pattern.search(text) is None:
            return self.encode_plain(text)
        ids: list[bytes] = []
        for part in self.added_pattern.split(text):
            ids.append(self.added[part].to_bytes(4, "little") if part in self.added else self.encode_plain(part))
        return b"".join(ids)

    def encode_plain(self, part: str) -> bytes:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
        part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
        out = []
        for word in self.words.findall(part):
            found = self.spelt[word]
            if found is None:
                plain = word.isascii() and word.isalnum()  # each byte then stands for itself
                found = array("i", self.encode_word(word if plain else "".join([self.symbols[b] for b in word.encode()]))).tobytes()
                if len(word) <= CACHE_BYTES:
                    self.spelt.put(word, found)
            out.append(found)
        return b"".join(out) if len(out) != 1 else out[0]

    def encode(self, text: bytes) -> np.ndarray:
        known, out = self.known, []
        for chunk in text.split():  # at ASCII spaces, which no word holds
            ids = known[chunk]
            if ids is None:
                ids = self.encode_chunk(chunk)
                if len(chunk) <= CACHE_BYTES:
                    known.put(chunk, ids)
            out.append(ids)
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings with one space between them."""
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self.spelling[where].tobytes()[:-1]


@lru_cache(maxsize=1)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text and the text that they decode to.

    ``path`` is a tokenizer file that every executor has. Null and empty texts have no ids and decode to
    the empty text. Rows are encoded where they are, without a shuffle, a few at a time. Existing columns named
    like the new ones are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (ids_col, decoded_col)]
    schema = StructType([*kept, StructField(ids_col, ArrayType(IntegerType(), False)), StructField(decoded_col, StringType())])
    docs = docs.select(*[f"`{f.name}`" for f in kept])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = part.column(part.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
                ids = [bpe.encode(t or b"") for t in texts]
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                decoded = pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, decoded], [*part.schema.names, ids_col, decoded_col])
        for cache in (bpe.pairs, bpe.known, bpe.spelt):
            cache.shrink()

    return docs.mapInArrow(run, schema)
