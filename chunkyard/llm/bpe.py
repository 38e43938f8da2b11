"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary file is of the kind with word ends: text is composed (NFC), white space and case are
folded, words are cut by one pattern, and each word's UTF-8 bytes are symbols of which the last has
the word-end suffix.  For a word, a segment tree holds each adjacent pair's merge rank; its root is
the leftmost pair of the lowest rank.  A merge changes two neighbouring pairs and removes one, each a
logarithmic update, until the root has no rank.  What stands between white space is remembered in
two generations of bounded size, as most of it recurs.

Edge cases: null and empty text give no ids and an empty decoded text; strings of special tokens in a
text become their ids, as the file's library does by default; a word of any length takes
O(n log n); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chunkyard.llm.common import map_slices, text_rows

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.StringType())])
#: Words in each of the two generations of a worker's memory.
REMEMBERED_WORDS = 100_000
#: Longer ones are encoded anew each time.
REMEMBERED_CHARS = 200
NO_RANK = 1 << 62
#: Below this all letters have been in Unicode for long.
_KNOWN_BELOW = "\u0530"
#: Nodes below a node of the tree.
FAN = 16
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, free = [], 256
    for byte in range(256):
        if byte in prints:
            table.append(chr(byte))
        else:
            table.append(chr(free))
            free += 1
    return table


def merge_by_tree(symbols: list[int], rank_of: dict[int, int], made: list[int], bits: int) -> list[int]:
    """The symbols after all merges.  A leaf is a pair's rank and its place in one number, so the least
    is the leftmost pair of the lowest rank.  Each level has the least of every FAN nodes below, up to a
    level of FAN nodes or fewer, whose least is the root; neighbours are a doubly linked list.  A pair's key
    is its left symbol, and its right one in ``bits`` bits."""
    pairs = len(symbols) - 1
    if pairs < 1:
        return symbols
    shift = pairs.bit_length()
    mask = (1 << shift) - 1
    rank = rank_of.get
    leaf = [NO_RANK if (r := rank(a << bits | b)) is None else r << shift for a, b in zip(symbols, symbols[1:])]  # noqa: B905
    leaf = [r + place for place, r in enumerate(leaf)]
    levels = [leaf]
    while len(levels[-1]) > FAN:
        low = levels[-1]
        levels.append([min(low[i : i + FAN]) for i in range(0, len(low), FAN)])
    top = levels[-1]
    after, before = [*range(1, pairs + 1), -1], [*range(-1, pairs)]
    while (root := min(top)) < NO_RANK:
        at = root & mask
        gone = after[at]
        symbols[at] = now = made[root >> shift]
        symbols[gone] = -1
        right = after[at] = after[gone]
        if right >= 0:
            before[right] = at
            r = rank(now << bits | symbols[right])
            leaf[at] = NO_RANK if r is None else r << shift | at
            leaf[gone] = NO_RANK
        else:
            leaf[at] = NO_RANK
        left = before[at]
        if left >= 0:
            r = rank(symbols[left] << bits | now)
            leaf[left] = NO_RANK if r is None else r << shift | left
        if len(levels) > 1:
            touched = {max(left, 0) // FAN, at // FAN, gone // FAN} if right >= 0 else {max(left, 0) // FAN, at // FAN}
            for low, high in zip(levels, levels[1:]):  # noqa: B905
                for i in touched:
                    high[i] = min(low[i * FAN : i * FAN + FAN])
                touched = {i // FAN for i in touched}
    return [s for s in symbols if s >= 0]


class WordBpe:
    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.path, self.folding = path, None
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.token = {i: t for t, i in {**self.vocabulary, **self.special}.items()}
        self.bits = max(self.token).bit_length()
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.rank_of[self.vocabulary[left] << self.bits | self.vocabulary[right]] = rank
            self.made.append(self.vocabulary[left + right])
        self.inner = [self.vocabulary[s] for s in byte_symbols()]
        self.last = [self.vocabulary[s + self.suffix] for s in byte_symbols()]
        self.cut = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.space = regex.compile(r"\p{White_Space}+")
        self.limit, self.young, self.old = remembered, {}, {}

    def chunk(self, chunk: str) -> bytes:
        """The packed ids of text without white space."""
        words = self.cut.findall(chunk)
        return self.word(words[0]) if len(words) == 1 else b"".join([self.recall(w) for w in words])

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        ids = merge_by_tree([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.rank_of, self.made, self.bits)
        return struct.pack(f"<{len(ids)}I", *ids)

    def recall(self, chunk: str) -> bytes:
        if (found := self.young.get(chunk)) is not None:
            return found
        if (found := self.old.get(chunk)) is None:
            found = self.chunk(chunk)
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        """Runs without white space, composed and lower-cased; each is cut into words by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each capital sigma alone, at a word's end too
        if any(c in text for c in _SEPARATORS):  # str.split() takes these four for white space
            return [c for c in self.space.split(text.lower()) if c]
        return text.lower().split()

    def _by_library(self, text: str) -> bytes:
        """With characters that this Python does not know: case and words are the library's, as its Unicode is newer."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        if self.folding is None:
            self.folding = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(self.cut.pattern), "removed", invert=True)
        normal, cut = self.folding
        return b"".join([self.word(w) for w, _ in cut.pre_tokenize_str(normal.normalize_str(text))])

    def encode_plain(self, text: str) -> bytes:
        if text and max(text) > _KNOWN_BELOW and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._by_library(text)
        young, recall = self.young.get, self.recall
        return b"".join([young(c) or recall(c) for c in self.chunks(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, special ones too: this kind of file names no decoder."""
        return " ".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=1)
def shared_bpe(path: str) -> WordBpe:
    """One for all tasks of a Python worker, with what it remembers."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_le (packed ids) and decoded (the text those ids decode to) for every document."""
    path = vocabulary or default_vocabulary()

    def start():
        bpe = shared_bpe(path)

        def step(columns: dict) -> dict:
            ids = [bpe.encode(t) for t in columns["text"]]
            return {"doc_id": columns["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_le": ids, "decoded": [bpe.decode(x) for x in ids]}

        return step

    return map_slices(text_rows(docs), SCHEMA, start)
