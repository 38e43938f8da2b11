"""Benchmark decontamination: one automaton over the test items' word windows, one pass over each text.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased.  A window
is ``width`` consecutive words of an item, or all words of an item that has fewer.  Text is brought
to the same form bytewise (every byte of a non-ASCII character is a word byte), scanned once, and
only texts with a match are tokenised again to map matches to offsets of the original.

The windows of one automaton have ``AUTOMATON_BYTES`` bytes at most, on average; a byte makes one node, of some
56 bytes, at most.  Items are cut into overlapping pieces, so that one long item divides as well as many do.
Pieces beyond one automaton go to several shards in the shared folder, and a task takes one shard after
another over each stretch of its texts: a document is read once, rows are never joined, and the number of
shards changes no result.

Edge cases: null or empty text has no words and no hits; items without words and items with a null
id give no window; repeated items count once; rows with one or no doc_id are judged each by its own text; an
empty table gives no rows; an empty item table hits nothing; other columns of either table are ignored (and kept
by ``drop_contaminated``).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkyard.llm.common import batches_of, file_system, map_slices, scratch_path, slices, stage, text_rows

WIDTH = 8
#: Bytes of the windows of one automaton, on average.
AUTOMATON_BYTES = 4 << 20
#: Windows of a piece of an item, at most.
PIECE_WINDOWS = 256
#: Texts scanned together by one shard after another: bytes, if there are several shards.
STRETCH_BYTES = 64 << 20
#: Over the text as it is, so with A-Z among the word characters.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item_id", T.StringType())]))
RUNS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FORM).split()


def merged(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(marks):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def cut_items(items: DataFrame, width: int) -> DataFrame:
    """item_id (as text), piece (space-joined words) and size (bytes of its windows) of the different pieces of the items."""
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("piece", T.BinaryType()), T.StructField("size", T.LongType())])

    def start():
        def step(columns: dict) -> dict:
            out: dict = {"item_id": [], "piece": [], "size": []}
            for item_id, text in zip(columns["item_id"], columns["text"], strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - width + 1) if words else 0, PIECE_WINDOWS):
                    piece = b" ".join(words[at : at + PIECE_WINDOWS + width - 1])
                    for c, v in zip(out.values(), (item_id, piece, min(width, piece.count(b" ") + 1) * (len(piece) + 2)), strict=True):
                        c.append(v)
            return out

        return step

    kept = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    return map_slices(kept, schema, start).dropDuplicates(["item_id", "piece"])


def automaton_of(pieces: list[tuple[str, bytes]], width: int):
    """Over window text (one space around every word, one character per byte), each with its words and the ids of its items."""
    import ahocorasick

    found: dict[bytes, set[str]] = defaultdict(set)
    for item_id, piece in pieces:
        words = piece.split()
        for i in range(max(1, len(words) - width + 1)):
            found[b" ".join(words[i : i + width])].add(item_id)
    automaton = ahocorasick.Automaton()
    for text, ids in found.items():
        automaton.add_word(f" {text.decode('latin-1')} ", (text.count(b" ") + 1, tuple(sorted(ids))))
    automaton.make_automaton()
    return automaton if found else None


class Shards:
    """The pieces of the items: one list, or one folder a shard where all executors reach it."""

    def __init__(self, items: DataFrame, width: int, automaton_bytes: int):
        pieces = stage(cut_items(items, width), "item-pieces")
        size = pieces.agg(F.sum("size")).first()[0] or 0
        self.width, self.count = width, max(1, -(-size // automaton_bytes))
        if self.count == 1:  # at most ``automaton_bytes``, and an eighth of that as text
            self.pieces = [(r.item_id, bytes(r.piece)) for r in pieces.collect()]
            return
        self.path = scratch_path(items.sparkSession, "item-shards")
        dealt = pieces.select("item_id", "piece", F.pmod(F.xxhash64("item_id", "piece"), F.lit(self.count)).alias("shard"))
        dealt.repartition("shard").write.partitionBy("shard").parquet(self.path)

    def _read(self, k: int) -> list[tuple[str, bytes]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = file_system(f"{self.path}/shard={k}")
        out = []
        for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if x.base_name.endswith(".parquet"):
                with system.open_input_file(x.path) as source:
                    table = pq.read_table(source, columns=["item_id", "piece"])
                out += zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)
        return out

    def scanner(self) -> Callable[[list[str]], list[tuple]]:
        """From texts to what ``found_in`` gives of each."""
        if self.count == 1:
            automaton = automaton_of(self.pieces, self.width)
            search = lambda line: automaton.iter(line) if automaton else ()
            return lambda texts: [found_in(t, n, line, [*search(line)]) for t in texts for n, line in [line_of(t)]]

        def scan(texts: list[str]) -> list[tuple]:
            lines, matches = [line_of(t) for t in texts], [[] for _ in texts]
            for k in range(self.count):
                if automaton := automaton_of(self._read(k), self.width):
                    for own, (_, line) in zip(matches, lines, strict=True):
                        own += automaton.iter(line)
            return [found_in(t, n, line, own) for t, (n, line), own in zip(texts, lines, matches, strict=True)]

        return scan

    @property
    def stretch(self) -> tuple[int, int]:
        """Rows and bytes of the texts to scan together."""
        return (512, 16 << 20) if self.count == 1 else (1 << 20, STRETCH_BYTES)


def line_of(text: str) -> tuple[int, str]:
    """How many words, and the words with one space around each, one character per byte."""
    words = words_of(text)
    return len(words), f" {b' '.join(words).decode('latin-1')} " if words else ""


def found_in(text: str, n_words: int, line: str, matches: list) -> tuple[int, list, list, list]:
    """Words; word runs hit, as [first, last); ids of the items found; spans of the original text, none of an item touching."""
    if not matches:
        return n_words, [], [], []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
    ends = np.searchsorted(spaces, [end for end, _ in matches])
    at = [m.span() for m in _WORD.finditer(text)]
    marks: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for last, (_, (length, ids)) in zip(ends.tolist(), matches, strict=True):
        for item_id in ids:
            marks[item_id].append((last - length, last))
    by_item = {i: merged(marks[i]) for i in sorted(marks)}
    spans = [{"start": at[a][0], "end": at[b - 1][1], "item_id": i} for i, found in by_item.items() for a, b in found]
    return n_words, [{"first": a, "last": b} for a, b in merged([m for found in by_item.values() for m in found])], [*by_item], spans


def _stretches(batches: Iterator[pa.RecordBatch], shards: Shards) -> Iterator[pa.RecordBatch]:
    """The batches cut, or put together, to what is scanned at once."""
    rows, most = shards.stretch
    if shards.count == 1:
        for batch in batches:
            yield from slices(batch, rows, most)
        return
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, rows, most):
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, spans (offsets in code points, end exclusive) for every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(Shards(items, width, automaton_bytes))
    arrow = to_arrow_schema(SCHEMA)

    def run(batches):
        scan = shipped.value.scanner()
        for part in _stretches(batches, shipped.value):
            found = zip(*scan(part.column(1).to_pylist()), strict=True)
            columns = dict(zip(("n_words", "runs", "item_ids", "spans"), map(list, found), strict=True))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), **columns}, schema=arrow)

    start_new = "aggregate(array_sort(runs), struct(cast(0 as bigint) as n, cast(0 as bigint) as upto), (a, r) -> struct(a.n + greatest(0, r.last - greatest(r.first, a.upto)) as n, greatest(a.upto, r.last) as upto), a -> a.n)"
    found = text_rows(docs).mapInArrow(run, SCHEMA)
    return found.select("doc_id", "n_words", F.expr(start_new).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, least_items: int = 2, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents, with all their columns, in which fewer than ``least_items`` items occur; each row is judged by its text."""
    shipped = docs.sparkSession.sparkContext.broadcast(Shards(items, width, automaton_bytes))
    at = docs.columns.index("text")

    def keep(batches):
        scan = shipped.value.scanner()
        for part in _stretches(batches, shipped.value):
            mask = [len(ids) < least_items for _, _, ids, _ in scan([t or "" for t in part.column(at).to_pylist()])]
            yield part.filter(pa.array(mask, pa.bool_()))

    batches_of(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
