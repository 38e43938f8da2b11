"""Language-model scoring: context-tree weighting over binary-decomposed bytes, beside a unigram base.

A byte is eight binary decisions; each place in that decision tree has a context tree of its own over
the preceding bytes.  A node keeps a Krichevsky-Trofimov estimate of its zeros and ones, and the
weighting mixes it half and half with the product over the node's children, up from the deepest.
The counts all follow from how often each run of depth + 1 bytes occurs in the training texts, and a
run's probability does not depend on where it stands.  Texts start after, and end with, the byte 0xFF,
which UTF-8 never has, so all texts' probabilities sum to one.  A score's code length in bits over the
text's bytes is ``bits_per_byte``.

The depth is ``DEPTH`` for every input, and no table over the corpus is ever in one place.  Documents are
gathered into blocks, and a block asks once for each distinct run and each distinct word of its texts,
telling how often its training texts have them.  What is asked is dealt into parts: runs by the last ``TOP``
bytes of their context, in which all orders from ``TOP`` on are grown; words by a hash.  What the parts'
trees have below ``TOP`` is summed at the driver, at most 65,280 nodes.  The answers (a run's
probability, a word's count) go back to their blocks, so a common word or run has one row a block and
is summed there before it is shuffled.

Edge cases: null text is empty and has the end alone; a null doc_id counts as empty text for the
hold-out; without training texts N, V and all counts are 0, the base of a token is log10(1), and each
bit's probability is a half; repeated rows count and are scored each; other columns are ignored; an
empty table gives no rows; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import remainder, stage_mapped, text_rows

#: Bytes of context of every input's tree, and how many of them name a part.
DEPTH = 5
TOP = 2
EDGE = 0xFF
#: Bytes of text whose runs are sorted at once.
PIECE_BYTES = 2 << 20
#: Parts that what is asked is dealt into, at least.
LEAST_PARTS = 64
#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
#: Slots of a task's memory of runs' probabilities.
CACHE_BITS = 20
#: A-Z in lower case, white space as spaces.
_FORM = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def runs_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of depth + 1 bytes that ends at each byte and end of the texts, and each text's count of them."""
    edge = bytes([EDGE]) * depth
    raw = np.frombuffer(b"".join([part for t in texts for part in (edge, t, b"\xff")]), dtype=np.uint8)
    runs = np.zeros(len(raw), dtype=np.uint64)
    for back in range(depth, -1, -1):
        runs <<= np.uint64(8)
        runs[back:] |= raw[: len(raw) - back]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    keep = np.ones(len(raw), dtype=bool)
    firsts = np.cumsum(sizes + depth) - sizes - depth
    for j in range(depth):
        keep[firsts + j] = False
    return runs[keep], sizes


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    steps = np.ones_like(y)
    for j in range(8):
        steps *= x + j
    return series - np.log(steps)


def _settled(zeros: np.ndarray, ones: np.ndarray, product: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes' log of the weighted probability, P(1) or minus P(0), and the weight of that; ``product`` is the children's.

    The lesser of P(1) and P(0) is kept: in 32 bits the greater is 1 from some ten million bits on, and what is left of it 0.
    """
    kt = log_gamma(ones + 0.5) + log_gamma(zeros + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)
    weight, weighted = (np.ones(len(kt)), kt) if product is None else (np.exp(-np.logaddexp(0, product - kt)), np.logaddexp(kt, product) - np.log(2))
    return weighted, (np.where(ones <= zeros, ones + 0.5, -(zeros + 0.5)) / (zeros + ones + 1.0)).astype(np.float32), weight.astype(np.float32)


def _up(keys: np.ndarray, order: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys at ``order`` that nodes one order deeper belong to, and the sums of their values."""
    own, where = np.unique(((keys >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)) << np.uint64(8) | (keys & np.uint64(255)), return_inverse=True)
    return own, *(np.bincount(where, weights=v, minlength=len(own)) for v in values)


def grown(runs: np.ndarray, counts: np.ndarray, depth: int, least: int = 0) -> tuple[list, tuple]:
    """The orders from ``least`` to ``depth`` (none for those below), and keys, zeros, ones and product for the next below."""
    orders: list = [None] * (depth + 1)
    symbol, context = runs & np.uint64(255), runs >> np.uint64(8)
    parts = []
    for k in range(8):
        key = (context << np.uint64(8)) | (np.uint64(1 << k) | (symbol >> np.uint64(8 - k)))
        bit = (symbol >> np.uint64(7 - k)) & np.uint64(1)
        found, at = np.unique(key, return_inverse=True)
        parts.append((found, np.bincount(at, weights=counts * (1 - bit.astype(float)), minlength=len(found)), np.bincount(at, weights=counts * bit, minlength=len(found))))
    keys, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
    ordered = np.argsort(keys, kind="stable")
    keys, zeros, ones, product = keys[ordered], zeros[ordered], ones[ordered], None
    for order in range(depth, least - 1, -1):
        weighted, one, weight = _settled(zeros, ones, product)
        orders[order] = (keys, one, weight)
        if order:
            keys, zeros, ones, product = _up(keys, order - 1, zeros, ones, weighted)
    return orders, (keys, zeros, ones, product)


class ContextTree:
    """For each order: sorted keys (context, place in the byte's decision tree), P(1) or minus P(0) there, whichever is less, and the weight of that estimate."""

    def __init__(self, depth: int, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.depth, self.orders = depth, orders

    @staticmethod
    def grow(runs: np.ndarray, counts: np.ndarray, depth: int) -> ContextTree:
        """From the distinct runs and their counts."""
        return ContextTree(depth, grown(runs, counts, depth)[0])

    def log10_of(self, runs: np.ndarray) -> np.ndarray:
        """log10 of the probability of each run's last byte after the others.  A path ends where no training text went."""
        symbol, context = runs & np.uint64(255), runs >> np.uint64(8)
        out = np.zeros(len(runs))
        for k in range(8):
            node = np.uint64(1 << k) | (symbol >> np.uint64(8 - k))
            bit = ((symbol >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            # The probability of the run's own bit, which keeps its places however close to 0 it is.
            p, have = np.full(len(runs), 0.5), np.zeros(len(runs), dtype=bool)
            for order in range(self.depth, -1, -1):
                keys, one, weight = self.orders[order]
                if not len(keys):
                    continue
                key = ((context & np.uint64((1 << 8 * order) - 1)) << np.uint64(8)) | node
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = keys[at] == key
                w = np.where(have, weight[at], np.float64(1))
                lesser = one[at].astype(np.float64)
                own = np.where(bit == (lesser >= 0), np.abs(lesser), 1 - np.abs(lesser))
                p = np.where(found, w * own + (1 - w) * p, p)
                have |= found
            out += np.log10(p)
        return out


class Scorer:
    """Texts' log10 probabilities; a direct-mapped table remembers runs."""

    def __init__(self, tree: ContextTree):
        self.tree = tree
        self.key = np.full(1 << CACHE_BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.value = np.zeros(1 << CACHE_BITS, dtype=np.float64)

    def of_runs(self, runs: np.ndarray) -> np.ndarray:
        slot = ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.value[slot]
        missing = np.flatnonzero(self.key[slot] != runs)
        if len(missing):
            new, where = np.unique(runs[missing], return_inverse=True)
            values = self.tree.log10_of(new)
            out[missing] = values[where]
            at = slot[missing]
            self.key[at] = runs[missing]
            self.value[at] = out[missing]
            # Of runs that share a slot the last stays: write both from the same one.
            self.value[at] = values[np.searchsorted(new, self.key[at])]
        return out

    def score(self, texts: list[bytes]) -> list[float]:
        out: list[float] = []
        for group in pieces(texts):
            runs, sizes = runs_of(group, self.tree.depth)
            out += np.add.reduceat(self.of_runs(runs), np.cumsum(sizes) - sizes).tolist()
        return out


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in groups of about PIECE_BYTES."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t) + 1
        if size >= PIECE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _zipped(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, byte plane by byte plane."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes | memoryview, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel()


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts."""
    return _zipped(len(keys).to_bytes(8, "little") + _planes(np.diff(keys, prepend=np.uint64(0))) + _planes(counts))


def _unpacked(blob) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(_from_planes(raw, n, 8), dtype=np.uint64), _from_planes(raw, n, 8 + 8 * n)


def _tallied(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs, sorted, and how often each occurs."""
    runs = np.sort(runs)
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.empty(0, np.int64)
    return runs[first], np.diff(np.append(first, len(runs))).astype(np.uint64)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in sorted stretches: the distinct ones and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _parts(df: DataFrame) -> int:
    """How many parts there are: a power of two that grows with the session's shuffle partitions."""
    return max(LEAST_PARTS, 1 << (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of what is asked by part, and where each part begins."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _part_of_runs(keys: np.ndarray, parts: int) -> np.ndarray:
    """Runs with the same last TOP bytes of context have the same part."""
    near = (keys >> np.uint64(8)) & np.uint64((1 << 8 * TOP) - 1)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (parts - 1).bit_length())).astype(np.int64)


def _part_of_words(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (parts - 1)


class _Words:
    """The words of texts: each one's text and number, and the distinct words by number."""

    def __init__(self, texts: list[bytes]):
        cut = pc.split_pattern(pa.array([t.translate(_FORM) for t in texts], pa.large_binary()), " ")
        flat = cut.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        numbered = flat.filter(real).dictionary_encode()
        self.text = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)]
        self.number = numbered.indices.to_numpy(zero_copy_only=False)
        self.distinct: list[bytes] = numbered.dictionary.to_pylist()


_BLOCKS = "block long, n_train long, ids binary, there binary, held binary, texts binary"
_ASKS = "part int, block long, words boolean, blob binary"
_COUNTS = "part int, blob binary"
_ANSWERS = "part int, block long, words boolean, blob binary, n long, kinds long"


def _rows(schema: str, **columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_pydict({k: columns[k] for k, _ in fields}, schema=pa.schema([(k, kinds[t]) for k, t in fields]))


def _texts(blob) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\xff")[:-1]


def gathered(rows: DataFrame) -> DataFrame:
    """Blocks of documents, staged: doc_ids (and whether there is one), whether each is held out, and the texts."""

    def make(batches):
        ids, held, texts, size, number = [], [], [], 0, TaskContext.get().partitionId() << 24

        def row():
            there = np.array([i is not None for i in ids], dtype=bool)
            own = np.array([i or 0 for i in ids], dtype="<i8").tobytes()
            blob = _zipped(b"".join([t + b"\xff" for t in texts]), 3)
            return _rows(_BLOCKS, block=[number], n_train=[len(held) - sum(held)], ids=[own], there=[there.tobytes()], held=[np.array(held, dtype=bool).tobytes()], texts=[blob])

        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
                text = t.as_buffer().to_pybytes()
                if b"\xff" in text:  # not UTF-8
                    text = text.decode("utf-8", "replace").encode()
                if size and size + len(text) > BLOCK_BYTES:
                    yield row()
                    ids, held, texts, size, number = [], [], [], 0, number + 1
                ids.append(i)
                held.append(h)
                texts.append(text)
                size += len(text) + 1
        if ids:
            yield row()

    return stage_mapped(rows.select("doc_id", "text", "held_out"), make, _BLOCKS, "blocks")


def asked(blocks: DataFrame, depth: int, parts: int) -> DataFrame:
    """A row for each block and part, staged: distinct runs, or words, with their counts in the block's training texts."""

    def ask(batches):
        for batch in batches:
            for block, held, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                texts, held = _texts(blob.as_buffer()), np.frombuffer(held.as_buffer(), dtype=bool)
                found = [_tallied(runs_of(group, depth)[0]) for group in pieces([t for t, h in zip(texts, held, strict=True) if not h])]
                for group in pieces([t for t, h in zip(texts, held, strict=True) if h]):
                    keys = _tallied(runs_of(group, depth)[0])[0]
                    found.append((keys, np.zeros(len(keys), np.uint64)))
                keys, counts = _sum(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
                order, edges = _dealt(_part_of_runs(keys, parts), parts)
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[k] : edges[k + 1]]
                    yield _rows(_ASKS, part=[k], block=[block], words=[False], blob=[_packed(keys[own], counts[own])])
                words = _Words(texts)
                counts = np.bincount(words.number[~held[words.text]], minlength=len(words.distinct))
                order, edges = _dealt(_part_of_words(words.distinct, parts), parts)
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[k] : edges[k + 1]]
                    line = b" ".join([words.distinct[i] for i in own.tolist()])
                    yield _rows(_ASKS, part=[k], block=[block], words=[True], blob=[_zipped(len(own).to_bytes(8, "little") + _planes(counts[own]) + line)])
                pa.default_memory_pool().release_unused()

    return stage_mapped(blocks.select("block", "held", "texts"), ask, _ASKS, "asks")


def _by_part(asks: DataFrame) -> DataFrame:
    """Each part in one task, its rows one after another."""
    return asks.repartition("part").sortWithinPartitions("part")


def _of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in the order of their parts, cut where the part changes."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def counted_runs(asks: DataFrame) -> DataFrame:
    """The counts of each part's runs, staged; at most a part's distinct runs and one batch are held."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts = None, np.empty(0, np.uint64), np.empty(0, np.uint64)
        for batch in _of_parts(batches):
            if (own := batch.column(0)[0].as_py()) != part:
                if part is not None:
                    yield _rows(_COUNTS, part=[part], blob=[_packed(keys, counts)])
                part, keys, counts = own, np.empty(0, np.uint64), np.empty(0, np.uint64)
            held = [(k[c > 0], c[c > 0]) for k, c in (_unpacked(b.as_buffer()) for b in batch.column(1))]
            keys, counts = _sum(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(c for _, c in held)]))
        if part is not None:
            yield _rows(_COUNTS, part=[part], blob=[_packed(keys, counts)])

    return stage_mapped(_by_part(asks.where("not words").select("part", "blob")), merge, _COUNTS, "runs")


def _floats(blob) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = _unpacked(blob)
    return keys, counts.astype(np.float64)


def top_orders(counted: DataFrame, depth: int) -> list:
    """The orders below TOP, from what each part's subtrees have there."""

    def grow(batches):
        for batch in batches:
            for blob in batch.column(0):
                keys, *values = grown(*_floats(blob.as_buffer()), depth, TOP)[1]
                yield _rows("keys binary, sums binary", keys=[keys.tobytes()], sums=[np.stack(values).tobytes()])

    keys, sums = np.empty(0, np.uint64), np.empty((3, 0))
    for r in counted.select("blob").mapInArrow(grow, "keys binary, sums binary").toLocalIterator():
        more = np.frombuffer(r["keys"], np.uint64)
        keys, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
        sums = np.stack([np.bincount(where, weights=v, minlength=len(keys)) for v in np.concatenate([sums, np.frombuffer(r["sums"]).reshape(3, -1)], axis=1)])
    orders: list = [None] * TOP
    for order in range(TOP - 1, -1, -1):
        zeros, ones, product = sums
        weighted, one, weight = _settled(zeros, ones, product)
        orders[order] = (keys, one, weight)
        if order:
            keys, *sums = _up(keys, order - 1, zeros, ones, weighted)
    return orders


def answered_runs(asks: DataFrame, counted: DataFrame, depth: int) -> DataFrame:
    """The log10 probabilities of the runs of every ask, as 32-bit floats."""
    shipped = asks.sparkSession.sparkContext.broadcast(top_orders(counted, depth))

    def answer(batches):
        part, keys, counts, scorer = None, [], [], None
        for batch in batches:
            for own, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != part:
                    part, keys, counts, scorer = own, [], [], None
                if block is None:  # the part's counts come first
                    k, c = _floats(blob.as_buffer())
                    keys.append(k)
                    counts.append(c)
                    continue
                if scorer is None:
                    k, c = (np.concatenate(keys), np.concatenate(counts)) if keys else (np.empty(0, np.uint64), np.empty(0))
                    scorer = Scorer(ContextTree(depth, shipped.value + grown(k, c, depth, TOP)[0][TOP:]))
                values = scorer.of_runs(_unpacked(blob.as_buffer())[0]).astype("<f4").tobytes()
                yield _rows(_ANSWERS, part=[part], block=[block], words=[False], blob=[values], n=[0], kinds=[0])

    known = counted.select("part", F.lit(None).cast("long").alias("block"), "blob")
    dealt = known.unionByName(asks.where("not words").select("part", "block", "blob"))
    return dealt.repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first()).mapInArrow(answer, _ANSWERS)


def answered_words(asks: DataFrame) -> DataFrame:
    """The corpus counts of the words of every ask, staged; and for each part a row without block, with the sum of its counts and how many are not 0."""

    def of_part(table: pa.Table) -> pa.RecordBatch:
        lists, counts = [], []
        for blob in table.column("blob"):
            raw = zstandard.ZstdDecompressor().decompress(blob.as_buffer())
            n = int.from_bytes(raw[:8], "little")
            counts.append(_from_planes(raw, n, 8))
            lists.append(pc.split_pattern(pa.array([raw[8 + 8 * n :]], pa.large_binary()), " ").flatten())
        numbered = pa.concat_arrays(lists).dictionary_encode()
        at = numbered.indices.to_numpy()
        total = np.zeros(len(numbered.dictionary), np.uint64)
        np.add.at(total, at, np.concatenate(counts))
        found = np.split(total[at], np.cumsum([len(c) for c in counts])[:-1])
        blocks, n = table.column("block").to_pylist(), table.num_rows
        blobs = [_zipped(_planes(x)) for x in found]
        part = [table.column("part")[0].as_py()] * (n + 1)
        return _rows(_ANSWERS, part=part, block=[*blocks, None], words=[True] * (n + 1), blob=[*blobs, b""], n=[0] * n + [int(total.sum())], kinds=[0] * n + [int((total > 0).sum())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in itertools.groupby(_of_parts(batches), lambda b: b.column(0)[0].as_py()):
            yield of_part(pa.Table.from_batches(list(own)))
            pa.default_memory_pool().release_unused()

    return stage_mapped(_by_part(asks.where("words").select("part", "block", "blob")), answer, _ANSWERS, "words")


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document."""
    if not TOP < depth < 8:
        raise ValueError(f"a run of depth + 1 bytes is one 64-bit integer, and a part has orders from {TOP} on")
    rows, parts = text_rows(docs, (remainder(F.col("doc_id"), modulus) == held).alias("held_out")), _parts(docs)
    blocks = gathered(rows)
    asks = asked(blocks, depth, parts)
    runs = answered_runs(asks, counted_runs(asks), depth)
    words = answered_words(asks)
    n_words, kinds = words.where("block is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    total, distinct = n_words + ends, kinds + (ends > 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, ids = _texts(left.column("texts")[0].as_buffer()), np.frombuffer(left.column("ids")[0].as_buffer(), "<i8")
        there, held_out = (np.frombuffer(left.column(c)[0].as_buffer(), dtype=bool) for c in ("there", "held"))
        by_part = {(w, p): b.as_buffer() for w, p, b in zip(right.column("words").to_pylist(), right.column("part").to_pylist(), right.column("blob"), strict=True)}

        def back(part: np.ndarray, is_words: bool, read) -> np.ndarray:
            """The parts' answers, in the order in which this block asked."""
            order, edges = _dealt(part, parts)
            out = np.empty(len(part))
            own = [read(by_part[is_words, k], edges[k + 1] - edges[k]) for k in np.flatnonzero(np.diff(edges)).tolist()]
            out[order] = np.concatenate(own) if own else 0
            return out

        held_runs = []
        for group in pieces(texts):
            runs, sizes = runs_of(group, depth)
            numbered = pa.array(runs).dictionary_encode()
            held_runs.append((numbered.dictionary.to_numpy(), numbered.indices.to_numpy(), sizes))
        keys = _sum(*[np.concatenate([k for k, _, _ in held_runs])] * 2)[0]
        value = back(_part_of_runs(keys, parts), False, lambda b, n: np.frombuffer(b, "<f4", n))
        scores = [np.add.reduceat(value[np.searchsorted(keys, own)][number], np.cumsum(sizes) - sizes) for own, number, sizes in held_runs]
        words = _Words(texts)
        c = back(_part_of_words(words.distinct, parts), True, lambda b, n: _from_planes(zstandard.ZstdDecompressor().decompress(b), n)).astype(np.int64)
        log, n = np.log10((c + 1) / (total + distinct + 1)), len(texts)
        base = np.bincount(words.text, weights=log[words.number], minlength=n) + np.log10((ends + 1) / (total + distinct + 1))
        known = np.bincount(words.text, weights=c[words.number] > 0, minlength=n).astype(np.int64) + (ends > 0)
        tokens = np.bincount(words.text, minlength=n) + 1
        score = np.concatenate(scores)
        bits = -score / np.log10(2) / np.maximum([len(t) for t in texts], 1)
        del held_runs, value, words
        pa.default_memory_pool().release_unused()
        columns = [pa.array(ids, mask=~there), held_out, tokens, known, np.full(n, total), base, score, bits]
        return pa.table(dict(zip([x.split(" ")[0] for x in _SCORED.split(", ")], map(pa.array, columns), strict=True)))

    answers = runs.unionByName(words.where("block is not null")).select("block", "part", "words", "blob")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORED)
