"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly if some value differs from each in at most r
bits.  So every distinct fingerprint emits all variants within r = 2 bits (2,081 of them), variants are
shuffled, and fingerprints that meet at a variant are verified.  All that meet at one variant are
linked to each other already, so each is joined to one of them only, never all pairs.

What is shuffled is packed by families: a variant goes to the bucket of its first half, and all of a
fingerprint's variants that have one first half (529, 33 or 1 of them, as 0, 1 or 2 of its flips are
there) are written as the fingerprint and the number of the family, and made again in the bucket.
That is 529 entries of 8 bytes and a number that packs to almost nothing, or 2.1 bytes a variant, at
every size of the corpus; no block sends anything to a bucket but its own entries.

Components come from alternating large-star and small-star steps over the links (a DataFrame each,
written to the shared folder), in a logarithmic number of rounds.

Edge cases: null or empty text has fingerprint zero, linked like any other; a text of fewer than four
words is one shingle; equal texts share a fingerprint, which is hashed once; a null doc_id is only a
component's id if it has no other; an empty table gives no rows; other columns are ignored (and kept
by ``drop_near_duplicates``).
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkyard.llm.common import free_name, map_slices, stage, text_rows

SHINGLE_WORDS = 4
SEED = 42
BITS = 64
RADIUS = 2
#: Bits of each half of a fingerprint.
HALF = BITS // 2
#: Fingerprints whose variants are packed at once.
BLOCK = 1024
#: Fingerprints whose variants a task packs, about.
TASK_FINGERPRINTS = 32_768
#: Variants that one bucket gets on average, at most.
BUCKET_VARIANTS = 1 << 22
#: Variants of a bucket that are made and sorted together, about.
RANGE_VARIANTS = 1 << 20
#: Copies of a small side's rows, over which a node with very many links is spread in a join.
SALTS = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FINGERPRINT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
_KEYED = T.StructType([*_FINGERPRINT.fields, T.StructField("_key", T.BinaryType())])


def shingle_digests(text: str) -> bytes:
    """The XXH64 digests of the text's shingles, one after another."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return b""
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    if len(words) <= SHINGLE_WORDS:
        return digest(line, SEED)
    starts = [0, *[e + 1 for e in ends]]
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :], strict=False)])


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """Bit i of a text's fingerprint is set if it is in over half of its shingles' hashes."""
    digests = [shingle_digests(t) for t in texts]
    out = np.zeros(len(texts), dtype=np.uint64)
    full = [i for i, d in enumerate(digests) if d]
    at = 0
    while at < len(full):  # a few texts at a time, as each hash takes 64 bytes here
        upto, size = at, 0
        while upto < len(full) and (upto == at or size + len(digests[full[upto]]) <= 1 << 21):
            size += len(digests[full[upto]])
            upto += 1
        counts = np.array([len(digests[i]) // 8 for i in full[at:upto]])
        raw = np.frombuffer(b"".join(digests[i] for i in full[at:upto]), dtype=np.uint8)
        votes = np.add.reduceat(np.unpackbits(raw).reshape(-1, BITS), np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0, dtype=np.int32)
        out[full[at:upto]] = np.packbits(2 * votes > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        at = upto
    return out


def fingerprints(docs: DataFrame, *more: str, schema: T.StructType = _FINGERPRINT) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed integer) and ``more``."""

    def start():
        return lambda columns: {"fp": fingerprints_of(columns.pop("text")).view(np.int64).tolist()} | columns

    return map_slices(text_rows(docs, *more), schema, start)


def ball_masks(radius: int = RADIUS) -> np.ndarray:
    """What to flip for every variant within the radius."""
    return np.array([sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(BITS), r)], dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return values


def families() -> list[tuple[int, int]]:
    """What to flip in the first half for every variant's first half, with how many flips are left for the second half."""
    return [(sum(1 << (b + HALF) for b in flips), RADIUS - r) for r in range(RADIUS + 1) for flips in combinations(range(HALF), r)]


def second_masks(left: int) -> np.ndarray:
    return np.array([sum(1 << b for b in flips) for r in range(left + 1) for flips in combinations(range(HALF), r)], dtype=np.uint64)


def buckets_of(n_fingerprints: int) -> int:
    """As many buckets as keep each one's variants to BUCKET_VARIANTS on average."""
    return 1 << max(0, n_fingerprints * len(ball_masks()) // BUCKET_VARIANTS).bit_length()


def pack_block(fps: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """A block's variants for every bucket: the fingerprints of each family whose first half belongs there, family by family."""
    flips = np.array([f for f, _ in families()], dtype=np.uint64)
    first = ((fps[None, :] ^ flips[:, None]) >> np.uint64(HALF)).ravel()
    bucket = (mixed(first) >> np.uint64(BITS - 31)).astype(np.int64) & (buckets - 1)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    zip_, out = zstandard.ZstdCompressor(level=1), []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        family, place = np.divmod(order[a:b], len(fps))
        out.append((int(bucket[a]), zip_.compress(fps[place].astype("<u8").tobytes() + family.astype("<u2").tobytes())))
    return out


def unpack(blob) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the number of the family of each."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 10
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u2", n, 8 * n)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value in the pairs but each component's least: the value and that least one."""
    values, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label != (up := label[label])).any():
            label = up
        if (label == before).all():
            break
    own = label != np.arange(len(values))
    return values[own], values[label[own]]


def meet(variants: np.ndarray, fps: np.ndarray, most_bits: int = 2 * RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that share a variant, verified; enough of them to join all that are linked."""
    ordered = np.sort(variants)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return again, again
    # Which variants are shared: by a table of bits, then exactly among the few that are left.
    bits = min(24, len(again).bit_length() + 6)
    seen = np.zeros(1 << bits, dtype=bool)
    seen[(mixed(again) >> np.uint64(64 - bits)).astype(np.int64)] = True
    shared = seen[(mixed(variants) >> np.uint64(64 - bits)).astype(np.int64)]
    hashes, fps = variants[shared], fps[shared]
    order = np.lexsort([fps, hashes])
    hashes, fps = hashes[order], fps[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    sizes = np.diff(np.append(first, len(fps)))
    center = np.repeat(fps[first], sizes)
    near = (np.bitwise_count(fps ^ center) <= most_bits) & (fps != center)
    return fps[near], center[near]


def variants_of(fps: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants of these families, and the fingerprint of each."""
    flips, left = (np.array(x, dtype=np.uint64) for x in zip(*families(), strict=True))
    made, whose = [], []
    for k in range(RADIUS + 1):
        own = fps[left[family] == k]
        first, masks = own ^ flips[family[left[family] == k]], second_masks(k)
        made.append((first[:, None] ^ masks[None, :]).ravel())
        whose.append(np.repeat(own, len(masks)))
    return np.concatenate(made), np.concatenate(whose)


def meet_in_bucket(blobs: list) -> tuple[np.ndarray, np.ndarray]:
    """The links of a bucket, one stretch of first halves after another."""
    fps, family = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
    flips, left = (np.array(x, dtype=np.uint64) for x in zip(*families(), strict=True))
    first = (fps ^ flips[family]) >> np.uint64(HALF)
    order = np.argsort(first)
    fps, family, first = fps[order], family[order], first[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), len(fps))
    size = np.add.reduceat(np.array([len(second_masks(k)) for k in range(RADIUS + 1)])[left[family].astype(np.int64)], edges[:-1])
    upto, at = np.cumsum(size), 0
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    while at < len(size):  # as many first halves as have RANGE_VARIANTS variants, or one
        after = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + RANGE_VARIANTS, "right")))
        own = slice(edges[at], edges[after])
        x, y = _meet_in_stretch(fps[own], family[own], int(upto[after - 1] - upto[at] + size[at]))
        a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
        at = after
    return a, b


def _meet_in_stretch(fps: np.ndarray, family: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints at variants in common.  One first half that very many have is done in rounds, each over its
    share of the variants, so that memory stays bounded."""
    rounds = max(1, -(-total // (4 * RANGE_VARIANTS)))
    if rounds == 1:
        return meet(*variants_of(fps, family))
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    step = max(1, RANGE_VARIANTS // len(ball_masks()))
    for r in range(rounds):
        kept = []
        for i in range(0, len(fps), step):
            v, f = variants_of(fps[i : i + step], family[i : i + step])
            own = mixed(v) % np.uint64(rounds) == r
            kept.append((v[own], f[own]))
        x, y = meet(*(np.concatenate(k) for k in zip(*kept, strict=True)))
        a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
    return a, b


def links(distinct: DataFrame, count: int) -> DataFrame:
    """a and b for enough pairs of the fingerprints in column fp, a > b, to join all within 2 * RADIUS bits."""
    buckets = buckets_of(count)

    def emit(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= BLOCK:
                fps = np.concatenate(held)
                for at in range(0, len(fps) - BLOCK + 1, BLOCK):
                    yield rows(fps[at : at + BLOCK])
                held = [fps[len(fps) // BLOCK * BLOCK :]]
        fps = np.concatenate(held) if held else np.empty(0, dtype=np.uint64)
        if len(fps):
            yield rows(fps)

    def rows(fps: np.ndarray) -> pa.RecordBatch:
        found = pack_block(fps, buckets)
        return pa.RecordBatch.from_pydict({"bucket": [k for k, _ in found], "blob": [x for _, x in found]}, schema=pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

    def join(table: pa.Table) -> pa.Table:
        a, b = meet_in_bucket([x.as_buffer() for x in table.column("blob")])
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // TASK_FINGERPRINTS)
    dealt = distinct.select("fp").repartition(tasks, "fp").mapInArrow(emit, "bucket int, blob binary")
    return dealt.groupBy("bucket").applyInArrow(join, "a long, b long")


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """An inner join in which a key of ``many`` may have any share of the rows: ``one`` has a row for each key, which is copied
    to every salt; ``many``'s salt is the hash of ``spread``."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_")
    left = many.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.join(one.select("*", salt).hint("merge"), [key, "salt_"]).drop("salt_")


def components(pairs: DataFrame) -> DataFrame:
    """node and root, the least node reachable, for every node of the pairs but the roots."""
    found = stage(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(found)
    while True:
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        found = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = mark(found)
        if now == before:
            return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def rooted(marked: DataFrame, first: Column) -> DataFrame:
    """fp, first (the least of its rows') and root, its component's least fingerprint, for every fingerprint."""
    distinct = stage(marked.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    pairs = stage(links(distinct, distinct.count()), "pairs")
    roots = components(pairs)
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) for every document."""
    marked = stage(fingerprints(docs), "fingerprints")
    found = rooted(marked, F.col("doc_id"))
    least = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(found, least, "root", "fp").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which one row of each component is left: that of the least id,
    null last, and then of the least fingerprint."""
    # Rows with the same id and text are the same document.  One column for the join and for such rows, so that
    # the texts are shuffled once.
    name = free_name(docs, "key")
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).cast("binary"), 256))
    keyed = docs.withColumn(name, key)
    marked = stage(fingerprints(docs.select("doc_id", "text", key.alias("_key")), "_key", schema=_KEYED), "fingerprints")
    found = rooted(marked, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key"))
    kept = found.groupBy("root").agg(F.min(F.struct("first.last", "first.doc_id", "fp", "first._key")).alias("kept")).select(F.col("kept._key").alias(name))
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
