"""Token-ID files: independent zstandard frames, one a document, with a trailing seek table.

A file is a run of zstandard frames, each the ids of one document as little-endian unsigned 32-bit
integers, then a skippable frame with the documents' ids (presence byte and signed 64-bit value
each), then the seek table of the public zstandard seekable format: for every frame its compressed
and decompressed size and the low 32 bits of the XXH64 of its content, then the number of frames, a
descriptor and a magic number.  A reader takes the end of a file, then only the frames it wants.
Any zstandard decoder reads the whole file as one stream of ids.

Files are numbered by ranges of doc_id, so their concatenation is in ascending order.  A task writes
under a name of its own and renames, so a lost executor's task can run again; files go to a folder
that all executors share, through Arrow's file systems.

Edge cases: null text is empty and has the end id only; null doc_ids come first; equal doc_ids keep
together, ordered by text; an empty table gives no documents; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkyard.llm.common import batches_of, file_system, map_slices, scratch_path, slices, stage, text_rows

END_ID = 2
#: Entries in each of the two generations of a worker's memory of encoded chunks.
REMEMBERED_CHUNKS = 400_000
REMEMBERED_CHARS = 200
#: Documents whose chunks are looked up together, and their bytes.
SLICE_DOCS = 16384
SLICE_BYTES = 24 << 20
#: Bytes of frames that a reader of all documents takes at once.
READ_BYTES = 8 << 20

# Fixed values of the zstandard formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = T.StructType([T.StructField("file", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def laid(pool: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's pieces (of these sizes, from these places on) that ``which`` names, side by side, and where each begins, with the end."""
    each = size[which]
    upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    places = np.repeat((first[which] - upto[:-1]).astype(np.int32), each)
    places += np.arange(upto[-1], dtype=np.int32)
    return pool[places], upto


class ChunkedTokenizer:
    """The library's ids, with what stands between spaces and line ends remembered.

    The vocabulary's cutting pattern never crosses a space or line end that stands alone between two
    other characters, nor the place between a letter and the ASCII punctuation that ends a chunk, so
    such pieces are encoded by themselves.  Arrow cuts the texts and numbers the different pieces; new
    ones go to the library many at a time, each after its space; only a piece's first token starts with
    one, which tells their ids apart.
    """

    _safe = re.compile(r"(?<=\S) (?=\S)")
    #: What ends in a letter, and the punctuation after it.
    _parts = r"(?s)^(?P<stem>.*\pL)(?P<tail>[[:punct:]]*)$"
    #: White space of any kind but the line end that a chunk may start with; or nothing at all.
    _spoilt = r"[\x09\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^\n?$"

    def __init__(self, path: str, remembered: int = REMEMBERED_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.starts = np.zeros(self.library.get_vocab_size(), dtype=bool)
        space = self.library.encode(" ", add_special_tokens=False).tokens[0]
        for token, i in self.library.get_vocab().items():
            self.starts[i] = token.startswith(space)
        self.line_end = self._raw(["\n"])[0]
        self.limit, self.young, self.old, self.tails = remembered, {}, {}, {"": b""}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece, which has no white space, after a space."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 500):
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(pieces[at : at + 500])], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = [*(4 * np.flatnonzero(self.starts[ids])).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        if len(out) != len(pieces):
            raise ValueError("this vocabulary does not keep a space at the start of a token")
        return out

    def _recalled(self, stems: list[str]) -> list[bytes]:
        """Packed ids of different stems: one that starts with a line end has no space before it."""
        young, old = self.young, self.old
        found = list(map(young.get, stems))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k in missing:
            if (ids := old.get(stems[k])) is None:
                new.append(k)
            else:
                found[k] = ids
        for k, ids in zip([k for k in new if stems[k][0] != "\n"], self._spaced([stems[k] for k in new if stems[k][0] != "\n"]), strict=True):
            found[k] = ids
        opening = [k for k in new if stems[k][0] == "\n"]
        for k, ids in zip(opening, self._raw([stems[k][1:] for k in opening]), strict=True):
            found[k] = self.line_end + ids
        young.update((stems[k], found[k]) for k in missing if len(stems[k]) <= REMEMBERED_CHARS)
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return found

    def _tail(self, tail: str) -> bytes:
        """The packed ids of punctuation after a letter."""
        if (ids := self.tails.get(tail)) is None:
            ids = self._raw([tail])[0]
            if len(tail) < 9 and len(self.tails) < 4096:
                self.tails[tail] = ids
        return ids

    def _packed(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks, side by side, and where each chunk's begin; those that cannot stand by themselves have none."""
        parts = pc.extract_regex(chunks, self._parts)
        whole = parts.is_null()
        stem = pc.if_else(whole, chunks, pc.struct_field(parts, 0))
        spoilt = pc.match_substring_regex(chunks, self._spoilt)
        stem = pc.if_else(spoilt, pa.scalar(None, stem.type), stem).dictionary_encode()
        tail = pc.if_else(pc.or_(whole, spoilt), pa.scalar("", chunks.type), pc.struct_field(parts, 1)).dictionary_encode()
        packed = [*self._recalled(stem.dictionary.to_pylist()), b"", *map(self._tail, tail.dictionary.to_pylist())]
        which = np.empty(2 * len(chunks), np.int32)
        which[0::2] = pc.fill_null(stem.indices, len(stem.dictionary)).to_numpy(zero_copy_only=False)
        which[1::2] = tail.indices.to_numpy() + np.int32(len(stem.dictionary) + 1)
        size = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        ids, upto = laid(np.frombuffer(b"".join(packed), "<u4"), np.cumsum(size) - size, size, which)
        return ids, upto[0::2]

    def _slow(self, text: str) -> bytes:
        """With white space of any kind."""
        first, *rest = self._safe.split(text)
        return b"".join(self._raw([first, *(" " + c for c in rest)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; a chunk's are looked up once and then copied to wherever it stands."""
        if not texts:
            return []
        text = lambda x: pa.scalar(x, pa.large_string())
        lines = pc.binary_join_element_wise(text(""), pa.array(texts, pa.large_string()), text("\n"))
        cut = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
        numbered = cut.flatten().dictionary_encode()
        pool, first = self._packed(numbered.dictionary)
        size, first = np.append(np.diff(first), 0), np.append(first[:-1], 0)
        alone = size > 0
        alone[-1] = True
        bounds, which = cut.offsets.to_numpy(), numbered.indices.to_numpy().copy()
        which[bounds[:-1]] = len(size) - 1  # before a text's first chunk is nothing
        ids, upto = laid(pool, first, size, which)
        good = np.logical_and.reduceat(alone[which], bounds[:-1]).tolist()
        raw, ends, skip = ids.tobytes(), (4 * upto[bounds]).tolist(), len(self.line_end)
        return [self._raw([t])[0] if any(x in t for x in self.special) else raw[a + skip : b] if g else self._slow(t) for t, g, a, b in zip(texts, good, ends, ends[1:], strict=False)]


@lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> ChunkedTokenizer:
    """One for all tasks of a Python worker, with what it remembers."""
    return ChunkedTokenizer(path)


class FrameWriter:
    """Writes one file; memory holds the index alone."""

    def __init__(self, sink):
        self.sink, self.table, self.index, self.n_ids = sink, bytearray(), bytearray(), 0
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=False)

    def put(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.sink.write(frame)
        self.table += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.index += struct.pack("<?q", doc_id is not None, doc_id or 0)
        self.n_ids += len(ids) // 4

    @property
    def n_docs(self) -> int:
        return len(self.table) // 12

    def close(self) -> None:
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(self.index)) + self.index)
        table = self.table + struct.pack("<IBI", self.n_docs, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)
        self.sink.close()


class FrameReader:
    """Reads chosen documents of one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - 9 - 12 * n - 8
        head = struct.unpack("<II", source.read_at(8, table_at))
        if head != (SKIPPABLE_SEEK_TABLE, 12 * n + 9):
            raise ValueError("the seek table's frame is damaged")
        self.frames = list(struct.iter_unpack("<III", source.read_at(12 * n, table_at + 8))) if n else []
        self.doc_ids = [v if there else None for there, v in struct.iter_unpack("<?q", source.read_at(9 * n, table_at - 9 * n))] if n else []
        self.offsets = [0]
        for packed, _, _ in self.frames:
            self.offsets.append(self.offsets[-1] + packed)
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.frames)

    def ids(self, k: int) -> bytes:
        """The packed ids of the k-th document; only its frame is read."""
        return self._opened(k, self.source.read_at(self.frames[k][0], self.offsets[k]))

    def every(self) -> Iterator[bytes]:
        """The packed ids of all documents in turn, read in long pieces."""
        k = 0
        while k < len(self.frames):
            upto = max(k + 1, bisect_right(self.offsets, self.offsets[k] + READ_BYTES) - 1)
            held = memoryview(self.source.read_at(self.offsets[upto] - self.offsets[k], self.offsets[k]))
            for j in range(k, upto):
                yield self._opened(j, held[self.offsets[j] - self.offsets[k] : self.offsets[j + 1] - self.offsets[k]])
            k = upto

    def _opened(self, k: int, frame: bytes | memoryview) -> bytes:
        _, size, check = self.frames[k]
        ids = self.decompressor.decompress(frame, max_output_size=size) if size else b""
        if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return ids

    def find(self, doc_id: int | None) -> list[int]:
        return [k for k, d in enumerate(self.doc_ids) if d == doc_id]


def write_token_files(docs: DataFrame, out_dir: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files, once; the manifest has file (number in order), path, n_docs, n_ids and start (ids in the files before)."""
    out_dir, path = out_dir or scratch_path(docs.sparkSession, "token-files"), vocabulary or default_vocabulary()
    end = struct.pack("<I", end_id)
    ordered = text_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    batches_of(docs.sparkSession, SLICE_BYTES)

    def write(batches: Iterator) -> Iterator:
        tokenizer, (system, base) = shared_tokenizer(path), file_system(out_dir)
        system.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        own, final = f"{base}/.writing-{number}-{uuid.uuid4().hex}", f"{base}/tokens-{number:06d}.zst"
        writer = None
        for batch in batches:
            for part in slices(batch, SLICE_DOCS, SLICE_BYTES):
                columns = part.to_pydict()
                writer = writer or FrameWriter(system.open_output_stream(own))
                for doc_id, ids in zip(columns["doc_id"], tokenizer.encode(columns["text"]), strict=True):
                    writer.put(doc_id, ids + end)
        if writer is not None:
            writer.close()
            system.move(own, final)
            made = {"file": [number], "path": [f"{out_dir}/tokens-{number:06d}.zst"], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(made, schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = stage(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def parallelism(df: DataFrame) -> int:
    """As many tasks as the session shuffles into; stated, so that few small rows are not put into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def start():
        def step(columns: dict) -> dict:
            out: dict = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for path, at in zip(columns["path"], columns["start"], strict=True):
                system, name = file_system(path)
                with system.open_input_file(name) as source:
                    reader = FrameReader(source)
                    for doc_id, ids in zip(reader.doc_ids, reader.every(), strict=True):
                        for c, v in zip(out.values(), (doc_id, at, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            c.append(v)
                        at += len(ids) // 4
            return out

        return step

    return map_slices(manifest.select("path", "start").repartition(parallelism(manifest), "path"), READ, start, rows=1)


def documents_of(paths: list[str], doc_ids: set[int]) -> dict[int, list[bytes]]:
    """Chosen documents' packed ids, decompressing nothing else."""
    found: dict[int, list[bytes]] = {}
    for path in paths:
        system, name = file_system(path)
        with system.open_input_file(name) as source:
            reader = FrameReader(source)
            for k, d in enumerate(reader.doc_ids):
                if d in doc_ids:
                    found.setdefault(d, []).append(reader.ids(k))
    return found
