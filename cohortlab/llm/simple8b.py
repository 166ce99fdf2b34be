"""Token ids in a binary file format of Simple-8b words.

A word has 64 bits: the selector in the top 4, ids of one width below, the first id lowest. ``COUNTS``/``WIDTHS`` list
the packings; selector 0 is an escape, whose low 32 bits say how many whole 64-bit values follow.

A file holds blocks and ends with two directories and a footer, so that any document is found without reading others::

    block:      n_ids u32, n_words u32, words u64[n_words]
    blocks:     offset u64, first id's position in the file u64 (per block)
    documents:  doc_id i64, first id's position in the file u64, n_tokens u64 (per document, ascending)
    footer:     n_blocks u64, n_documents u64, n_ids u64, offset of the directories u64, magic

Files are numbered in ascending order of doc_id: all of file k precede all of file k + 1. The ids come from the tokenizers
library, asked once for each distinct unit of a batch.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_bytes, frame, fresh_path, save
from ._files import Reader, write_file
from ._units import encoder, word_encoder

#: Fixed values of the format: ids a word holds, and the bits of each, by selector. 0 stands for the escape.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
MAGIC = b"S8BLOCK1"
BLOCK_IDS = 1 << 14
#: Ids after which a file ends, and bytes of text that are encoded at once.
FILE_IDS, SLICE = 1 << 26, 1 << 22
_NULL_ID = -(1 << 63)
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)
_FOOTER = struct.Struct("<QQQQ8s")


def pack(ids: np.ndarray) -> np.ndarray:
    """The 64-bit words of ``ids``. From every position the packing that holds the most ids is known at once; a walk
    from word to word then picks those that are used."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    top = int(ids.max())
    wide = _BITS[ids] if top < len(_BITS) else np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    selector = np.zeros(n, np.int8)  # the most ids that fit from each position on, narrow packings last
    widest, counted = wide, 1  # the greatest width among the next `counted` ids
    for s in range(len(COUNTS) - 1, 0, -1):
        if COUNTS[s] > n:
            break
        while counted < COUNTS[s]:
            more = min(2 * counted, COUNTS[s]) - counted
            widest = np.maximum(widest[: n - counted - more + 1], widest[more:])
            counted += more
        selector[: len(widest)][widest <= WIDTHS[s]] = s
    step_of = np.array(COUNTS)[selector].tolist()
    at, starts, escaped = 0, [], []
    while at < n:
        starts.append(at)
        if step := step_of[at]:
            at += step
        else:  # a run of values over 60 bits
            run = at
            while run < n and not step_of[run]:
                run += 1
            escaped.append((len(starts) - 1, at, run))
            at = run
    starts = np.array(starts)
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s:
            rows = np.flatnonzero(chosen == s)
            grid = ids[starts[rows][:, None] + np.arange(COUNTS[s])]
            words[rows] |= np.bitwise_or.reduce(grid << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])), axis=1)
    if not escaped:
        return words
    parts, done = [], 0
    for word, a, b in escaped:
        parts += [words[done:word], np.array([b - a], np.uint64), ids[a:b]]
        done = word + 1
    return np.concatenate([*parts, words[done:]])


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    at = 0
    for e in np.flatnonzero(selector == 0).tolist():  # words inside an escape are values, not selectors
        if e >= at:
            at = e + 1 + int(words[e])
            raw[e + 1 : at] = True
    selector[raw] = 0
    counts = np.where(raw, 1, np.array(COUNTS)[selector])
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    starts, width = ends - counts, np.where(raw, 0, np.array(WIDTHS)[selector]).astype(np.uint64)
    mask = np.where(raw, np.uint64(2**64 - 1), (np.uint64(1) << width) - np.uint64(1))
    shift = (np.arange(n) - np.repeat(starts, counts)).astype(np.uint64) * np.repeat(width, counts)
    return (np.repeat(words, counts) >> shift) & np.repeat(mask, counts)


def block_bytes(ids: np.ndarray) -> bytes:
    words = pack(ids)
    return struct.pack("<II", len(ids), len(words)) + words.astype("<u8").tobytes()


def read_block(data: bytes) -> np.ndarray:
    n, n_words = struct.unpack_from("<II", data)
    ids = unpack(np.frombuffer(data, "<u8", n_words, 8))
    if len(ids) != n:
        raise ValueError("a block holds another number of ids than it says")
    return ids


class Writer:
    """Collects documents and yields the bytes of a file; holds a few blocks of ids and the directories."""

    def __init__(self, block_ids: int = BLOCK_IDS):
        self.block_ids, self.buffer, self.held = block_ids, [], 0
        self.offset = self.ids = 0
        self.blocks: list[tuple[int, int]] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: list[int], ids: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        """Documents one after the other: ``sizes`` ids each."""
        ends = np.cumsum(sizes, dtype=np.int64)
        self.docs.append(np.stack([np.asarray(doc_ids, np.int64), self.ids + self.held + ends - sizes, np.asarray(sizes, np.int64)], axis=1))
        yield from self.more(ids)

    def end(self, doc_id: int, size: int, end_id: int) -> Iterator[bytes]:
        """Close a document whose ids came by ``more``; ``size`` counts the end."""
        yield from self.more(np.array([end_id], np.uint32))
        self.docs.append(np.array([[doc_id, self.ids + self.held - size, size]], np.int64))

    def more(self, ids: np.ndarray) -> Iterator[bytes]:
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 16 * self.block_ids:
            yield from self._flush(self.held - self.held % self.block_ids)

    def _flush(self, n: int) -> Iterator[bytes]:
        ids = np.concatenate(self.buffer) if self.buffer else np.empty(0, np.uint32)
        for a in range(0, n, self.block_ids):
            data = block_bytes(ids[a : min(a + self.block_ids, n)])
            self.blocks.append((self.offset, self.ids + a))
            self.offset += len(data)
            yield data
        self.buffer, self.held, self.ids = [ids[n:]], len(ids) - n, self.ids + n

    def close(self) -> Iterator[bytes]:
        yield from self._flush(self.held)
        yield np.array(self.blocks, "<u8").tobytes()
        yield from (x.astype("<i8").tobytes() for x in self.docs)
        yield _FOOTER.pack(len(self.blocks), sum(map(len, self.docs)), self.ids, self.offset, MAGIC)


def read_directories(reader: Reader, name: str, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks, documents and the end of the last block of a file."""
    n_blocks, n_docs, _, at, magic = _FOOTER.unpack(reader.read(name, size - _FOOTER.size, _FOOTER.size))
    if magic != MAGIC:
        raise ValueError(f"{name} is no file of this format")
    blocks = np.frombuffer(reader.read(name, at, 16 * n_blocks), "<u8").reshape(-1, 2)
    docs = np.frombuffer(reader.read(name, at + 16 * n_blocks, 24 * n_docs), "<i8").reshape(-1, 3)
    return blocks, docs, at


def read_documents(reader: Reader, name: str, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``doc_id, first position, ids`` of every document of a file, block by block."""
    blocks, docs, end = read_directories(reader, name, size)
    bounds = [*blocks[:, 0].tolist(), end]
    held, first, k = np.empty(0, np.uint64), 0, 0
    for doc_id, start, n in docs.tolist():
        parts, have = [held[start - first :]], len(held) - (start - first)
        while have < n:
            ids = read_block(reader.read(name, bounds[k], bounds[k + 1] - bounds[k]))
            parts.append(ids)
            have += len(ids)
            k += 1
        held, first = np.concatenate(parts) if len(parts) > 1 else parts[0], start
        yield doc_id, start, held[:n]


def _slices(text: str, size: int) -> Iterator[str]:
    """A text in slices of ``size`` characters or a little more, each up to a space, where the tokenizer always cuts."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def write_token_files(docs: DataFrame, root: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None, file_ids: int = FILE_IDS, slice_bytes: int = SLICE) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids in ascending order of ``id_col``; returns the list of
    files: ``part, seq, name, size, n_ids, first_doc, last_doc``.

    Rows are dealt to tasks by ranges of (id, hash of the text), so neither one id nor one text can fill a task; a task
    ends a file when it holds ``file_ids`` ids, so that the directories held in memory don't grow with the corpus. A very
    long text is encoded in slices that go to the file one after the other. A null text is empty (its only id is
    ``end_id``), a null id comes first and is stored as the least long; rows that repeat an id are stored each, in the
    order of their texts' hashes. An empty table gives no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encoder(tokenizer_path, word_encoder), TaskContext.get().partitionId()
        groups = _groups(batches, slice_bytes)
        held, seq = next(groups, None), 0
        while held is not None:
            writer, name, first, last = Writer(), f"{uuid.uuid4().hex}.s8b", held[0][0], None

            def chunks(writer: Writer = writer) -> Iterator[bytes]:
                nonlocal held, last
                while held is not None and writer.ids + writer.held < file_ids:
                    ids, texts = held
                    if len(ids) == 1 and pc.binary_length(texts)[0].as_py() > slice_bytes:
                        size = 0
                        for piece in _slices(texts[0].as_py(), slice_bytes):
                            tokens = coder.encode([piece]).ids
                            size += len(tokens)
                            yield from writer.more(tokens)
                        yield from writer.end(ids[0], size + 1, end_id)
                    else:
                        found = coder.encode(texts)
                        bounds = found.bounds()
                        yield from writer.add(ids, np.insert(found.ids, bounds[1:], np.uint32(end_id)), np.diff(bounds) + 1)
                    last, held = ids[-1], next(groups, None)
                yield from writer.close()

            size = write_file(root, name, chunks())
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "size": size, "n_ids": writer.ids, "first_doc": first, "last_doc": last}], schema=_LISTING)
            seq += 1

    return save(ranged.select("id", "t").mapInArrow(write, "part int, seq int, name string, size long, n_ids long, first_doc long, last_doc long"), "token-files")


_LISTING = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[int], pa.Array]]:
    """Neighbouring rows with about ``limit`` bytes of text."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        for a, z in by_bytes(pc.binary_length(texts).to_pylist(), limit):
            yield ids[a:z], texts.slice(a, z - a)


def read_token_files(listing: DataFrame, root: str) -> DataFrame:
    """Read every document back: ``doc_id, start, n_tokens, ids_crc32``. ``start`` counts the ids of all files before
    (their sizes, one number a file, are summed on the driver) and of the documents before it in its file."""
    spark = listing.sparkSession
    files = listing.orderBy("part", "seq").select("name", "size", "n_ids").collect()
    starts = np.cumsum([0, *(f.n_ids for f in files)]).tolist()
    todo = spark.createDataFrame([(f.name, f.size, s) for f, s in zip(files, starts, strict=False)], "name string, size long, base long").repartition(max(1, len(files)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(root)
        for b in batches:
            for name, size, base in b.itertuples(index=False):
                out = []
                for doc_id, start, ids in read_documents(reader, name, size):
                    out.append((None if doc_id == _NULL_ID else doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 20_000:
                        yield frame(out, _READ)
                        out = []
                yield frame(out, _READ)
        reader.close()

    return todo.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


_READ = ["doc_id", "start", "n_tokens", "ids_crc32"]


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    root = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, root, tokenizer_path, end_id, id_col, text_col), root)
