"""Token-id files: byte or bit planes of fixed-size id blocks, zstandard-compressed, with a chunk index.

Layout of a file (all integers little-endian)::

    "CPLANES1" | planes of block 0 | planes of block 1 | ... | document table | index (JSON) | u64 length of index | "CPLANES1"

A block holds ``block_ids`` unsigned 32-bit ids (the last may be shorter). Its bytes are transposed so
that the plane k holds byte k (or bit k) of every id; planes of high bytes are nearly constant and all
but vanish. The index names offset and size of every plane, so that any block is read on its own.
The document table has document ids, a null mask and lengths.

``write`` distributes by ranges of the document id, each task writing one file under a temporary name and
renaming it when complete: a repeated or speculative task writes the same bytes and replaces them.

Defined results: a null text is an empty text (only the end id); rows with a null id come first;
repeated ids keep all their rows, ordered by a hash of the text; an empty table gives no files and no rows;
other columns are ignored.
"""

from __future__ import annotations

import io
import json
import math
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, scratch, utf8
from .word_tokens import word_tokens

MAGIC = b"CPLANES1"
BLOCK_IDS = 1 << 16
#: A task reads back this many files at most; fewer where all tasks can run at once.
READ_FILES = 16


def to_planes(block: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block of ``<u4`` ids."""
    raw = block.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        return np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Appends documents to a file object; memory is one block, and the table of documents."""

    def __init__(self, out, mode: str = "byte", block_ids: int = BLOCK_IDS, level: int = 1):
        import zstandard

        if mode not in ("byte", "bit"):
            raise ValueError(f"mode {mode!r} is neither byte nor bit")
        self.out, self.mode, self.block_ids = out, mode, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = self.out.write(MAGIC)
        self.held, self.n_held, self.blocks, self.n_ids = [], 0, [], 0
        self.ids, self.null, self.lengths = [], [], []

    def _put(self, data: bytes) -> list[int]:
        self.out.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def _flush(self, everything: bool = False) -> None:
        joined = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        whole = len(joined) if everything else len(joined) // self.block_ids * self.block_ids
        for i in range(0, whole, self.block_ids):
            block = joined[i : min(i + self.block_ids, whole)]
            start = self.at
            sizes = [self._put(self.zip.compress(p))[1] for p in to_planes(block, self.mode)]
            self.blocks.append([start, len(block), sizes])
        self.held, self.n_held = ([joined[whole:]] if whole < len(joined) else []), len(joined) - whole

    def add(self, doc_id: int | None, ids: bytes | np.ndarray) -> None:
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.ids.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.lengths.append(len(ids))
        if self.n_held >= self.block_ids:
            self._flush()

    def close(self) -> None:
        self._flush(everything=True)
        docs = np.array(self.ids, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes() + np.packbits(np.array(self.null, bool)).tobytes()
        index = {"mode": self.mode, "block_ids": self.block_ids, "n_ids": self.n_ids, "n_docs": len(self.ids), "documents": self._put(self.zip.compress(docs)), "blocks": self.blocks}
        data = json.dumps(index).encode()
        self._put(data)
        self.out.write(struct.pack("<Q", len(data)) + MAGIC)


class Reader:
    """Reads a file object of ``Writer``: single blocks, or all documents in turn."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or not whole")
        (n,) = struct.unpack("<Q", tail[:8])
        self.index = json.loads(self._at(size - 16 - n, n))

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        start, n, sizes = self.index["blocks"][k]
        planes = []
        for size in sizes:
            planes.append(self.unzip.decompress(self._at(start, size)))
            start += size
        return from_planes(planes, n, self.index["mode"])

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Document id and the parts of its ids, block by block."""
        n = self.index["n_docs"]
        raw = self.unzip.decompress(self._at(*self.index["documents"]))
        ids, lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        null = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n), count=n)
        block, k, at = np.empty(0, "<u4"), 0, 0
        for doc_id, length, gone in zip(ids.tolist(), lengths.tolist(), null.tolist()):
            parts = []
            while length:
                if at == len(block):
                    block, at, k = self.block(k), 0, k + 1
                parts.append(block[at : at + length])
                at, length = at + len(parts[-1]), length - len(parts[-1])
            yield (None if gone else doc_id), parts


def open_folder(url: str):
    """The file system of a URL and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else f"file://{url}")


MANIFEST = "part long, file string, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, encode: Callable[[], Callable[[bytes], bytes]], mode: str = "byte") -> list:
    """Write the ids of ``docs`` (doc_id, text) below ``folder`` in ascending doc_id order.

    ``encode`` is called once a task and gives a function from UTF-8 to ids. Returns the manifest: one row
    a file, in order. Its length is the number of tasks.
    """

    def task(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        own, name, out = f"{path}/.{part}-{uuid.uuid4().hex}", f"part-{part:06d}.planes", None
        for batch in batches:
            if out is None:
                of, out = encode(), system.open_output_stream(own)
                writer = Writer(out, mode)
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                writer.add(doc_id, of(text))
        if out is not None:
            writer.close()
            out.close()
            system.move(own, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.ids)], "n_ids": [writer.n_ids]})

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))  # a much repeated id is several ranges
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return sorted(ordered.mapInArrow(task, MANIFEST).collect(), key=lambda r: r.part)


def read_back(spark, folder: str, manifest: list) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows, before = [], 0
    for r in manifest:
        rows.append((r.file, before))
        before += r.n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    if not rows:
        return spark.createDataFrame([], schema)

    def task(batches):
        system, path = open_folder(folder)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                at = f"{path}/{file}"
                with system.open_input_file(at) as source:
                    found = []
                    for doc_id, parts in Reader(source, system.get_file_info(at).size).documents():
                        crc = n = 0
                        for p in parts:
                            crc, n = zlib.crc32(np.ascontiguousarray(p).data, crc), n + len(p)
                        found.append((doc_id, start, n, crc))
                        start += n
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=kind)
                            found = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=kind)

    tasks = max(min(len(rows), spark.sparkContext.defaultParallelism), math.ceil(len(rows) / READ_FILES))
    listed = pa.table(dict(zip(("file", "start"), zip(*rows))))  # a list would go through Python workers of its own
    files = spark.createDataFrame(listed).repartitionByRange(tasks, F.col("start"))
    return files.mapInArrow(task, schema)


def encode_with_end(path: str, end_id: int) -> Callable[[], Callable[[bytes], bytes]]:
    """The word BPE with an end id after each document."""

    def begin():
        tokens, end = word_tokens(path), struct.pack("<I", end_id)
        return lambda text: tokens.ids(text) + end

    return begin


def write_and_read(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None, mode: str = "byte") -> DataFrame:
    """Write ``docs`` to token files and read the files back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    return read_back(spark, folder, write(id_and_text(docs), folder, encode_with_end(path, end_id), mode))
