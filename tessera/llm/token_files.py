"""Token-id files in bit or byte planes.

A file holds the ids of whole documents one after the other. The id stream is cut into blocks of a fixed
number of ids; a block is transposed into planes (byte p, or bit p, of every id), each plane is compressed by
zstandard on its own, and the block index (offset, id count, plane lengths) and the document table close the
file:

    magic | planes of block 0 | planes of block 1 | ... | footer (zstd JSON header + arrays) | length | magic

Planes above the highest set bit of a block are not stored.
"""

from __future__ import annotations

import itertools
import json
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import encoder
from .util import crc32_py, filesystem, fresh_path, materialize

MAGIC = b"TSRPLN01"
BLOCK_IDS = 65536
LEVEL = 3
#: A file is closed, and the next one begun, at so many documents or ids: its tables, which a task holds, are bounded.
FILE_DOCS, FILE_IDS = 1_000_000, 1 << 28
_PIECES = 1 << 24


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Transpose ids (u32) to planes, lowest first; no plane for bits or bytes that no id uses."""
    top = int(ids.max(initial=0)).bit_length()
    if mode == "byte":
        grid = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(grid[:, p]).tobytes() for p in range(-(-top // 8))]
    return [np.packbits(((ids >> np.uint32(p)) & np.uint32(1)).astype(np.uint8)).tobytes() for p in range(top)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        grid = np.zeros((n, 4), dtype=np.uint8)
        for p, data in enumerate(planes):
            grid[:, p] = np.frombuffer(data, dtype=np.uint8)
        return grid.view("<u4").reshape(n)
    ids = np.zeros(n, dtype="<u4")
    for p, data in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype("<u4") << np.uint32(p)
    return ids


class PlaneWriter:
    """Appends documents to one open binary sink."""

    def __init__(self, sink, mode: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL):
        if mode not in ("byte", "bit"):
            raise ValueError(f"unknown plane mode {mode!r}")
        self.sink, self.mode, self.block_ids = sink, mode, block_ids
        self.z = zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.waiting_ids = 0, [], 0
        self.blocks: list[tuple[int, int]] = []
        self.lengths: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.waiting_ids += len(ids) // 4
        if self.waiting_ids >= self.block_ids:
            data = b"".join(self.waiting)
            step = self.block_ids * 4
            whole = len(data) // step * step
            for i in range(0, whole, step):
                self._block(data[i : i + step])
            self.waiting, self.waiting_ids = [data[whole:]], (len(data) - whole) // 4

    def _block(self, data: bytes) -> None:
        ids = np.frombuffer(data, dtype="<u4")
        packed = [self.z.compress(p) for p in to_planes(ids, self.mode)]
        self.blocks.append((self.at, len(ids)))
        self.lengths.append([len(p) for p in packed])
        self._put(b"".join(packed))

    def close(self) -> int:
        """Writes the footer; returns the number of ids in the file."""
        if self.waiting_ids:
            self._block(b"".join(self.waiting))
        head = {"mode": self.mode, "block_ids": self.block_ids, "blocks": self.blocks, "planes": self.lengths, "docs": len(self.counts)}
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        raw = json.dumps(head).encode()
        body = len(raw).to_bytes(8, "little") + raw + np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes() + np.array(self.counts, dtype="<i8").tobytes() + known.tobytes()
        body = self.z.compress(body)
        self._put(body)
        self._put(len(body).to_bytes(8, "little") + MAGIC)
        return sum(self.counts)


class PlaneReader:
    """Random access by block index, and documents in file order."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token plane file")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - n)
        self.z = zstandard.ZstdDecompressor()
        body = self.z.decompress(source.read(n))
        h = int.from_bytes(body[:8], "little")
        head = json.loads(body[8 : 8 + h])
        self.mode, self.block_ids, self.blocks, self.planes = head["mode"], head["block_ids"], head["blocks"], head["planes"]
        d, at = head["docs"], 8 + h
        ids = np.frombuffer(body, dtype="<i8", count=d, offset=at)
        self.counts = np.frombuffer(body, dtype="<i8", count=d, offset=at + 8 * d)
        known = np.frombuffer(body, dtype=np.uint8, count=d, offset=at + 16 * d)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.total = int(self.counts.sum()) if d else 0

    def block(self, k: int) -> np.ndarray:
        at, n = self.blocks[k]
        self.source.seek(at)
        planes = [self.z.decompress(self.source.read(size)) for size in self.planes[k]]
        return from_planes(planes, n, self.mode)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start``; reads only the blocks that hold them."""
        end = min(start + count, self.total)
        if end <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids : end - first * self.block_ids]

    def documents(self):
        """(doc_id, start in the file, n_tokens, crc32 of its ids), one block in memory at a time."""
        k, left, at = 0, b"", 0
        for doc_id, n in zip(self.doc_ids, self.counts, strict=True):
            need, crc = int(n) * 4, 0
            while need > len(left):
                crc = crc32_py(left, crc)
                need -= len(left)
                left = self.block(k).tobytes()
                k += 1
            crc = crc32_py(left[:need], crc)
            left = left[need:]
            yield doc_id, at, int(n), crc
            at += int(n)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", mode: str = "byte", block_ids: int = BLOCK_IDS, file_docs: int = FILE_DOCS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the manifest, one row per file:
    ``shard, path, n_docs, n_tokens, start`` (start: ids in all files before it).

    Null texts are empty (their only id is ``end_id``); null ids come first; rows with equal ids are all
    kept, in the order of a hash of their texts.
    An empty table writes no file. A text is encoded whole, however long; the writer holds one block of ids,
    one document, and the ids and lengths of the documents of one file, which ends at ``file_docs`` documents or with
    the document that reaches ``file_ids`` ids. Other columns are ignored. A retried task writes a new file under another name and only
    the names in the manifest count, so lost executors leave no wrong file behind.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Ties go by content, so that rows of one id (or of none) are cut into ranges too, and reruns agree.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def write(it):
        enc, writer, end = encoder(tokenizer), None, b"" if end_id is None else int(end_id).to_bytes(4, "little")
        part, piece, held = TaskContext.get().partitionId(), 0, 0
        fs, base = filesystem(folder)
        sink = path = None

        def closed():
            n = writer.close()
            sink.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([part * _PIECES + piece], pa.int64()), "path": [path], "n_docs": pa.array([len(writer.counts)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if writer is None:
                    path = f"{folder}/shard-{part:06d}-{piece:06d}-{uuid.uuid4().hex[:12]}.planes"
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}")
                    writer, held = PlaneWriter(sink, mode, block_ids), 0
                ids = enc.ids(text) + end
                writer.add(doc_id, ids)
                held += len(ids) // 4
                if len(writer.counts) >= file_docs or held >= file_ids:
                    yield closed()
                    writer, piece = None, piece + 1
        if writer is not None:
            yield closed()

    manifest = materialize(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")
    # One row per file: a few rows for each executor, whatever the number of documents.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(manifest.withColumn("start", before), "token-index")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files of a manifest: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(it):
        for b in it:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = filesystem(path)
                with fs.open_input_file(p) as source:
                    found = PlaneReader(source, source.size()).documents()
                    while part := list(itertools.islice(found, 20_000)):
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": pa.array([x[0] for x in part], pa.int64()), "start": pa.array([x[1] + start for x in part], pa.int64()), "n_tokens": pa.array([x[2] for x in part], pa.int64()), "ids_crc32": pa.array([x[3] for x in part], pa.int64())}
                        )

    # The rows are tiny and the work behind them is not: a number of partitions keeps AQE from merging them.
    spread = manifest.select("path", "start", "shard").repartition(max(1, min(manifest.count(), 10_000)), "shard").select("path", "start")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, "word_bpe_49k.json", fresh_path(spark, "token-files")))
