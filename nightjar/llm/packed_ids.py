"""Operator 9, token-id output with fixed-width bit packing.

``write_ids`` tokenises documents and writes their ids, in ascending id order,
to one file per range partition of the shared folder. Every id takes the
fewest bits that hold the vocabulary's largest id. A file is

    magic, bits (u32), ids per block (u32)
    blocks: ``bits`` bits an id, little-endian, each padded to whole bytes
    block offsets (u64 each)
    document ids (i64), 1 where the id is null (u8), ends: ids up to and
    including the document, within the file (u64)
    numbers of blocks, documents and ids, place of the offsets (u64 each), magic

so ``read_ids`` unpacks whole blocks in numpy, and ``read_document`` fetches a
single document by reading only the blocks that hold it. A task writes under
a name of its own and renames when done, so a task that is lost or run twice
leaves one whole file.

Defined results: null or empty text gives the end id alone; null ids come
first; rows that share an id follow each other, by text; an empty table gives
no file. Texts of any length are written block by block. Other columns are
ignored.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import landed, map_arrow, pick, schema_of
from .tokens import encoder, forget_encoders

MAGIC = b"NJIDPACK"
BLOCK_IDS = 1 << 16
MANIFEST = "part int, path string, n_docs long, n_ids long"


def id_bits(vocabulary: int) -> int:
    """Fewest bits for ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    wide = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _store(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


class IdWriter:
    """Appends documents to one file; holds at most a block of ids."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.pending: list[np.ndarray] = []
        self.waiting = self.at = self.n_ids = 0
        self.offsets: list[int] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self._write(MAGIC + struct.pack("<II", bits, block_ids))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.ends.append(self.n_ids + np.cumsum(lens))
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            flat = np.concatenate(self.pending)
            full = len(flat) // self.block_ids * self.block_ids
            for i in range(0, full, self.block_ids):
                self._block(flat[i:i + self.block_ids])
            self.pending, self.waiting = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self._write(pack(ids, self.bits))

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self._block(np.concatenate(self.pending))
        n_docs = sum(map(len, self.doc_ids))
        place = self.at
        self._write(np.array(self.offsets, "<u8").tobytes())
        for parts, kind in ((self.doc_ids, "<i8"), (self.nulls, "u1"), (self.ends, "<u8")):
            self._write(np.concatenate(parts).astype(kind).tobytes() if parts else b"")
        self._write(struct.pack("<QQQQ", len(self.offsets), n_docs, self.n_ids, place) + MAGIC)
        return n_docs, self.n_ids


class IdReader:
    """Random access to one file by an object with ``read_at(n, offset)``."""

    def __init__(self, file, size: int):
        self.file = file
        head, tail = file.read_at(16, 0), file.read_at(40, size - 40)
        if head[:8] != MAGIC or tail[32:] != MAGIC:
            raise ValueError("not a packed id file, or cut short")
        self.bits, self.block_ids = struct.unpack("<II", head[8:])
        n_blocks, self.n_docs, self.n_ids, place = struct.unpack("<QQQQ", tail[:32])
        table = file.read_at(size - 40 - place, place)
        cut = np.cumsum([8 * n_blocks, 8 * self.n_docs, self.n_docs, 8 * self.n_docs])
        self.offsets = np.append(np.frombuffer(table[:cut[0]], "<u8"), place).astype(np.int64)
        self.doc_ids = np.frombuffer(table[cut[0]:cut[1]], "<i8")
        self.nulls = np.frombuffer(table[cut[1]:cut[2]], "u1").astype(bool)
        self.ends = np.frombuffer(table[cut[2]:cut[3]], "<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        size = int(self.offsets[k + 1] - self.offsets[k])
        return unpack(self.file.read_at(size, int(self.offsets[k])), self.bits, n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at [start, end) of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        flat = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return flat[start - first * self.block_ids:end - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def crcs(self):
        """CRC-32 of every document's ids as unsigned 32-bit little-endian,
        with one block in memory at a time."""
        crc, doc, at = 0, 0, 0
        for k in range(len(self.offsets) - 1):
            data = memoryview(self.block(k).tobytes())
            base, end = at, at + len(data) // 4
            while doc < self.n_docs and self.ends[doc] <= end:
                yield zlib.crc32(data[4 * (at - base):4 * (int(self.ends[doc]) - base)], crc)
                at, crc, doc = int(self.ends[doc]), 0, doc + 1
            crc = zlib.crc32(data[4 * (at - base):], crc)
            at = end
        while doc < self.n_docs:  # documents without ids, at the end
            yield 0
            doc += 1


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, vocabulary: int,
              id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None,
              block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the files; returns the manifest (one row per file)."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = id_bits(vocabulary)

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        store, path, out, writer = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, base = _store(folder)
                store.create_dir(base, recursive=True)
                path = f"{base}/ids-{part:07d}"
                attempt = f"{base}/_writing-{part:07d}-{TaskContext.get().taskAttemptId()}"
                out = store.open_output_stream(attempt)
                writer = IdWriter(out, bits, block_ids)
            keys = batch.column(0)
            nulls = np.asarray(keys.is_null())
            keys = np.asarray(keys.fill_null(0), dtype=np.int64)
            for i, ids, lens in encoder(tokenizer).column(batch.column(1)):
                with_end = np.insert(ids, np.cumsum(lens), np.uint32(end_id))
                writer.add(keys[i:i + len(lens)], nulls[i:i + len(lens)], with_end, lens + 1)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            store.move(attempt, path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                              "path": [f"{folder}/ids-{part:07d}"],
                                              "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = pick(docs, id=id_col, text=text_col).selectExpr("cast(id as long) as id", "cast(text as string) as text")
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    return landed(ordered.transform(map_arrow, write, MANIFEST), "ids_manifest")


def read_ids(spark: SparkSession, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before
    it), n_tokens, ids_crc32. The manifest has one row per file; the running
    total over its files is the only thing the driver works out."""
    files, base = [], 0
    for f in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((f["part"], f["path"], base))
        base += f["n_ids"]

    def read(batches):
        forget_encoders()  # the worker may have written the files
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                store, place = _store(path)
                with store.open_input_file(place) as file:
                    r = IdReader(file, file.size())
                    starts = np.concatenate(([0], r.ends[:-1])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(r.doc_ids, pa.int64(), mask=r.nulls), pa.array(starts + base),
                        pa.array(r.ends - starts), pa.array(np.fromiter(r.crcs(), np.int64, r.n_docs))],
                        names=["id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(files, schema_of("part int, path string, base long"))
    if files:
        table = table.repartitionByRange(len(files), "part")
    return (table.transform(map_arrow, read, "id long, start long, n_tokens long, ids_crc32 long")
            .withColumnRenamed("id", id_col))


def read_document(path: str, i: int) -> np.ndarray:
    """Ids of the i-th document of one file, by random access."""
    store, place = _store(path)
    with store.open_input_file(place) as file:
        return IdReader(file, file.size()).document(i)
