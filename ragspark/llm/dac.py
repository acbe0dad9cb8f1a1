"""Token id files of directly addressable codes.

A file holds the ids of consecutive documents. Ids are cut into chunks of 8 bits, lowest first: level 0 has a byte
for every id, level 1 a byte for every id that goes on, and so on. Each level but the last has a bitmap that tells
which of its ids go on, and a rank directory with the number of set bits before each block of 512. The place of
an id on the next level is the rank of its bit, so any id is read with one step a level and nothing is decoded
before it.

Layout, little-endian: header (magic, version, levels, documents, ids); document starts (uint64, documents + 1);
per level its length (uint64), bytes, and if it is not the last the bitmap (uint64 words) and directory (uint64).
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.common import materialize, shared_dir, small_batches
from ragspark.llm.tokens import encoder, share_tokenizer

MAGIC, VERSION, BLOCK = b"DACT", 1, 512
HEADER = struct.Struct("<4sIIQQ")
#: Ids of a file at most, but for one document; they are what a task holds in memory.
FILE_IDS = 4_000_000


def encode(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file of these ids; starts: where each document begins, and the end."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 256
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = io.BytesIO()
    out.write(HEADER.pack(MAGIC, VERSION, len(levels), len(starts) - 1, len(ids)))
    out.write(starts.astype("<u8").tobytes())
    for i, (low, more) in enumerate(levels):
        out.write(struct.pack("<Q", len(low)))
        out.write(low.tobytes())
        if i + 1 < len(levels):
            bits = np.packbits(np.pad(more, (0, -len(more) % BLOCK)), bitorder="little")
            ones = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            out.write(bits.tobytes())
            out.write(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8").tobytes() if len(ones) else b"")
    return out.getvalue()


class Reader:
    """Random access to the ids of an open file, of which only the parts that are asked for are read."""

    def __init__(self, file):
        self.file = file
        magic, version, n_levels, self.n_docs, self.n_ids = HEADER.unpack(self._bytes(0, HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token id file of this version")
        at = HEADER.size + 8 * (self.n_docs + 1)
        self.levels = []  # where the bytes, the bitmap and the directory begin; None on the last level
        for i in range(n_levels):
            (n,) = struct.unpack("<Q", self._bytes(at, 8))
            low, at = at + 8, at + 8 + n
            blocks = -(-n // BLOCK)
            last = i + 1 == n_levels
            self.levels.append((low, None if last else at, None if last else at + blocks * BLOCK // 8))
            at += 0 if last else blocks * (BLOCK // 8 + 8)

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def starts(self, first: int, stop: int) -> np.ndarray:
        """Where the documents from first to stop begin; the one after the last is the end."""
        return np.frombuffer(self._bytes(HEADER.size + 8 * first, 8 * (stop - first)), "<u8").astype(np.int64)

    def _rank(self, level: int, place: int) -> int:
        """Set bits before place: the directory's count and those of at most BLOCK bits."""
        _, bits, ranks = self.levels[level]
        block, inside = divmod(place, BLOCK)
        (before,) = struct.unpack("<Q", self._bytes(ranks + 8 * block, 8)) if inside or place else (0,)
        part = int.from_bytes(self._bytes(bits + block * BLOCK // 8, -(-inside // 8)), "little") & ((1 << inside) - 1)
        return before + part.bit_count()

    def token(self, place: int) -> int:
        """The id at a place: of each level one byte, one bitmap block at most and one directory entry."""
        value = 0
        for level, (low, bits, _) in enumerate(self.levels):
            value |= self._bytes(low + place, 1)[0] << 8 * level
            if bits is None or not self._bytes(bits + place // 8, 1)[0] >> place % 8 & 1:
                break
            place = self._rank(level, place)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop: of each level only the part that they use."""
        if start >= stop:
            return np.empty(0, np.uint32)
        parts, (a, b) = [], (start, stop)
        for level, (low, bits, _) in enumerate(self.levels):
            flags = None
            if bits is not None:
                raw = np.frombuffer(self._bytes(bits + a // 8, -(-b // 8) - a // 8), np.uint8)
                flags = np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            parts.append((np.frombuffer(self._bytes(low + a, b - a), np.uint8), flags))
            if flags is None or not flags.any():
                break
            a = self._rank(level, a)
            b = a + int(np.count_nonzero(flags))
        value = parts[-1][0].astype(np.uint32)
        for low, flags in reversed(parts[:-1]):
            whole = low.astype(np.uint32)
            whole[flags] |= value << np.uint32(8)
            value = whole
        return value

    def document(self, k: int) -> np.ndarray:
        return self.slice(*self.starts(k, k + 2).tolist())


def _write(folder: str, shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(shared), TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        end = np.array([end_id], np.uint32)
        docs, held, size, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, size, seq
            starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])])
            name = f"{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(encode(np.concatenate([x for ids in held for x in (ids, end)]), starts))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": f"{folder}/{name}", "docs": docs, "n_ids": size}], schema=_files)
            docs, held, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                if size and size + len(ids) + 1 > FILE_IDS:
                    yield flush()
                docs.append(doc)
                held.append(ids)
                size += len(ids) + 1
        if docs:
            yield flush()

    return run


_files = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.list_(pa.int64())), ("n_ids", pa.int64())])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id and write the ids in ascending order of the ids of the documents.

    Returns the manifest, itself a table in the shared folder: part and seq (the partition, and its files in order),
    file, docs (ids of its documents in order), n_ids, first (ids in all files before it). folder is a URI that all executors reach, by default in the shared folder.
    The texts are range-partitioned and sorted by id; a task writes files of up to FILE_IDS ids under fresh names,
    and only the manifest of tasks that ended well names them, so a lost executor or a second attempt leaves no
    wrong file in it. The places of the files are sums of scalars, by partition and within it. Null texts are empty and have the end id only. Rows of equal ids all appear; null ids are first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if folder.startswith("/"):
        folder = f"file://{folder}"
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    shared = share_tokenizer(spark, tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(dealt.mapInArrow(_write(folder, shared, end_id), "part int, seq int, file string, docs array<long>, n_ids long"), "manifest")
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = by_part.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_inside")).join(bases, "part")
    return files.join(starts.select("part", "seq", (F.col("_base") + F.col("_inside")).alias("first")), ["part", "seq"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = pafs.FileSystem.from_uri(row["file"])
            with fs.open_input_file(path) as f:
                reader = Reader(f)
                starts, ids = reader.starts(0, reader.n_docs + 1), reader.slice(0, reader.n_ids)
            raw, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), (4 * starts).tolist()
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])]  # noqa: B905
            yield pa.RecordBatch.from_arrays([
                pa.array(row["docs"], pa.int64()), pa.array(row["first"] + starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64()),
            ], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of a manifest.

    A file, of FILE_IDS ids or one document, is decoded at once. The manifest is small, so its rows are dealt to as many
    tasks as a shuffle has, whatever their bytes.
    """
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "docs", "first").repartition(parts).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
