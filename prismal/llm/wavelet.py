"""Token files as wavelet matrices: compressed bit-planes with rank and select, one file for each shard."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path
from .word_bpe import default_path, encoder

#: Ids in a shard; a longer document has a shard of its own. Bits of a plane that are compressed together. Appended id.
SHARD_IDS, BLOCK_BITS, END_ID = 4_000_000, 1 << 18, 1
#: Bytes of texts that are encoded together: the more, the fewer words are met again.
BATCH_BYTES = 16 << 20
_MAGIC, LEAST = b"PWM2", -(1 << 63)
_SHARD = pa.schema([("uri", pa.string()), ("task", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, nulls: int = 0) -> bytes:
    """One shard, whose first `nulls` documents have no id. Layout: magic, header size, header (JSON), doc ids, lengths (int64), blocks.

    Plane k holds bit k, from the highest, of all ids, which are stably sorted by that bit before the next
    plane. The header has each plane's zeros, its ones before each block, and the blocks' sizes; a block that
    doesn't shrink is stored as it is.
    """
    bits = max(1, int(ids.max(initial=0)).bit_length())
    kind = np.uint16 if bits <= 16 else np.uint32
    level, planes, body, compress = ids.astype(kind), [], [], _compressor()[0].compress
    for k in range(bits - 1, -1, -1):
        ones = (level >> kind(k)) & kind(1) != 0
        packed = np.packbits(ones, bitorder="little").tobytes()
        before, sizes = [0], []
        for at in range(0, len(packed), BLOCK_BITS // 8):
            block = packed[at : at + BLOCK_BITS // 8]
            before.append(before[-1] + int(np.count_nonzero(ones[at * 8 : at * 8 + BLOCK_BITS])))
            small = compress(block)
            body.append(small if len(small) < len(block) else block)
            sizes.append(len(small) if len(small) < len(block) else -len(block))
        planes.append({"zeros": len(level) - before[-1], "before": before, "sizes": sizes})
        level = np.concatenate([level[~ones], level[ones]])
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "nulls": nulls, "bits": bits, "planes": planes}).encode()
    return b"".join([_MAGIC, struct.pack("<I", len(header)), header, doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), *body])


class Plane:
    def __init__(self, about: dict, blocks: list[bytes], n: int):
        self.zeros, self.before, self.sizes, self.blocks, self.n = about["zeros"], about["before"], about["sizes"], blocks, n
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint8))

    def block(self, b: int) -> np.ndarray:
        if self._last[0] != b:
            raw = self.blocks[b] if self.sizes[b] < 0 else _compressor()[1].decompress(self.blocks[b])
            self._last = b, np.frombuffer(raw, np.uint8)
        return self._last[1]

    def bit(self, i: int) -> int:
        return int(self.block(i // BLOCK_BITS)[i % BLOCK_BITS // 8]) >> (i % 8) & 1

    def rank1(self, i: int) -> int:
        """Ones before i."""
        b, rest = divmod(i, BLOCK_BITS)
        if not rest:
            return self.before[b]
        block = self.block(b)
        return self.before[b] + int(_ONES[block[: rest // 8]].sum()) + (bin(int(block[rest // 8]) & ((1 << rest % 8) - 1)).count("1") if rest % 8 else 0)

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Where the k-th (from 0) of this bit is."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.rank(bit, mid + 1) <= k else (low, mid)
        return low

    def all(self) -> np.ndarray:
        return np.unpackbits(np.concatenate([self.block(b) for b in range(len(self.blocks))] or [np.zeros(0, np.uint8)]), count=self.n, bitorder="little").astype(bool)


class WaveletMatrix:
    """Reads what build() made, without unpacking more than the blocks asked for."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        size = struct.unpack("<I", data[4:8])[0]
        about = json.loads(data[8 : 8 + size])
        self.n, self.bits, self.nulls, at = about["n"], about["bits"], about["nulls"], 8 + size
        self.doc_ids = np.frombuffer(data, "<i8", about["docs"], at)
        self.lengths = np.frombuffer(data, "<i8", about["docs"], at := at + 8 * about["docs"])
        at += 8 * about["docs"]
        self.planes = []
        for p in about["planes"]:
            blocks = []
            for s in p["sizes"]:
                blocks.append(data[at : at + abs(s)])
                at += abs(s)
            self.planes.append(Plane(p, blocks, self.n))

    def access(self, i: int) -> int:
        """The id at i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        found = 0
        for p in self.planes:
            bit = p.bit(i)
            found = found << 1 | bit
            i = p.zeros + p.rank1(i) if bit else i - p.rank1(i)
        return found

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        if token >> self.bits:
            return 0, 0
        for k, p in enumerate(self.planes):
            if token >> (self.bits - 1 - k) & 1:
                low, high = p.zeros + p.rank1(low), p.zeros + p.rank1(high)
            else:
                low, high = low - p.rank1(low), high - p.rank1(high)
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        """How often an id occurs, before `end` if given."""
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Where an id occurs the k-th time, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for j in range(self.bits - 1, -1, -1):
            p, bit = self.planes[j], token >> (self.bits - 1 - j) & 1
            at = p.select(bit, at - p.zeros if bit else at)
        return at

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, by undoing the sorts from the last plane on."""
        level = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k, p in enumerate(reversed(self.planes)):
            ones, up = p.all(), np.empty_like(level)
            up[~ones], up[ones] = level[: p.zeros], level[p.zeros :] | level.dtype.type(1 << k)
            level = up
        return level


def open_shard(uri: str) -> WaveletMatrix:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return WaveletMatrix(f.read())


def _store(folder: str, name: str, data: bytes) -> str:
    """Each attempt of a task writes a file of its own, so a lost or repeated one does no harm."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as f:
        f.write(data)
    return f"{folder}/{name}"


def write_shards(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all documents in ascending doc_id order; a row for each shard: uri, task, first_doc, n_docs, n_ids, start.

    docs has doc_id and text; a null or empty text is end_id alone. Ids that repeat stand side by side, in order of
    their texts; null ids come first and read back as null. An empty table makes no shard. Rows are
    dealt out by ranges of doc_id, which is even for ids that are unique. The list of shards is written before
    it is used, so only files of successful attempts are in it. The folder is a URI that pyarrow can open.
    """
    spark, path = docs.sparkSession, path or default_path()
    folder = folder or new_path(spark, "wavelet")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = encoder(path).encode_all, int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            nulls = sum(d is None for d, _ in held)
            data = build(ids, np.array([LEAST if d is None else d for d, _ in held], np.int64), np.array([len(x) // 4 for _, x in held], np.int64), nulls)
            uri = _store(folder, f"{task:06d}-{uuid.uuid4().hex}.pwm", data)
            # A shard that begins with null ids begins before every other one.
            about = {"uri": uri, "task": task, "first_doc": held[0][0], "n_docs": len(held), "n_ids": len(ids)}
            return pa.RecordBatch.from_pylist([about], _SHARD)

        for batch in batches:
            for doc_id, none, own in zip(batch.column("doc_id").to_pylist(), batch.column("none").to_pylist(), encode(batch.column("text"), BATCH_BYTES), strict=True):
                doc_id = None if none else doc_id
                ids = own + end
                if held and size + len(ids) // 4 > shard_ids:
                    yield flush()
                    held, size = [], 0
                held.append((doc_id, ids))
                size += len(ids) // 4
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), F.col("doc_id").isNull().alias("none"), "text")
    ordered = rows.repartitionByRange("has_id", "doc_id").sortWithinPartitions("has_id", "doc_id", "text").select("doc_id", "none", "text")
    shards = materialize(ordered.mapInArrow(run, "uri string, task int, first_doc long, n_docs long, n_ids long"), "shards")
    # Sums over tasks, of which there are as many as partitions, and then within each.
    tasks = shards.groupBy("task").agg(F.min(F.coalesce("first_doc", F.lit(LEAST))).alias("_first"), F.max(F.col("first_doc").isNull()).alias("_null"), F.sum("n_ids").alias("_ids"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("_ids").over(before(Window.orderBy(F.desc("_null"), "_first"))), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("task").orderBy("first_doc", "uri"))), F.lit(0))
    return shards.join(tasks, "task").withColumn("start", F.col("_before") + within).drop("_before")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit) of every document, from the files that write_shards() lists.

    Documents without an id have a null one; empty ones have the end id alone; repeated ids and rows are all there. A list of
    no shards gives an empty table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start in zip(batch.uri, batch.start, strict=True):
                shard = open_shard(uri)
                data, ends = memoryview(shard.ids().astype("<u4").tobytes()), shard.lengths.cumsum()
                for at in range(0, len(ends), 512):
                    part = slice(at, at + 512)
                    first = ends[part] - shard.lengths[part]
                    doc_ids = pd.array(shard.doc_ids[part], dtype="Int64")
                    doc_ids[: max(0, shard.nulls - at)] = None
                    yield pd.DataFrame({"doc_id": doc_ids, "start": start + first, "ids": [bytes(data[4 * a : 4 * b]) for a, b in zip(first, ends[part], strict=True)]})

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("uri", "start").repartition(parts).mapInPandas(run, "doc_id long, start long, ids binary")


def digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of read_documents()."""
    rows = read_documents(shards)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
