"""Token ids as sorted-string-table shards: documents by identifier, with binary-search lookup.

A shard file is a sequence of frames, each closed by one byte 0x0A:
  data block   entries (varint shared, varint unshared, varint value bytes, key suffix, value); keys are
               prefix-compressed against the entry before; then the CRC-32 of the block, 4 bytes
  block index  per block: varint key bytes, first key, offset u64, bytes u32 (a sparse index)
  Bloom filter of the keys: number of hashes u32, then its bits
  footer       86 bytes: magic, id width, shard, entries, ids, the places of index and filter, the first and
               the last key (length byte and 8 bytes each), CRC-32
Integers are little-endian. A key is the identifier as a big-endian 64-bit number with its sign bit
turned, so that bytes sort as numbers do; a null identifier is the empty key and sorts first. A value is
the document's ids, each of the footer's width.

Documents are dealt to shards by ranges of doc_id and written by Spark's text writer, which ends each
row with 0x0A: a shard is one task's rows, streamed, and appears whole or not at all when its task
commits, on any file system that Spark writes. Scans read shards as binary files, one file at a time.
Look-ups seek: a manifest (a row per shard: place, size, key range) is made once from the footers alone;
of a shard whose range holds a wanted identifier a task reads the footer, index and filter, and then
only the blocks that may have it. Seeking needs a file system that Arrow opens (local, HDFS, S3, GCS).

Defined results: a null text is empty and has the end id alone; rows that repeat a doc_id are entries
of their own, in the order of their texts; an empty table gives no shard with entries. Extra columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, small_batches
from weftline.llm.text import whole
from weftline.llm.tokenizing import SharedTokenizer, word_bpe_path
from weftline.llm.wordtable import give_back

END_ID = 2
#: Words and stems whose ids a writing task remembers: a shard's, mostly.
REMEMBERED = 300_000
SHARD_TEXT_BYTES = 32 << 20
CHUNK_BYTES = 8 << 20
#: Rows of an Arrow batch at most.
BATCH_ROWS = 2048
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"WLSST001"
FOOTER = "<8sIIQQQQQQ9s9sI"
FOOTER_BYTES = struct.calcsize(FOOTER)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


class ShardWriter:
    """Turns entries in key order into frames."""

    def __init__(self, shard: int, width: int, block_bytes: int = BLOCK_BYTES):
        self.shard, self.width, self.block_bytes = shard, width, block_bytes
        self.block, self.first, self.last = bytearray(), b"", b""
        self.offset = self.entries = self.n_ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []

    def _frame(self, data: bytes) -> bytes:
        self.offset += len(data) + 1
        return data

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:] + value
        self.last = key
        self.entries += 1
        self.n_ids += len(value) // self.width
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            yield self._close_block()

    def _close_block(self) -> bytes:
        data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
        self.index.append((self.first, self.offset, len(data)))
        self.block = bytearray()
        return self._frame(data)

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._close_block()
        index = bytearray()
        for key, offset, length in self.index:
            put_varint(index, len(key))
            index += key + struct.pack("<QI", offset, length)
        index_at = self.offset
        yield self._frame(bytes(index))
        bloom = struct.pack("<I", BLOOM_HASHES) + bloom_bits(self.hashes)
        bloom_at = self.offset
        yield self._frame(bloom)
        ends = [bytes([len(k)]) + k for k in (self.index[0][0] if self.index else b"", self.last)]
        head = struct.pack(FOOTER, MAGIC, self.width, self.shard, self.entries, self.n_ids, index_at, len(index), bloom_at, len(bloom), *ends, 0)[:-4]
        yield self._frame(head + struct.pack("<I", zlib.crc32(head)))


def bloom_places(h: np.ndarray, n_bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (h[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(n_bits)


def bloom_bits(hashes: list[int]) -> bytes:
    n_bits = max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8)
    bits = np.zeros(n_bits, np.uint8)
    bits[bloom_places(np.array(hashes, np.uint64), n_bits).ravel().astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


class Footer:
    def __init__(self, foot: bytes):
        magic, self.width, self.shard, self.entries, self.n_ids, self.index_at, self.index_len, self.bloom_at, self.bloom_len, first, last, crc = struct.unpack(FOOTER, foot)
        if magic != MAGIC or zlib.crc32(foot[:-4]) != crc:
            raise ValueError("not a shard, or a damaged one")
        self.first, self.last = (k[1 : 1 + k[0]] for k in (first, last))


class ShardReader:
    """A shard by what ``read(offset, length)`` gives of its ``size`` bytes: get by identifier, or scan in order.

    Footer, index and filter are read at once; a block when it is asked for.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        foot = Footer(bytes(read(size - FOOTER_BYTES - 1, FOOTER_BYTES)))
        self.width, self.shard, self.entries, self.n_ids = foot.width, foot.shard, foot.entries, foot.n_ids
        index, at = read(foot.index_at, foot.index_len), 0
        self.firsts, self.places = [], []
        while at < foot.index_len:
            n, at = get_varint(index, at)
            self.firsts.append(bytes(index[at : at + n]))
            self.places.append(struct.unpack_from("<QI", index, at + n))
            at += n + 12
        self.bloom = read(foot.bloom_at + 4, foot.bloom_len - 4)

    @classmethod
    def of(cls, data) -> ShardReader:
        """A shard that is at hand whole."""
        view = memoryview(data).cast("B")  # an Arrow buffer has signed bytes
        return cls(lambda offset, length: view[offset : offset + length], len(view))

    def may_hold(self, doc_id: int | None) -> bool:
        h = np.array([xxhash.xxh64_intdigest(key_of(doc_id))], np.uint64)
        return all(self.bloom[int(p) >> 3] >> (7 - (int(p) & 7)) & 1 for p in bloom_places(h, len(self.bloom) * 8)[0])

    def block(self, k: int) -> Iterator[tuple[bytes, memoryview]]:
        whole = memoryview(self.read(*self.places[k]))
        data = whole[:-4]
        if zlib.crc32(data) != struct.unpack("<I", whole[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            unshared, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = key[:shared] + bytes(data[at : at + unshared])
            at += unshared
            yield key, data[at : at + size]
            at += size

    def ids(self, value) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.places)):
            for key, value in self.block(k):
                yield id_of(key), self.ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry with this identifier: none, one, or those of repeated rows."""
        key, found = key_of(doc_id), []
        if not self.may_hold(doc_id):
            return found
        k = max(0, bisect_left(self.firsts, key) - 1)
        while k < len(self.places) and self.firsts[k] <= key:
            found += [self.ids(v) for own, v in self.block(k) if own == key]
            k += 1
        return found


def pieces(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts (column 1) have ``size`` bytes or the last text over it."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < batch.num_rows:
        stop = min(batch.num_rows, int(np.searchsorted(ends, before + size)) + 1)
        yield batch.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def write_shards(docs: DataFrame, root: str, tokenizer_path: str | None = None, end_id: int = END_ID, shard_text_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Encode every document and write its ids to the shards under root."""
    spark = docs.sparkSession
    shared = SharedTokenizer(spark, tokenizer_path or word_bpe_path())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # ranges cut by doc_id, then by the text's hash, so that rows repeating one doc_id need not meet
    texts = texts.repartitionByRange(max(1, -(-size // shard_text_bytes)), "doc_id", F.xxhash64("text"))
    texts = texts.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.tokenizer(REMEMBERED)
        writer = ShardWriter(TaskContext.get().partitionId(), tokenizer.width)
        end = end_id.to_bytes(tokenizer.width, "little")
        row = lambda frame: pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])
        for batch in batches:
            # texts that Arrow cuts into words together, of CHUNK_BYTES or little more
            for part in pieces(batch, CHUNK_BYTES):
                ids, begins = tokenizer.encode_all(part.column(1))
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    for frame in writer.add(key_of(doc_id), ids[begins[k] : begins[k + 1]].tobytes() + end):
                        yield row(frame)
        if writer.entries:
            for frame in writer.finish():
                yield row(frame)
        del tokenizer
        give_back()  # the worker may idle beside the next stage

    frames = texts.select("doc_id", "text").mapInArrow(run, "frame binary")
    with small_batches(spark, BATCH_ROWS):
        frames.select(F.col("frame").cast("string").alias("value")).write.mode("errorifexists").text(root)


def shards(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").load(root).where("length > 1")


def read_shards(spark: SparkSession, root: str, scratch: Scratch) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = ShardReader.of(content.as_buffer())
                at, out = 0, []
                for doc_id, ids in reader.scan():
                    out.append((reader.shard, doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)], names)

    names = ["shard", "doc_id", "local", "n_tokens", "ids_crc32"]
    rows = shards(spark, root).select("content").mapInArrow(run, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    rows = scratch.put(rows, "entries")
    # one row a shard: a running sum over them is small, whatever the number of documents
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard")


def seeker(path: str) -> tuple[Callable[[int, int], bytes], Callable[[], None]]:
    """(read, close): a file's bytes by offset and length."""
    system, at = pa.fs.FileSystem.from_uri(path)
    file = system.open_input_file(at)
    return (lambda offset, length: file.read_at(length, offset)), file.close


def make_manifest(spark: SparkSession, root: str, path: str) -> None:
    """Writes (path, size, shard, entries, first, last) of each shard under root, from the footers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read, close = seeker(file)
                foot = Footer(read(size - FOOTER_BYTES - 1, FOOTER_BYTES))
                close()
                out.append((file, size, foot.shard, foot.entries, foot.first, foot.last))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    names, types = ["path", "size", "shard", "entries", "first", "last"], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    # without its content column a binary file is listed, not read
    shards(spark, root).select("path", "length").mapInArrow(run, "path string, size long, shard int, entries long, first binary, last binary").write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, manifest: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids, bytes_read) of the wanted documents, by key ranges, filter, index and the blocks that may hold them.

    doc_ids is a list at hand, sent to every task. bytes_read counts all that was read of the shard, at its first row.
    """
    wanted = sorted({key_of(d) for d in doc_ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = wanted[bisect_left(wanted, first) : bisect_right(wanted, last)]
                if not here:
                    continue
                read, close = seeker(file)
                taken = []

                def counted(offset: int, length: int, read=read, taken=taken) -> bytes:
                    taken.append(length)
                    return read(offset, length)

                reader = ShardReader(counted, size)
                found = [(id_of(k), ids.tolist()) for k in here for ids in reader.get(id_of(k))]
                close()
                if found:
                    columns = [pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64())), pa.array([sum(taken)] + [0] * (len(found) - 1), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "bytes_read"])

    return spark.read.parquet(manifest).select("path", "size", "first", "last").mapInArrow(run, "doc_id long, ids array<long>, bytes_read long")


def token_shards(docs: DataFrame, tokenizer_path: str | None = None, scratch: Scratch | None = None, **options) -> DataFrame:
    """Write the shards of docs and return what reading them back gives."""
    scratch = scratch or Scratch(docs.sparkSession, "sstable")
    write_shards(docs, scratch.path("shards"), tokenizer_path, **options)
    return read_shards(docs.sparkSession, scratch.path("shards"), scratch)
