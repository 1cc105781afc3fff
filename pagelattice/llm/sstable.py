"""Operator 6, token ids in sorted-string-table shards.

Layout of a shard, little-endian but for keys:

    data block*    a zstd frame of entries in key order, about `block_bytes` before compression; an entry is
                   varint(bytes shared with the key before) varint(other key bytes) varint(value bytes) key value;
                   the first entry of a block shares nothing
    index          per block: first key (9 bytes), offset, length, entries, tokens in the blocks before (4 x u64)
    Bloom filter   `bloom_bits` bits per entry
    footer         offsets and lengths of index and filter, bits, blocks, entries, tokens, bytes per id (9 x u64), magic

A key is a byte that is 0 for a null identifier and 1 otherwise, then the identifier big-endian with its sign bit flipped,
so that keys sort as identifiers do, nulls first. A value is the ids of one document with its end id, in 2 bytes each
where the vocabulary allows, else in 4. Lookup asks the filter, then bisects the index, then reads one run of blocks.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.llm.chunks import shared_encoder
from pagelattice.llm.common import in_parts, new_folder, table, text_bytes

MAGIC = b"plSSTv01"
FOOTER = struct.Struct("<9Q8s")
INDEX = struct.Struct("<9s4Q")
HASHES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(keys: list[bytes], bits: int) -> np.ndarray:
    """Positions of all keys in a Bloom filter of so many bits, by double hashing."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).ravel()


class ShardWriter:
    """Takes documents in key order, writes one shard to a binary stream."""

    def __init__(self, out, wide: bool, block_bytes: int = 1 << 16, bloom_bits: int = 10):
        self.out, self.wide, self.block_bytes, self.bloom_bits = out, wide, block_bytes, bloom_bits
        self.offset = self.tokens = self.before = self.entries = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block, self.first, self.last = bytearray(), b"", b""
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        key, value = key_of(doc_id), ids if self.wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.tokens += len(ids) // 4
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            self.out.write(data)
            self.index.append(INDEX.pack(self.first, self.offset, len(data), self.entries, self.before))
            self.offset += len(data)
            self.before, self.entries, self.block = self.tokens, 0, bytearray()

    def close(self) -> None:
        self.flush()
        bits = max(64, -(-len(self.keys) * self.bloom_bits // 8) * 8)
        bloom = np.zeros(bits, dtype=np.uint8)
        bloom[_bits(self.keys, bits)] = 1
        index, packed = b"".join(self.index), np.packbits(bloom).tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), len(packed), bits, len(self.index), len(self.keys), self.tokens, 4 if self.wide else 2, MAGIC))


class ShardReader:
    """Over a seekable binary stream of `size` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        at, n, bloom_at, bloom_n, self.bits, self.blocks, self.entries, self.tokens, self.width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.index = list(INDEX.iter_unpack(self._at(at, n)))
        self.firsts = [e[0] for e in self.index]
        self.bloom = self._at(bloom_at, bloom_n)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        """Key and ids (little-endian unsigned 32-bit) of each entry."""
        _, offset, n, entries, _ = self.index[k]
        data, at, key = zstandard.ZstdDecompressor().decompress(self._at(offset, n)), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            value = data[at + own : at + own + size]
            at += own + size
            yield key, value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[int(b) >> 3] >> (7 - (int(b) & 7)) & 1 for b in _bits([key], self.bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document with this identifier; none if there is no such document."""
        key, found = key_of(doc_id), []
        if not self.entries or not self.may_hold(key):
            return found
        # the run of blocks that can hold the key; equal keys may go over a border
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            found += [v for x, v in self.block(k) if x == key]
        return found

    def rows(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Identifier, tokens before it in the shard, and ids, in key order."""
        for k in range(self.blocks):
            at = self.index[k][4]
            for key, ids in self.block(k):
                yield id_of(key), at, ids
                at += len(ids) // 4


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_bytes: int = 32 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes all documents and writes them in ascending order of doc_id to shards of about `shard_bytes` of text under `folder`.

    Returns the manifest, itself a table in `folder`: path, shard (ascending in doc_id), bytes, n_docs, n_tokens, start (tokens in the shards before).
    A null text counts as empty; null identifiers come first; documents with one identifier are all kept, next to each other, ordered by a hash of their
    text and the text, and can go over several shards; an empty table gives an empty manifest. Every attempt of a task writes a file of its own name, and the manifest, which Spark commits,
    names the file of the attempt that counts: a task that is repeated after a loss meets no file of the first attempt, which is left unread.
    """
    shards = max(1, -(-text_bytes(docs, text) // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, end = shared_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        place, base = pafs.FileSystem.from_uri(folder)
        path = f"{shard:07d}-{uuid.uuid4().hex}.sst"
        writer = None
        for b in in_parts(batches, 1):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if writer is None:
                    place.create_dir(base, recursive=True)
                    out = place.open_output_stream(f"{base}/{path}")
                    writer = ShardWriter(out, wide)
                writer.add(i, encoder.encode(t) + end)
        if writer is not None:
            writer.close()
            n = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "bytes": pa.array([n], pa.int64()), "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("order", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "order").sortWithinPartitions("doc_id", "order", "text").drop("order")
    rows.mapInArrow(run, "shard int, path string, bytes long, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return docs.sparkSession.read.schema("shard int, path string, bytes long, n_docs long, n_tokens long").parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def lookup(manifest: DataFrame, folder: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id and ids of every document with one of the identifiers: each shard is asked by its Bloom filter, then its index, and reads only the blocks that can hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                with place.open_input_file(f"{base}/{r['path']}") as f:
                    reader = ShardReader(f, r["bytes"])
                    found = [(i, np.frombuffer(x, "<u4")) for i in dict.fromkeys(doc_ids) for x in reader.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return manifest.select("path", "bytes").mapInArrow(run, "doc_id long, ids array<long>")


def read_shards(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, and ids where asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                with place.open_input_file(f"{base}/{r['path']}") as f:
                    cols: list[list] = [[] for _ in schema]
                    for i, at, ids in ShardReader(f, r["bytes"]).rows():
                        row = (i, r["start"] + at, len(ids) // 4, zlib.crc32(ids), *([np.frombuffer(ids, "<u4")] if with_ids else []))
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                        if len(cols[0]) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(cols, schema, strict=True)], schema=schema)
                            cols = [[] for _ in schema]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(cols, schema, strict=True)], schema=schema)

    spread = manifest.select("shard", "path", "bytes", "start").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op6_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), folder)
    return read_shards(manifest, folder)
