"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their identifiers.  Its layout:

    blocks   entries (shared key bytes, other key bytes, value bytes; keys are prefix-compressed)
    index    for each block: last key, place, length
    bloom    bits, set by two 64-bit hashes of each key
    footer   places and lengths of index and bloom, counts, element width, magic

All numbers are little-endian; keys are the identifiers as 8 bytes, big-endian with
the sign bit turned, so that bytes sort as numbers do.  A look-up reads footer, bloom
filter and index, then one block found by binary search.

Rows with a null identifier cannot be keyed: they are kept under the least identifier
and read back with a null.  Null text counts as empty.  Rows that repeat an identifier
stand next to each other, ordered by a hash of their text, and may fill several shards.
A text of any length is one value of one shard; shards are read back whole, so a text of
more than a billion tokens cannot be.  An empty table gives no shard and an empty table.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsmith.llm import _tokens, _vec
from pairsmith.sources import interim

MAGIC = b"TOKSST01"
FOOTER = struct.Struct("<QQQQQQII8s")
ENTRY = struct.Struct("<BBI")
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
#: Bytes of source text for one shard, about; for terabytes take more, as the driver holds the bounds and names of all.
SHARD_BYTES = 32 << 20
#: Rows drawn for each shard, from which its bounds are read.
DRAWN_PER_SHARD = 32


def key_bytes(identifier: int) -> bytes:
    return struct.pack(">Q", (identifier + (1 << 63)) & (2**64 - 1))


def key_number(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = _vec.mix(keys.astype(np.uint64)), _vec.mix(keys.astype(np.uint64) + np.uint64(_vec.BASE)) | np.uint64(1)
    return ((a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


class ShardWriter:
    """Takes (identifier, value bytes) in ascending order and makes the bytes of a shard, part by part."""

    def __init__(self, width: int):
        self.width, self.at, self.keys, self.index, self.n_values = width, 0, [], [], 0
        self.block, self.last = bytearray(), b""

    def add(self, identifier: int, value: bytes) -> bytes:
        key = key_bytes(identifier)
        shared = 0
        if self.block:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        self.block += ENTRY.pack(shared, 8 - shared, len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(identifier)
        self.n_values += len(value) // self.width
        return self._closed() if len(self.block) >= BLOCK_BYTES else b""

    def _closed(self) -> bytes:
        done = bytes(self.block)
        if done:
            self.index.append(self.last + struct.pack("<QQ", self.at, len(done)))
            self.at += len(done)
            self.block = bytearray()
        return done

    def finish(self) -> bytes:
        tail = self._closed()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS_PER_KEY // 64) * 64)
        bloom = np.zeros(bits, np.uint8)
        if self.keys:
            bloom[_bloom_places(np.array(self.keys, dtype=np.int64), bits).ravel()] = 1
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(self.index)
        at = self.at
        return tail + index + bloom + FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.n_values, self.width, zlib.crc32(index + bloom), MAGIC)


class ShardReader:
    """Reads a shard from any function of (place, length) to bytes."""

    def __init__(self, read, size: int):
        self.read = read
        at, n, bloom_at, bloom_n, self.n_keys, self.n_values, self.width, crc, magic = FOOTER.unpack(bytes(read(size - FOOTER.size, FOOTER.size)))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index, self.bloom = bytes(read(at, n)), np.frombuffer(bytes(read(bloom_at, bloom_n)), dtype=np.uint8)
        if zlib.crc32(index + self.bloom.tobytes()) != crc:
            raise ValueError("the index of a token shard is damaged")
        self.last_keys = [index[i : i + 8] for i in range(0, n, 24)]
        self.blocks = [struct.unpack_from("<QQ", index, i + 8) for i in range(0, n, 24)]

    def _entries(self, block: bytes) -> Iterator[tuple[bytes, bytes]]:
        at, key = 0, b""
        while at < len(block):
            shared, other, n = ENTRY.unpack_from(block, at)
            at += ENTRY.size
            key = key[:shared] + bytes(block[at : at + other])
            at += other
            yield key, block[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for at, n in self.blocks:
            for key, value in self._entries(self.read(at, n)):
                yield key_number(key), np.frombuffer(value, dtype=f"<u{self.width}")

    def get(self, identifier: int) -> np.ndarray | None:
        """The first document of that identifier, or None."""
        bits = _bloom_places(np.array([identifier], dtype=np.int64), len(self.bloom) * 8)[0]
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bits):
            return None
        key = key_bytes(identifier)
        i = bisect.bisect_left(self.last_keys, key)
        for at, n in self.blocks[i : i + 1]:
            for k, value in self._entries(self.read(at, n)):
                if k == key:
                    return np.frombuffer(value, dtype=f"<u{self.width}")
        return None


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("path", T.StringType()), ("n_docs", T.LongType()), ("n_tokens", T.LongType()), ("first_id", T.LongType()), ("last_id", T.LongType()))])


def write(df: DataFrame, folder: str, text: str = "text", id: str = "doc_id", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards to ``folder``; returns the stored manifest.

    Shards are ranges of (identifier, hash of the text, place in the table), so rows of one
    identifier can be divided.  Their bounds are read off rows drawn in proportion to their
    bytes: a range of long texts has as many shards as its bytes ask for.  Only ids are
    shuffled.
    """
    spark = df.sparkSession
    least = -(1 << 63)
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 8
    rows = df.select(F.coalesce(F.col(id).cast("long"), F.lit(least)).alias("key"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"), size.alias("size"), F.col(text).alias("t"))
    total = rows.agg(F.sum("size").alias("n")).first().n or 0
    n_shards = max(1, -(-total // shard_bytes))
    bounds: list[tuple[int, int, int]] = []
    if n_shards > 1:
        step = max(1, total // (n_shards * DRAWN_PER_SHARD))  # bytes for each row drawn
        luck = F.pmod(F.xxhash64("key", "h", "place"), F.lit(step))
        drawn = rows.select("key", "h", "place", F.floor((F.col("size") + luck) / step).cast("long").alias("times")).filter("times > 0")
        points = sorted((r.key, r.h, r.place, r.times) for r in drawn.collect())
        held, want = 0, sum(p[3] for p in points) / n_shards
        for *point, times in points:
            held += times
            if held >= want * (len(bounds) + 1) and len(bounds) < n_shards - 1:
                bounds.append(tuple(point))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.library(_tokens.vocabulary_path(vocabulary), dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        for batch, _, _ in _vec.steps(batches, text=3):
            ids = encoder.encode([t or "" for t in batch.column(3).to_pylist()])
            shard = [bisect.bisect_left(bounds, row) for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(0), batch.column(1), pa.array([x + end for x in ids], pa.binary())], names=["shard", "key", "h", "ids"])

    dtype = "<u2" if _fits_16_bits(vocabulary, end_id) else "<u4"
    width = int(dtype[-1])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, k, v) for b in batches for s, k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True))
        for shard, group in itertools.groupby(rows, key=lambda r: r[0]):
            files, root = _file_system(folder)
            files.create_dir(root, recursive=True)
            name = f"{root}/shard-{shard:06d}.sst"
            draft = f"{root}/.draft-{uuid.uuid4().hex}"
            writer = ShardWriter(width)
            first = last = None
            with files.open_output_stream(draft) as out:
                for _, k, v in group:
                    first, last = k if first is None else first, k
                    out.write(writer.add(k, v.as_py()))
                out.write(writer.finish())
            files.move(draft, name)  # a task that runs again puts the same bytes in place
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (f"{folder}/shard-{shard:06d}.sst", pa.string()), (len(writer.keys), pa.int64()), (writer.n_values, pa.int64()), (first, pa.int64()), (last, pa.int64()))], names=MANIFEST.names)

    ids = rows.select("key", "h", "place", "t").mapInArrow(encoded, "shard int, key long, h long, ids binary")
    placed = ids.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "h", "ids")
    return interim.stored(placed.mapInArrow(written, MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame, id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Every document of the shards in a manifest: id, start (ids before it in the whole order), n_tokens, ids_crc32, ids."""
    least = -(1 << 63)
    one = manifest.select("path").first()
    columns = ["path", id, "local_start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                reader = ShardReader(lambda at, n, data=data: data[at : at + n], len(data))
                start, rows = 0, []
                for k, ids in reader:
                    rows.append((k if k != least else None, start, len(ids), zlib.crc32(ids.astype("<u4")), ids.astype(np.int32) if with_ids else None))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield batch_of(path, rows)
                        rows = []
                if rows:
                    yield batch_of(path, rows)

    def batch_of(path: str, rows: list) -> pa.RecordBatch:
        k, start, n, crc, ids = zip(*rows, strict=True)
        out = [pa.array([path.rsplit("/", 1)[-1]] * len(rows), pa.string()), *(pa.array(x, pa.int64()) for x in (k, start, n, crc))]
        return pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.list_(pa.int32()))] if with_ids else out, names=columns)

    schema = f"path string, {_vec.quoted(id)} long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if one is None:
        return spark.createDataFrame([], schema).withColumn("start", F.lit(0).cast("long")).drop("path", "local_start")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each shard of many MB
    bases = manifest.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.coalesce(before, F.lit(0)).alias("base"))
    folder = one.path.rsplit("/", 1)[0]
    documents = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.sst").load(folder).select("path", "content").mapInArrow(parsed, schema)
    out = documents.join(F.broadcast(bases) if manifest.count() <= 10_000 else bases, "path")
    return out.select(id, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup(spark: SparkSession, manifest: DataFrame, identifier: int) -> list[int] | None:
    """The ids of one document: the manifest names the shard, then footer, bloom filter, index and one block are read."""
    for r in manifest.filter((F.col("first_id") <= identifier) & (F.col("last_id") >= identifier)).toLocalIterator():
        files, path = _file_system(r.path)
        with files.open_input_file(path) as f:
            found = ShardReader(lambda at, n, f=f: f.read_at(n, at), f.size()).get(identifier)
            if found is not None:
                return found.tolist()
    return None


def _fits_16_bits(vocabulary: str, end_id: int) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_tokens.vocabulary_path(vocabulary)).get_vocab_size() <= 1 << 16 and end_id < 1 << 16
