"""Token-ID output as sorted-string-table shards.

``write_tokens`` deals documents out by ranges of their key, sorts each range and writes one shard per range:

    block*  index  bloom  footer

A block holds entries in key order, each with the length of the prefix that its key shares with the key before it, the
rest of the key and the token ids; blocks are compressed with zstd. The sparse index has the last key, place and counts
of each block, the Bloom filter answers for absent keys, and the footer of fixed size says where both lie.
``read_tokens`` reads shards back in block ranges, ``lookup`` finds single documents by Bloom filter and binary search.

Keys: null sorts first, then ids in ascending order. Null texts count as empty; each document ends with ``end_id``.
Repeated ids are all kept, ordered by text. An empty table gives no shard and reads back as no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.shared import filesystem, new_path, stored

MAGIC = b"PLSST001"
FOOTER = struct.Struct("<QQQQQQB8s")  # index at, index bytes, bloom at, bloom bytes, documents, ids, bytes an id, magic
BLOOM_BITS, BLOOM_PROBES = 10, 7  # bits a key; about 1 % false positives
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long, n_bytes long, n_blocks int"


class PieceEncoder:
    """Byte-level BPE of whole texts by pieces, each encoded once by the tokenizers library and then remembered.

    The pre-tokenizer of this family starts a new pre-token at every space that follows a character other than white
    space, between a lone line feed and what follows it, and between a letter and punctuation. Cutting there changes no
    id, and pieces repeat much more than texts do. New pieces go to the library many at a time, as lines of one text.
    ``room`` bounds what is remembered: when so much is new, what was not used since the last time is forgotten. Results
    don't depend on it.
    """

    #: A word of plain letters and the punctuation behind it: two pre-tokens.
    WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str, room: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.room, self.used = room, 0
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}  # by what stands before a piece
        self.old: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.line_feed = self._alone("\n")
        self.runs, self.cuts = re.compile(r"\s\s"), re.compile(r"(?<=\S) ")
        # byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in prints]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}

    def pack(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _alone(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """A word of plain letters, with or without the space before it, is one pre-token: the model takes it as it is."""
        spelled = word if word.isascii() and word[0] != " " else word.encode().decode("latin-1").translate(self.alphabet)
        return self.pack([t.id for t in self.model.tokenize(spelled)])

    def _learn(self, piece: str, before: str) -> bytes:
        known, old = self.known[before], self.old[before]
        self.used += 1 + len(piece) // 64
        if (ids := old.get(piece)) is None:
            if (parts := self.WORD.fullmatch(piece)) is None:
                ids = self._alone(before + piece)
            else:
                word, tail = parts.groups()
                ids = known.get(word) or old.get(word) or self._word(before + word)
                if tail:
                    known[word] = ids
                    tails = self.known[""]
                    if tail not in tails:
                        tails[tail] = self._alone(tail)
                    ids += tails[tail]
        known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):  # these go before all cuts
            return self._alone(text)
        if self.used > self.room:
            self.old, self.known, self.used = self.known, {"": {}, " ": {}}, 0
        first, spaced, lines = self.known[""].get, self.known[" "].get, []
        for row in [self.cuts.split(text)] if self.runs.search(text) else [line.split(" ") for line in text.split("\n")]:
            ids = list(map(spaced, row))
            ids[0] = first(row[0])
            if None in ids:
                for i in [i for i, x in enumerate(ids) if x is None]:
                    ids[i] = self._learn(row[i], " " if i else "")
            lines.append(b"".join(ids))
        return self.line_feed.join(lines)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    def __init__(self, out, width: int, block_bytes: int):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1)
        self.at = self.n_docs = self.n_ids = self.in_block = self.ids_before = 0
        self.block, self.last, self.index, self.hashes = bytearray(), b"", [], []

    def add(self, key: bytes, ids: bytes) -> None:
        share = 0
        if self.in_block:
            while share < min(len(key), len(self.last)) and key[share] == self.last[share]:
                share += 1
        self.block += _varint(share) + _varint(len(key) - share) + _varint(len(ids)) + key[share:] + ids
        self.last, self.in_block, self.n_docs, self.n_ids = key, self.in_block + 1, self.n_docs + 1, self.n_ids + len(ids) // self.width
        self.hashes.append(key)
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.in_block:
            data = self.pack.compress(bytes(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QIIQ", self.at, len(data), self.in_block, self.ids_before))
            self.at += len(data)
            self.block, self.last, self.in_block, self.ids_before = bytearray(), b"", 0, self.n_ids

    def close(self) -> None:
        self.flush()
        index, bits = b"".join(self.index), max(64, BLOOM_BITS * self.n_docs)
        bloom = np.zeros(bits, dtype=bool)
        for i in range(0, len(self.hashes), 65536):
            bloom[_probes(self.hashes[i : i + 65536], bits).ravel()] = True
        filter_ = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + filter_ + FOOTER.pack(self.at, len(index), self.at + len(index), len(filter_), self.n_docs, self.n_ids, self.width, MAGIC))
        self.at += len(index) + len(filter_) + FOOTER.size
        self.out.close()


class Shard:
    """Reader of one shard: footer, index and Bloom filter first, blocks as needed."""

    def __init__(self, path: str):
        files, where = filesystem(path)
        self.file = files.open_input_file(where)
        size = self.file.size()
        at, n, self.bloom_at, self.bloom_bytes, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw, p, self.last_keys, self.blocks, self.bloom = self._bytes(at, n), 0, [], [], None
        while p < n:
            k, p = _take_varint(raw, p)
            self.last_keys.append(raw[p : p + k])
            self.blocks.append(struct.unpack_from("<QIIQ", raw, p + k))
            p += k + 24

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, ids of the shard before it, and its ids, packed."""
        at, n, docs, before = self.blocks[block]
        raw, p, key = zstandard.ZstdDecompressor().decompress(self._bytes(at, n)), 0, b""
        for _ in range(docs):
            share, p = _take_varint(raw, p)
            rest, p = _take_varint(raw, p)
            value, p = _take_varint(raw, p)
            key = key[:share] + raw[p : p + rest]
            ids = raw[p + rest : p + rest + value]
            p += rest + value
            yield key, before, ids
            before += value // self.width

    def get(self, key: bytes) -> list[bytes]:
        """The ids of all documents under a key."""
        if self.bloom is None:
            raw = self._bytes(self.bloom_at, self.bloom_bytes)
            self.bits, self.bloom = struct.unpack_from("<Q", raw)[0], np.frombuffer(raw, dtype=np.uint8, offset=8)
        p = _probes([key], self.bits)[0]
        if not np.all(self.bloom[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1):
            return []
        found = []
        for b in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            for k, _, ids in self.entries(b):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def write_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_bytes: int = 1 << 16) -> DataFrame:
    """Writes shards into the shared folder; returns their manifest, in which only files of tasks that ended well stand.

    Task attempts write files of their own name, so a repeated task never touches what another one has written.
    """
    spark = docs.sparkSession
    base = new_path(spark, "shards")
    files, where = filesystem(base)
    files.create_dir(where)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = path = first = last = None
        encode = encoder(tokenizer_path)
        end = encode.pack([end_id])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    path = f"{base}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
                    files, where = filesystem(path)
                    writer, first = ShardWriter(files.open_output_stream(where, compression=None), encode.width, block_bytes), doc_id
                writer.add(key_of(doc_id), encode.encode(text.as_py() or "") + end)
                last = doc_id
        if writer is not None:
            writer.close()
            row = {"shard": task.partitionId(), "path": path, "n_docs": writer.n_docs, "n_ids": writer.n_ids, "first_id": first, "last_id": last, "n_bytes": writer.at, "n_blocks": len(writer.index)}
            kinds = [("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_bytes", pa.int64()), ("n_blocks", pa.int32())]
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, *, split_bytes: int = 16 << 20, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (digest: ids_crc32 instead) from the shards.

    A shard of more than split_bytes is read by several tasks, each with blocks of its own.
    """
    ordered = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    parts = manifest.select("path", "n_bytes", F.coalesce(F.sum("n_ids").over(ordered), F.lit(0)).alias("before"))
    n = F.ceil(F.col("n_bytes") / F.lit(split_bytes)).cast("int")
    parts = parts.select("path", "before", n.alias("parts"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    kind = "ids_crc32 long" if digest else "ids array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                n_blocks = len(shard.blocks)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "value": []}
                for block in range(n_blocks * row["part"] // row["parts"], n_blocks * (row["part"] + 1) // row["parts"]):
                    for key, before, raw in shard.entries(block):
                        ids = np.frombuffer(raw, dtype=f"<u{shard.width}").astype("<u4")
                        out["doc_id"].append(id_of(key))
                        out["start"].append(row["before"] + before)
                        out["n_tokens"].append(len(ids))
                        out["value"].append(zlib.crc32(ids.tobytes()) if digest else ids.astype("<i4"))
                    if len(out["doc_id"]) >= 1000:
                        yield _batch(out, digest)
                        out = {k: [] for k in out}
                yield _batch(out, digest)

    # a number of our own, as rows of a few bytes that stand for megabytes would be merged into one task
    return parts.repartition(max(1, parts.count()), "path", "part").mapInArrow(read, f"doc_id long, start long, n_tokens long, {kind}")


def _batch(out: dict[str, list], digest: bool) -> pa.RecordBatch:
    value = pa.array(out["value"], pa.int64() if digest else pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("doc_id", "start", "n_tokens")), value], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def lookup(manifest: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of wanted documents: ids meet the shards whose range holds them, then binary search in each.

    The manifest has a row for each shard, so it is small enough to be sent to the tasks with the ids.
    """
    shards = manifest.select("path", "first_id", "last_id")
    near = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct().join(F.broadcast(shards), (F.col("first_id").isNull() | (F.col("doc_id") >= F.col("first_id"))) & (F.col("doc_id") <= F.col("last_id")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Shard] = {}
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["path"] not in opened:
                    opened.clear()
                    opened[row["path"]] = Shard(row["path"])
                shard = opened[row["path"]]
                found += [{"doc_id": row["doc_id"], "ids": np.frombuffer(x, dtype=f"<u{shard.width}").tolist()} for x in shard.get(key_of(row["doc_id"]))]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return near.select("path", "doc_id").repartitionByRange("path", "doc_id").sortWithinPartitions("path", "doc_id").mapInArrow(find, "doc_id long, ids array<int>")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), digest=True)
