"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into segments, few enough that near ones differ in at most one bit of some segment. Every segment is
indexed as it is and under each of its one-wildcard variants. Two nodes meet where they are equal, or where the wildcard's
bit is all that differs; so an equality join on the signature finds them, at most once for each segment.

1. In a bucket, members in order are compared with the ``BACK`` members before them, which is every pair of a bucket of up to
   ``BACK + 1`` members. In larger buckets only the unchanged segments are used for this, which chains groups of near copies.
   Components over the links found collapse these groups.
2. What is left are pairs of different components in larger buckets. Their nodes, with their component, are indexed again;
   buckets of one component go, and of the others the largest component is taken on one side only. Where all differing bits
   are bounded, buckets of more than ``HOT_BUCKET`` members are split by pieces of the other bits, one more than bits may
   differ, so that one is equal.

No link between fingerprints is lost on the way, and pairs inside a large group are never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.components import connected_components
from partloom.llm.shared import bounded, field, kind_of, numbered, stored, without

BACK, HOT_BUCKET = 7, 256
SEED = 42
_CHUNK = 1 << 16
_EXACT = 31  # in place of a wildcard's number: the segment as it is


@dataclass(frozen=True)
class Cut:
    """Segments (which long of the fingerprint, first bit, bits). max_bits: the most bits of all that may differ, if that is
    bounded; then the fingerprint is one long, which is the node as well."""

    segments: tuple[tuple[int, int, int], ...]
    max_bits: int | None = None

    def pieces(self, bits: int) -> list[tuple[int, int]]:
        """bits, cut into one piece more than bits may differ."""
        n = self.max_bits + 1
        return [(bits * i // n, bits * (i + 1) // n - bits * i // n) for i in range(n)]


FOUR_BITS = Cut(((0, 0, 22), (0, 22, 21), (0, 43, 21)), 4)
COPY_LONGS, COPY_BITS = 4, 24  # longs of a text's fingerprint with two segments each
COPIES = Cut(tuple((i, COPY_BITS * j, COPY_BITS) for i in range(COPY_LONGS) for j in range(2)))
COPY_WORDS, MARK_WORDS = 5, 16  # words of a shingle; longs of a bit map of a text's shingles


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """64 bits, as a signed number, of the shingles of a whole text; 0 if it has no words."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    k = min(words, len(parts))
    begins = np.concatenate(([0], gaps + 1))[: len(parts) - k + 1]
    ends = np.concatenate((gaps, [len(joined)]))[k - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(begins), _CHUNK):
        hashes = [digest(joined[b:e], SEED) for b, e in zip(begins[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), words) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(c: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << bits) - 1))


def _shifted(c: Column, by: int) -> Column:
    return F.shiftleft(c.cast("long"), by)


def keyed(nodes: DataFrame, cut: Cut, *columns: str) -> DataFrame:
    """nodes (fp, and more) with a row for each signature: columns, key, and the bit that the key has no room for."""
    segments = F.array(*[_bits(F.col("fp")[i], first, bits) for i, first, bits in cut.segments])
    parts = nodes.select(*columns, F.posexplode(segments).alias("s", "v"))
    head = lambda i: _shifted(F.col("s") * 32 + i, 32)
    wild = [head(i).bitwiseOR(F.col("v").bitwiseAND(F.lit(~(1 << i)))).bitwiseOR(_shifted(_bits(F.col("v"), i, 1), 62)) for i in range(max(b for *_, b in cut.segments))]
    rows = parts.select(*columns, F.explode(F.array(head(_EXACT).bitwiseOR(F.col("v")), *wild)).alias("k"))
    return rows.select(*columns, F.col("k").bitwiseAND(F.lit(~(1 << 62))).alias("key"), F.shiftright("k", 62).alias("bit"))


def _exact(key: Column) -> Column:
    return F.shiftright(key, 32).bitwiseAND(F.lit(31)) == _EXACT


def _pieces(fp: Column, key: Column, cut: Cut) -> Column:
    """For a bucket's members: the pieces of the bits outside the bucket's segment."""

    def of(start: int, bits: int) -> Column:
        low = fp.bitwiseAND(F.lit((1 << start) - 1))
        rest = low if start + bits == 64 else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, start + bits), start))
        return F.array(*[_bits(rest, a, n).bitwiseOR(F.lit((p + 1) << 32)) for p, (a, n) in enumerate(cut.pieces(64 - bits))])

    options = [of(start, bits) for _, start, bits in cut.segments]
    segment = F.shiftright(key, 37)
    return reduce(lambda c, i: c.when(segment == i, options[i]), range(1, len(options)), F.when(segment == 0, options[0]))


def link_fingerprints(nodes: DataFrame, cut: Cut = FOUR_BITS, verify: Callable[[DataFrame], DataFrame] | None = None, may: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """nodes (node long, distinct; fp array of longs; mark) to node and component, the smallest node that links reach.

    Links are pairs that meet in a signature and, where cut bounds them, differ in no more bits in all. verify takes pairs
    (a, b, and more columns) and returns those that are to be linked; all, if not given. may is a condition on two marks
    that holds for every pair that verify returns; it keeps pairs of large buckets from being made only to be refused.
    """
    own = Window.partitionBy("key")
    order = own.orderBy("node", "bit")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= cut.max_bits if cut.max_bits is not None else F.lit(True)
    back = F.array(*(F.lag(F.struct("node", "bit"), i).over(order) for i in range(1, BACK + 1)))
    sized = keyed(nodes, cut, "node").select("key", "node", "bit", F.count("*").over(own).alias("n"), back.alias("back")).where("n > 1")
    exact = _exact(F.col("key"))
    met = F.when((F.col("n") <= BACK + 1) | exact, F.filter("back", lambda x: x.isNotNull() & (exact | (x.bit != F.col("bit"))) & near(x.node, F.col("node")))).otherwise(F.slice("back", 1, 0))
    sized = sized.select("node", (F.col("n") > BACK + 1).alias("large"), F.transform(met, lambda x: x.node).alias("met"))
    members = stored(sized.where("large or size(met) > 0"), "buckets")
    links = members.select(F.col("node").alias("a"), F.explode("met").alias("b")).distinct()
    stars = connected_components(verify(links) if verify else links)

    large = members.where("large").select("node").distinct().join(nodes, "node").join(stars, "node", "left")
    large = stored(large.select("node", "fp", F.col("mark") if may else F.lit(0).alias("mark"), F.coalesce("component", "node").alias("star")), "large")
    large = large.join(large.groupBy("star").agg(F.count("*").alias("of_star")), "star")
    main = F.max(F.struct("of_star", "star")).over(own).getField("star")
    mixed = keyed(large, cut, "node", "star", "of_star", "mark").select("key", "bit", "node", "star", "mark", F.count("*").over(own).alias("n"), main.alias("main"), F.min("star").over(own).alias("low"), F.max("star").over(own).alias("high"))
    mixed = stored(mixed.where((F.col("low") != F.col("high")) & (F.col("n") > BACK + 1)).drop("low", "high"), "mixed")
    if cut.max_bits is not None:
        hot = mixed.where(F.col("n") > HOT_BUCKET).select("*", F.explode(_pieces(F.col("node"), F.col("key"), cut)).alias("part"))
        mixed = mixed.where(F.col("n") <= HOT_BUCKET).withColumn("part", F.lit(0).cast("long")).union(hot)
        on = ["key", "part"]
    else:
        on = ["key"]
    left = mixed.where("star <> main").select(*on, F.col("bit").alias("bit_a"), F.col("node").alias("a"), F.col("star").alias("star_a"), F.col("mark").alias("mark_a"))
    right = mixed.select(*on, F.col("bit").alias("bit_b"), F.col("node").alias("b"), F.col("star").alias("star_b"), F.col("mark").alias("mark_b"), (F.col("star") == F.col("main")).alias("in_main"))
    meet = (F.col("star_a") != F.col("star_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & (_exact(F.col("key")) | (F.col("bit_a") != F.col("bit_b"))) & near(F.col("a"), F.col("b"))
    meet = meet & may(F.col("mark_a"), F.col("mark_b")) if may else meet  # the dearest condition last
    links = left.join(right, on).where(meet).select("a", "b", "star_a", "star_b").distinct()
    links = verify(links) if verify else links
    joined = connected_components(links.select(F.col("star_a").alias("a"), F.col("star_b").alias("b")).distinct())

    stars = nodes.select("node").join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("star"))
    return stars.join(joined.select(F.col("node").alias("star"), F.col("component").alias("joined")), "star", "left").select("node", F.coalesce("joined", "star").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row.

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows have equal fingerprints and so
    one component. Rows with a null id take part; a component of such rows alone has a null component_id. An empty table
    gives no rows; extra columns are ignored.
    """
    rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    linked = link_fingerprints(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("fp"))).withColumnRenamed("node", "fp")
    of_fp = stored(linked.join(distinct, "fp"), "linked")
    lowest = of_fp.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(of_fp.join(lowest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    """64 bits of each word, computed once for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _Words()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def set_fingerprint(hashes: np.ndarray) -> list[int]:
    """``COPY_LONGS`` numbers of twice ``COPY_BITS`` bits of the distinct words: which bits more than half of them have."""
    kinds, out = np.unique(hashes), []
    for i in range(COPY_LONGS):
        ones, own = np.zeros(2 * COPY_BITS, dtype=np.int64), np.uint64((int(_FACTOR) * (i + 1)) & (1 << 64) - 1)
        for at in range(0, len(kinds), _CHUNK):
            some = np.ascontiguousarray(_mixed(kinds[at : at + _CHUNK] + own).view(np.uint8).reshape(-1, 8)[:, : COPY_BITS // 4])
            ones += np.add.reduce(np.unpackbits(some, axis=1, bitorder="little"), axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(kinds), bitorder="little").tobytes(), "little"))
    return out


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles of five words, or of all if there are fewer, sorted. A shingle's 64 bits are made of its words'."""
    k = max(1, min(COPY_WORDS, len(hashes)))
    n = max(0, len(hashes) - k + 1)
    key = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        key = key * _FACTOR + hashes[j : j + n]
    return np.unique(_mixed(key).view(np.int64)) if n else np.zeros(1, dtype=np.int64)


def _alike(n: Column, m: Column, same: Column) -> Column:
    """Jaccard similarity of 4/5 or more, of the sizes of two sets and of what they share."""
    return 9 * same >= 4 * (n + m)


def may_be_alike(a: Column, b: Column) -> Column:
    """A bit that only one map has set stands for a shingle at least that only one text has, which bounds what they share."""
    only = lambda x, y: sum((F.bit_count(F.get(x.bits, i).bitwiseAND(F.bitwise_not(F.get(y.bits, i)))) for i in range(MARK_WORDS)), F.lit(0))
    return _alike(a.n, b.n, F.least(a.n, b.n)) & _alike(a.n, b.n, F.least(a.n - only(a, b), b.n - only(b, a)))


def copy_groups(docs: DataFrame, *, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id and group of every row of docs, whose row_col is unique and stays the same however often it is read.

    Texts are compared by lower-cased (A-Z) words. Equal ones are of a group; others are linked if their fingerprints of
    distinct words differ in at most one bit of one of eight segments (``COPIES``) and the Jaccard similarity of their
    five-word shingles is verified to be 0.8 or more. Texts without words are equal to each other.
    """
    row_kind = kind_of(docs, row_col)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fp, mark = [], [], []
            for text in batch.column(2):
                words = (text.as_py() or b"").lower().split()
                hashes = _word_hashes(words)
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                fp.append(set_fingerprint(hashes))
                shingles = shingle_hashes(hashes)
                bits = np.zeros(64 * MARK_WORDS, dtype=bool)
                bits[shingles.view(np.uint64) % np.uint64(64 * MARK_WORDS)] = True
                mark.append({"n": len(shingles), "bits": np.packbits(bits, bitorder="little").view("<i8")})
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.binary()), pa.array(fp, pa.list_(pa.int64())), pa.array(mark, kind)], ["row", "doc_id", "same", "fp", "mark"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(_word_hashes((text.as_py() or b"").lower().split())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    kind = pa.struct([("n", pa.int64()), ("bits", pa.list_(pa.int64()))])
    texts = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = stored(texts.mapInArrow(nodes, f"row {row_kind}, doc_id long, same binary, fp array<long>, mark struct<n long, bits array<long>>"), "nodes")
    first = rows.groupBy("same").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("mark").alias("mark"))
    distinct = stored(first.withColumn("node", F.monotonically_increasing_id()), "distinct")

    def alike(pairs: DataFrame) -> DataFrame:
        marks = distinct.select("node", "mark")
        pairs = pairs.join(marks.select(F.col("node").alias("a"), F.col("mark").alias("mark_a")), "a").join(marks.select(F.col("node").alias("b"), F.col("mark").alias("mark_b")), "b")
        pairs = stored(pairs.where(may_be_alike(F.col("mark_a"), F.col("mark_b"))).drop("mark_a", "mark_b"), "pairs")
        asked = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(distinct, "node").select("node", "row"), "asked")
        sets = stored(texts.join(bounded(asked), "row").select("node", "text").mapInArrow(shingles, "node long, shingles array<long>"), "shingles")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        return both.where(_alike(F.size("of_a"), F.size("of_b"), F.size(F.array_intersect("of_a", "of_b")))).select(*pairs.columns)

    linked = link_fingerprints(distinct.select("node", "fp", "mark"), COPIES, alike, may_be_alike)
    groups = stored(linked.join(distinct.select("node", "same"), "node").select("same", F.col("component").alias("group")), "groups")
    return rows.select("row", "doc_id", "same").join(groups, "same").select("row", "doc_id", "group")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """docs with one row of each group of copy_groups: that of the smallest id, null last. row: see ``numbered``."""
    rows = numbered(docs, row)
    groups = stored(copy_groups(rows.select("row", field(id_col).alias("doc_id"), field(text_col).alias("text")), row_col="row"), "copies")
    stay = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).getField("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = groups.join(stay, "group").where("row <> first").select("row")
    return without(rows, gone).select("doc.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
