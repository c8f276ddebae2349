"""Document fingerprints of Lempel-Ziv phrases.

A text is parsed into phrases (Ziv and Lempel, 1978): each is the longest phrase met so far in the text and one character
more. Texts that compress each other well share many phrases, so the likeness of two texts is the Jaccard similarity of
their sets of phrases, estimated from minimum hashes: a fingerprint holds the ``MINIMA`` smallest 32-bit hashes of the set,
and the likeness is the share of the smallest hashes of both sets' union that both have. It is exact while the union has
no more phrases than that; beyond, its standard error is at most 0.5 / sqrt(MINIMA).

A parse depends on nothing but what comes before, so texts with a common beginning share the parse of it: an edited text is
parsed only from where it differs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.shared import kind_of, numbered, stored

MINIMA = 128
#: Ranges of documents a task, keys sampled a range, documents a task at most; they place documents, results don't depend on them.
RANGES, SAMPLED, TASK_ROWS = 6, 8, 200_000
_OUT_ROWS = 512


def parse(text: str, known: dict[str, None] | None = None, at: int = 0) -> list[str]:
    """The phrases of text from position at, in order; they are the text cut into pieces, but for an end that is known.
    known: phrases that are there already."""
    known = {} if known is None else known
    before, rest = len(known), iter(text[at:] if at else text)
    for c in rest:
        if c not in known:
            known[c] = None
            continue
        phrase = c
        for c in rest:
            phrase += c
            if phrase not in known:
                known[phrase] = None
                break
    return [*known][before:]


_FACTOR, _MIX, _FINAL = 0x5851F42D4C957F2D, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse modulo 2^64, at least n of them."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(1 << n.bit_length(), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def hashes(text: str, sizes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each phrase, of phrases that follow each other from the beginning of text: their polynomials modulo
    2^64 from running sums, then mixed. A phrase's hash is the same wherever it stands."""
    n = int(sizes.sum())
    up, down = _grown(n)
    c = (np.frombuffer(text[:n].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)) * _MIX
    c ^= c >> np.uint64(29)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(c * up[:n], out=sums[1:])
    ends = np.cumsum(sizes)
    h = (sums[ends] - sums[ends - sizes]) * down[ends - sizes]
    h ^= h >> np.uint64(32)
    h *= _FINAL
    return (h >> np.uint64(32)).astype(np.uint32)


def _sizes(phrases: list[str]) -> np.ndarray:
    return np.fromiter(map(len, phrases), dtype=np.int64, count=len(phrases))


def minima(found: np.ndarray) -> np.ndarray:
    """The MINIMA smallest, ascending, each once; of many only the smallest are sorted."""
    least = np.unique(np.partition(found, 4 * MINIMA)[: 4 * MINIMA] if len(found) > 4 * MINIMA else found)
    return (least if len(least) >= MINIMA else np.unique(found))[:MINIMA]


def fingerprint(text: str) -> np.ndarray:
    return minima(hashes(text, _sizes(parse(text))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1; two texts without phrases are alike, and one without is like no other."""
    both = np.sort(np.concatenate((a, b)))
    new = np.concatenate((np.ones(min(1, len(both)), dtype=bool), both[1:] != both[:-1]))
    union = both[new][:MINIMA]
    return float((both[~new] <= union[-1]).sum() / len(union)) if len(union) else 1.0


def written(least: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash, ascending."""
    return least.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


@dataclass
class Parsed:
    text: str
    phrases: list[str]
    sizes: np.ndarray
    found: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, text: str) -> Parsed:
        phrases = parse(text)
        sizes = _sizes(phrases)
        found = hashes(text, sizes)
        return cls(text, phrases, sizes, found, minima(found))

    def edited(self, other: Parsed) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by the beginning of another, and its smallest hashes."""
        half = len(self.text) // 2
        head = len(self.text) - half
        text = self.text[:head] + other.text[:half]
        ends = np.cumsum(self.sizes)
        same = int(np.searchsorted(ends, head, side="right"))
        at = int(ends[same - 1]) if same else 0
        new = parse(text, dict.fromkeys(self.phrases[:same]), at)
        return text, minima(np.concatenate((self.found[:same], hashes(text[at:], _sizes(new)))))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row, of its whole text; an empty text, as a null one counts, has the fingerprint ''.
    Equal texts have equal fingerprints, whatever their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array((written(fingerprint(t.as_py() or "")) for t in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind_of(docs, id_col)}, fingerprint string")


def _in_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """rows with the number of their key's range, by cuts that are chosen from a sample of about SAMPLED keys a range."""
    keys = rows.select("key")
    every = max(1, keys.count() // (SAMPLED * ranges))
    step = max(1, math.isqrt(ranges))
    sample = keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).agg(F.sort_array(F.collect_list("key")).alias("s"))
    cuts = F.array_distinct(F.filter(F.transform(F.expr(f"slice(sequence(0, {ranges}), 2, {ranges - 1})"), lambda i: F.get(F.col("s"), F.floor(i * F.size("s") / ranges).cast("int"))), lambda k: k.isNotNull()))
    groups = F.transform(F.expr("slice(sequence(0, size(cuts)), 1, cast(ceil(size(cuts) / step) as int))"), lambda g: F.slice("cuts", g * F.col("step") + 1, F.col("step")))
    groups = stored(sample.select(cuts.alias("cuts"), F.lit(step).alias("step")).select(groups.alias("groups")), "cuts")  # one row
    passed = F.size(F.filter("groups", lambda g: F.get(g, F.lit(0)) <= F.col("key")))
    inside = F.size(F.filter(F.get("groups", F.col("passed") - 1), lambda c: c <= F.col("key")))
    ranged = rows.withColumn("groups", groups.scalar()).withColumn("passed", passed)
    return ranged.withColumn("range", F.when(F.col("passed") == 0, 0).otherwise((F.col("passed") - 1) * step + inside)).drop("groups", "passed")


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """For every document its fingerprint, that of its edited text, and how like it is to the edited text and to the next one.

    The next document is that with the next smaller id, rows of one id by ``row``, nulls last; after the last comes the
    first, so a single document is its own next. The edited text has its last half (whole code points, rounded down)
    replaced by as much of the beginning of the next text, or all of it. Null texts count as empty ones. An empty table gives
    no rows; extra columns are ignored. row: a column that tells rows apart and orders them, the same however often docs is
    read; else docs is written once with numbers.

    Documents are dealt by ranges of the order, which may begin and end within one id; each range also gets the first
    document of the next, so that no text is gathered elsewhere. A task streams through its ranges and holds two texts.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), None) if row is None else docs.select(row.alias("row"), F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).alias("doc"))
    doc_id = F.col("doc.doc_id").cast("long")
    key = F.struct(doc_id.isNull().alias("absent"), F.bitwise_not(F.coalesce(doc_id, F.lit(0))).alias("down"), F.col("row").alias("row"))
    rows = rows.select(key.alias("key"), doc_id.alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)
    ranged = _in_ranges(rows, RANGES * tasks)
    firsts = stored(ranged.groupBy("range").agg(F.min("key").alias("key")), "firsts")
    order = Window.orderBy("range")  # a row for each range
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ahead = rows.join(F.broadcast(firsts.select("key", before.alias("range"))), "key")
    both = ranged.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True)))
    dealt = both.repartition(tasks, "range").sortWithinPartitions("range", "ahead", "key").select("ahead", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], None
        for batch in batches:
            for is_ahead, doc, text in zip(*batch.columns, strict=True):
                now = Parsed.of(text.as_py())
                if held is not None:
                    i, this = held
                    edited, least = this.edited(now)
                    out.append((i, len(this.text), hashlib.sha256(edited.encode()).hexdigest(), written(this.least), written(least), likeness(this.least, least), likeness(this.least, now.least)))
                held = None if is_ahead.as_py() else (doc.as_py(), now)
                if len(out) >= _OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one id are in the order of the files and of their rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare_with_next(docs, row=F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
