"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item's windows are its runs of ``window`` words (an item of fewer words is one window). A window's tokens are its word
shingles; as a document has to hold all of them, one necessary prefix token is enough to find every candidate, and
the rarest shingle of the corpus is taken for it. The steps:

1. One pass over the documents keeps, for each, the stretches of words that are made of shingles of the benchmark.
2. Shingles of all stretches are counted; each window gets its rarest one, windows with a shingle that no document has go.
3. Prefix tokens of windows meet shingles of stretches in an equality join, with bounds on position and length: the
   window has to begin and end inside the stretch.
4. The words of the stretch at that place have to equal the window's words.

The shingles of a block of items are sent to the tasks; ``BLOCK_SHINGLES`` bounds a block, and a larger benchmark is
taken in several blocks of whole items, with one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.shared import bounded, field, kind_of, numbered, stored, without

#: Bytes of words stay, A-Z become a-z, all others become blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHINGLE = 5
BLOCK_SHINGLES = 500_000
_FACTOR = 0x9E3779B97F4A7C15


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def _shingle_keys(ids: np.ndarray, k: int) -> np.ndarray:
    """One number for each run of k word numbers; 0 where a word is unknown."""
    if len(ids) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(ids) - k + 1
    key, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for j in range(k):
        part = ids[j : j + n]
        key = key * np.uint64(_FACTOR) + part
        known &= part != 0
    key ^= key >> np.uint64(29)
    return np.where(known, key | np.uint64(1), np.uint64(0))


def _word_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def item_windows(items: DataFrame, *, id_col: str, text_col: str, window: int) -> DataFrame:
    """item_id and words (array<binary>) of an item's every distinct window; null ids and items without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words_of(text.as_py())
                runs = {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
                out += [{"item_id": item, "words": list(r)} for r in sorted(runs)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item_id", pa.string()), ("words", pa.list_(pa.binary()))]))

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id string, words array<binary>")


def _window_tokens(windows: DataFrame) -> DataFrame:
    """windows (window, words) with a row for each of their shingles: k, offset and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(list(map(_word_id, ws)), dtype=np.uint64) for ws in batch.column(1).to_pylist()]
            keys = [_shingle_keys(x, min(SHINGLE, len(x))).view(np.int64).tolist() for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["window", "words", "keys"])

    tokens = windows.select("window", "words").mapInArrow(run, "window long, words array<binary>, keys array<long>")
    return tokens.select("window", "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("k"), F.posexplode("keys").alias("offset", "key"))


def stretches(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) to row, doc_id, n_words, and found: each stretch's k, begin, words and shingle keys.

    The words and shingle keys of tokens go to the tasks; the caller bounds them by BLOCK_SHINGLES.
    """
    known = {w: _word_id(w) for w in tokens.select(F.explode("words").alias("w")).distinct().toArrow().column(0).to_pylist()}
    wanted = tokens.select("k", "key").distinct().toArrow()
    k_of, keys_of = wanted.column(0).to_numpy(), wanted.column(1).to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast((known, {int(k): np.sort(keys_of[k_of == k]) for k in np.unique(k_of)}))
    found = pa.list_(pa.struct([("k", pa.int32()), ("begin", pa.int32()), ("words", pa.list_(pa.binary())), ("keys", pa.list_(pa.int64()))]))

    def of(words: list[bytes]) -> list[dict]:
        known, keys = sent.value
        get, out = known.get, []
        ids = np.array([get(w, 0) for w in words], dtype=np.uint64)
        for k, wanted in keys.items():
            at = _shingle_keys(ids, k)
            hits = np.flatnonzero(at)
            hits = hits[wanted[np.minimum(np.searchsorted(wanted, at[hits]), len(wanted) - 1)] == at[hits]]
            if len(hits):
                for part in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
                    b, e = int(part[0]), int(part[-1]) + 1
                    out.append({"k": k, "begin": b, "words": words[b : e + k - 1], "keys": at[b:e].view(np.int64).tolist()})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hits = [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                n.append(len(words))
                hits.append(of(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hits, found)], ["row", "doc_id", "n_words", "found"])

    made = docs.mapInArrow(run, f"row {kind_of(docs, 'row')}, doc_id long, n_words long, found array<struct<k int, begin int, words array<binary>, keys array<long>>>")
    return stored(made, "stretches")


def find_windows(found: DataFrame, tokens: DataFrame, window: int) -> DataFrame:
    """row, begin, length and window of every occurrence of a window in the stretches."""
    shingles = found.select("row", F.explode("found").alias("s")).select("row", "s.k", "s.begin", "s.words", F.posexplode("s.keys").alias("at", "key"))
    counts = shingles.groupBy("key").agg(F.count("*").alias("n_key"))
    rarest = F.min(F.struct(F.coalesce("n_key", F.lit(0)).alias("n_key"), "offset", "key")).alias("rarest")
    prefix = tokens.join(counts, "key", "left").groupBy("window").agg(rarest, F.first("words").alias("window_words")).where("rarest.n_key > 0")
    prefix = prefix.select("window", "window_words", F.size("window_words").alias("length"), "rarest.offset", "rarest.key")
    # only the words that a window over this shingle can reach travel with it
    low = F.greatest(F.col("at") - (window - F.col("k")), F.lit(0))
    near = shingles.select("row", "begin", "at", "key", low.alias("low"), F.size("words").alias("n"), F.slice("words", low + 1, F.lit(2 * window)).alias("context"))
    near = near.join(bounded(stored(prefix, "prefix")), "key").withColumn("from", F.col("at") - F.col("offset"))
    inside = (F.col("from") >= 0) & (F.col("from") + F.col("length") <= F.col("n"))
    same = F.slice("context", F.greatest(F.col("from") - F.col("low"), F.lit(0)) + 1, F.col("length")) == F.col("window_words")
    return near.where(inside & same).select("row", (F.col("begin") + F.col("from")).alias("begin"), "length", "window").distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, row_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two tables: of every document row, row, doc_id, n_words, n_hit and items (sorted as strings), and of every
    occurrence row, begin, length and window.

    Null and empty texts have no words and no hits. Items without words or with a null id take no part; several items of
    one text are all named. Rows with the same or a null doc_id are judged each by its own text. Without items all counts
    are 0, without documents no rows come. Extra columns are ignored. row_col: a column of docs that tells its rows apart.
    """
    pairs = stored(item_windows(items, id_col=item_col, text_col=item_text_col, window=window), "windows")
    windows = stored(pairs.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "window-ids")
    owners = stored(pairs.join(windows, "words").select("window", "item_id").distinct(), "owners")
    tokens = stored(_window_tokens(windows), "tokens")
    n_blocks = max(1, -(-tokens.count() // BLOCK_SHINGLES))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if n_blocks > 1 and not row_col:
        docs = stored(docs, "rows")  # several passes need the same row numbers
    blocks = []
    for block in range(n_blocks):
        own = tokens.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == block)
        found = stretches(docs, own)
        blocks.append((found, find_windows(found, own, window)))
    marks = stored(reduce(DataFrame.union, [hits for _, hits in blocks]), "hits")
    before = Window.partitionBy("row").orderBy("begin", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("begin") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("begin"), F.coalesce(F.max(end).over(before), F.lit(0))))
    n_hit = marks.select("row", "begin", "length").distinct().withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = marks.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = blocks[0][0].select("row", "doc_id", "n_words").join(n_hit, "row", "left").join(named, "row", "left")
    return rows.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")), marks


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """docs without the rows that hold a window of an item. row: see ``numbered``."""
    rows = numbered(docs, row)
    judged, _ = decontaminate(rows.select("row", field(id_col).alias("doc_id"), field(text_col).alias("text")), items, row_col="row")
    return without(rows, judged.where("n_hit > 0")).select("doc.*")


def _digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
