"""Exact top-k search by pivot-table elimination.

Every vector keeps its distances to a table of pivots, computed once. By the triangle inequality each pivot gives a lower
bound of the distance between a query and a candidate; the greatest of them gives an upper bound of their inner product,
(|q|^2 + |x|^2 - bound^2) / 2. A task takes its candidates in the order of that bound and evaluates the exact integer
products until the bound falls below the k-th best product that it has found so far, in this batch or in one before, so
nothing that could count is left out.

Pivots are chosen from at most ``PIVOT_SAMPLE`` rows, each as far as possible from those before it; the choice has no
bearing on the results. Queries are taken in blocks of about ``QUERY_BLOCK``: a block goes to the tasks, meets all rows and
is written before the next one begins, so the driver never holds more than a block, and no plan grows with the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.shared import new_path, stored

PIVOTS, PIVOT_SAMPLE, QUERY_BLOCK, EVALUATED_AT_ONCE = 24, 2048, 512, 256
_LONG = 1 << 63


def integer_vectors(rows: DataFrame, *, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """row, vec_id and v, the components as floor(scale * x): doubles that hold whole numbers. Rows with a null id or vector go,
    and vectors with components that are null or non-finite, before scaling or after."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    # from 2^53 on a double is whole, and Spark's floor would end at the largest long
    return whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("x", lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for i, (begin, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes, strict=True)):
        out[i, :n] = flat[begin : begin + n]
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: 64-bit where they fit, else Python's integers."""
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, len(q))
    if most < 1 << 53:
        return (x @ q).astype(np.int64)
    if most < 1 << 62 and max(np.abs(q).max(), np.abs(x).max()) < 1 << 62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(c) for c in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x] + [0], dtype=object)[:-1]


def _order(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if score.dtype != object:
        return np.lexsort((ids, -score))[:k]
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], dtype=np.intp)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.maximum(0.0, ((x[:, None, :] - pivots[None, :, :]) ** 2).sum(2))) if len(pivots) else np.zeros((len(x), 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors too large to be squared are no pivots."""
    with np.errstate(over="ignore"):
        sample = sample[np.isfinite((sample**2).sum(1))]
        if not len(sample):
            return sample
        chosen, away = [int(np.argmax((sample**2).sum(1)))], np.full(len(sample), np.inf)
        while len(chosen) < min(n, len(sample)):
            away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
            if away.max() == 0:
                break
            chosen.append(int(np.argmax(away)))
    return sample[chosen]


def pivot_table(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """vectors with away: the distances to the pivots."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                away = _distances(_matrix(part.column(2), width), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(away), pa.list_(pa.float64()))], ["row", "vec_id", "v", "away"])

    return vectors.mapInArrow(run, "row long, vec_id long, v array<double>, away array<double>")


Best = tuple[np.ndarray, np.ndarray]


def best_of(q: np.ndarray, q_away: np.ndarray, own: int, x: np.ndarray, away: np.ndarray, norms: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, so_far: Best) -> Best:
    """vec_id and score of the k best candidates of one query, by score and then id, given the best of those before."""
    with np.errstate(over="ignore", invalid="ignore"):
        least = np.abs(away - q_away).max(1) if away.shape[1] else np.zeros(len(x))
        scale = float(q @ q) + norms
        most = (scale - least**2) / 2 + 1 + 1e-9 * scale  # what rounding may have taken
    most[~np.isfinite(most)] = np.inf  # beyond doubles nothing is known
    got_ids, got = so_far
    take = np.flatnonzero((rows != own) & (most >= float(got[k - 1]) * (1 - 1e-12 if got[k - 1] > 0 else 1 + 1e-12)) if len(got) >= k and abs(got[k - 1]) < _LONG else rows != own)
    order = take[np.argsort(-most[take], kind="stable")]
    for i in range(0, len(order), EVALUATED_AT_ONCE):
        if len(got) >= k and most[order[i]] < got[k - 1]:
            break
        part = order[i : i + EVALUATED_AT_ONCE]
        got_ids, got = np.concatenate((got_ids, ids[part])), np.concatenate((got, products(x[part], q)))
        best = _order(got, got_ids, k)
        got_ids, got = got_ids[best], got[best]
    return got_ids, got


def _beyond(score: int) -> tuple[int, bytes]:
    """How a score that is no long compares with those that are, and a key that orders such scores."""
    if -_LONG <= score < _LONG:
        return 0, b""
    size = abs(score).to_bytes(300, "big")
    return (1, size) if score > 0 else (-1, bytes(255 - b for b in size))


_FOUND = {"query_row": ("long", pa.int64()), "query_id": ("long", pa.int64()), "vec_id": ("long", pa.int64()), "score": ("long", pa.int64()), "over": ("int", pa.int32()), "key": ("binary", pa.binary())}


def _against(table: DataFrame, asked: pa.Table, width: int, k: int) -> DataFrame:
    """The k best of each task for the queries of a block."""
    sent = table.sparkSession.sparkContext.broadcast(asked.combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        q_rows, q_ids = asked["row"].to_numpy(), asked["vec_id"].to_numpy()
        q, q_away = _matrix(asked["v"].chunk(0), width), np.array(asked["away"].to_pylist(), dtype=float).reshape(asked.num_rows, -1)
        best: list[Best] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(q)
        for batch in batches:
            x = _matrix(batch.column(2), width)
            away = np.array(batch.column(3).to_pylist(), dtype=float).reshape(len(x), -1)
            with np.errstate(over="ignore"):
                norms = (x**2).sum(1)
            ids, own = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for i in range(len(q)):
                best[i] = best_of(q[i], q_away[i], q_rows[i], x, away, norms, ids, own, k, best[i])
        out: dict[str, list] = {c: [] for c in _FOUND}
        for row, i, (ids, scores) in zip(q_rows, q_ids, best, strict=True):
            for j, score in zip(ids, scores, strict=True):
                over, key = _beyond(int(score))
                for c, v in zip(out, (row, i, j, None if over else int(score), over, key), strict=True):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, _FOUND[c][1]) for c, v in out.items()], list(out))

    return table.mapInArrow(run, ", ".join(f"{c} {t}" for c, (t, _) in _FOUND.items()))


def top_k(rows: DataFrame, is_query, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows.

    is_query is a condition on vec_id. Repeated ids are rows of their own, and a query is only kept from its own row.
    Vectors of fewer components end in zeros. Products of any size are compared exactly; a score beyond a long is null, and
    its rank is right. Without queries or candidates no rows come; extra columns are ignored.
    """
    spark = rows.sparkSession
    vectors = stored(integer_vectors(rows, id_col=id_col, vector_col=vector_col, scale=scale), "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "row").limit(PIVOT_SAMPLE).select("v").toArrow().column(0).combine_chunks()
    table = stored(pivot_table(vectors, choose_pivots(_matrix(sample, width), pivots), width), "pivot-table")
    queries = table.where(is_query)
    blocks = -(-queries.count() // QUERY_BLOCK)
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))), "queries")  # blocks of about that size
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("over"), F.desc("key"), F.desc("score"), "vec_id"))
    path = new_path(spark, "found")
    kind = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], kind).write.parquet(path)
    for block in range(blocks):
        asked = queries.where(F.col("block") == block).select("row", "vec_id", "v", "away").toArrow()
        if asked.num_rows:
            found = _against(table, asked, width, k).withColumn("rank", rank).where(F.col("rank") <= k)
            found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) score
      from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""
