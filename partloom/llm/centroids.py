"""Centroid clustering by scalar lookup tables.

Vectors are whole numbers after scaling, so in each dimension only some values occur. Each round tabulates, for every
dimension, every value that occurs in a block of vectors and every centroid, the squared difference; the distances of the
block are gathers from these tables and their sums. Blocks hold at most ``BLOCK`` vectors, so tables stay small however many
values a table has. Nothing is grouped by vector, so copies of one vector are no hot key: a task sends a sum for each
centroid, and sums meet in a grouped aggregation.

All numbers are exact: 64-bit where they fit, Python's integers where components are too large for that. Sums travel in
limbs of ``LIMB`` bits, one of them for ordinary components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.shared import stored

BLOCK, LIMB = 4096, 32
_LONG = (1 << 63) - 1
Centroids = list[list[int]]


def whole_vectors(rows: DataFrame, *, components: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, the components as floor(scale * x): doubles that hold whole numbers. Only vectors of so many components
    are kept, none of them null or non-finite, before scaling and after."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == components).where("forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    # from 2^53 on a double is whole, and Spark's floor would end at the largest long
    return kept.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _values(column: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur in a dimension, and where each row's is among them; a dense range of small ones needs no sort."""
    if small:
        low, high = int(column.min()), int(column.max())
        if high - low < BLOCK:
            return np.arange(low, high + 1), (column - low).astype(np.intp)
    values, code = np.unique(column, return_inverse=True)
    return (values.astype(np.int64) if small else np.array([int(x) for x in values], dtype=object)), code


def nearest(v: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number at ties, and its squared distance."""
    width = v.shape[1]
    room = math.isqrt((1 << 62) // max(1, width)) // 2  # with components below it no distance leaves 64 bits
    small = np.abs(v).max(initial=0) < room and max((abs(x) for c in centroids for x in c), default=0) < room
    at = np.array(centroids, dtype=np.int64 if small else object).reshape(len(centroids), width)
    total = np.zeros((len(v), len(centroids)), dtype=at.dtype)
    for d in range(width):
        values, code = _values(v[:, d], small)
        table = (values[:, None] - at[None, :, d]) ** 2
        total += table[code]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(v)), cluster]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, BLOCK) for batch in batches for i in range(0, batch.num_rows, BLOCK))


def _sums(vectors: DataFrame, centroids: Centroids, width: int) -> dict[int, tuple[int, list[int]]]:
    """How many vectors each non-empty cluster has, and their sums; at most a row for each centroid and limb gets here."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(sent.value), np.zeros((len(sent.value), width), dtype=object)
        for batch in _blocks(batches):
            v = _matrix(batch.column(0), width)
            cluster, _ = nearest(v, sent.value)
            whole = v.astype(np.int64) if np.abs(v).max(initial=0) < 1 << 50 else np.array([[int(x) for x in row] for row in v], dtype=object)
            for c in np.unique(cluster):
                own = whole[cluster == c]
                count[c] += len(own)
                total[c] += own.sum(axis=0).astype(object)
        out: dict[str, list] = {"cluster": [], "limb": [], "n": [], "part": []}
        for c in (c for c, n in enumerate(count) if n):
            left, limb = [int(x) for x in total[c]], 0
            while limb == 0 or any(left):
                part = [(abs(x) & ((1 << LIMB) - 1)) * (-1 if x < 0 else 1) for x in left]
                left = [(abs(x) >> LIMB) * (-1 if x < 0 else 1) for x in left]
                for k, x in zip(out, (c, limb, count[c] if limb == 0 else 0, part), strict=True):
                    out[k].append(x)
                limb += 1
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], list(out))

    parts = vectors.select("v").mapInArrow(run, "cluster int, limb int, n long, part array<long>")
    summed = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("part")[d]) for d in range(width)]).alias("part"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in summed.collect():
        n, so_far = found.get(r.cluster, (0, [0] * width))
        found[r.cluster] = n + r.n, [a + (b << LIMB * r.limb) for a, b in zip(so_far, r.part, strict=True)]
    return found


def first_centroids(vectors: DataFrame, n: int, seed: str) -> Centroids:
    """The n vectors with the smallest sha256 of seed and id, in that order; equal ids by their components, null ids last."""
    mark = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(n).collect()
    return [[int(x) for x in r.v] for r in rows]


def cluster(rows: DataFrame, *, n: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Centroids]:
    """vec_id, cluster and distance of every kept vector, and the centroids.

    Null vectors, vectors of another length and vectors with null or non-finite components take no part; a vector is kept if
    its id is null or repeated, each row for itself. With fewer vectors than centroids there are as many centroids as
    vectors; an empty table gives no rows and no centroids. Extra columns are ignored. A distance beyond a long is null.
    """
    vectors = stored(whole_vectors(rows, components=components, scale=scale, id_col=id_col, vector_col=vector_col), "whole-vectors")
    centroids = first_centroids(vectors, n, seed)
    for _ in range(rounds):
        for c, (count, total) in _sums(vectors, centroids, components).items():
            centroids[c] = [x // count for x in total]
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            own, away = nearest(_matrix(batch.column(1), components), sent.value)
            away = [x if x <= _LONG else None for x in away.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(away, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of distances that are beyond a long, or hold a distance that is, are null."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = stored(found, "assigned")
    inertia = lambda: F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    of_cluster = found.groupBy("cluster").agg(inertia().try_cast("long").alias("cluster_inertia"))  # a row for each centroid
    of_all = found.agg(inertia().try_cast("long").alias("inertia")).first()[0]
    return found.join(F.broadcast(of_cluster.join(named, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(of_all).cast("long").alias("inertia"), "centroid_sha256")


def _sql(rounds: int) -> str:
    """For components of ordinary size; equal ids are told apart by their components."""
    away = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        """w as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
           where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select row_number() over (order by vec_id, v) id, vec_id, v from w),
c0 as (select cast(row_number() over (order by sha256(concat('2:', cast(vec_id as varchar))), v) - 1 as integer) k, v
       from v qualify row_number() over (order by sha256(concat('2:', cast(vec_id as varchar))), v) <= 40)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select id, arg_min(k, d * 64 + k) k, min(d) d from (select v.id, c.k, cast({away} as hugeint) d from v, c{i} c) group by id)")
        if i < rounds:
            parts.append(
                f"""m{i} as (select k, list((s - ((s % n) + n) % n) // n order by j) v from (select k, j, cast(sum(x) as hugeint) s, count(*) n
                from (select a.k, unnest(v.v) x, generate_subscripts(v.v, 1) j from a{i} a join v using (id)) group by k, j) group by k),
c{i + 1} as (select c.k, coalesce(m.v, c.v) v from c{i} c left join m{i} m using (k))"""
            )
    return f"""with {', '.join(parts)}
select v.vec_id, a.k "cluster", cast(a.d as bigint) distance, cast(sum(a.d) over (partition by a.k) as bigint) cluster_inertia,
       cast(sum(a.d) over () as bigint) inertia, sha256(array_to_string(c.v, ',')) centroid_sha256
from a{rounds} a join v using (id) join c{rounds} c using (k)"""


OP12_SQL = _sql(5)
