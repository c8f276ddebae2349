"""Weights learned on features of a query's candidates, each query judged by weights that have not seen it.

Ridge regression leaves out each query by itself: sums of products over a query are taken off those over all. Pairwise logistic
regression leaves out folds of whole queries and takes Newton's steps; a pass over the pairs gives every fold's gradient and
second derivatives. Tasks send sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.bindings import evaluation, evaluation_by_query
from partloom.registry import query
from partloom.sources.files import written

#: Features of a candidate, as SQL.
FEATURES = ("score_a / 100000", "score_b / 50", "line_no / 7.0", "supp % 10 / 10.0", "score_a / 100000 * score_b / 50", "power(score_a / 100000, 2)", "power(score_b / 50, 2)", "case when category = 'R' then 1.0 else 0.0 end", "line_no % 2", "1.0 / (1 + line_no)")
RIDGE, L2, FOLDS, STEPS, STILL = 1.0, 0.01, 10, 25, 1e-12


def features(rows: DataFrame, of: tuple[str, ...] = FEATURES) -> DataFrame:
    """qid, cand_key, y and x."""
    return rows.select("qid", "cand_key", F.col("label").cast("double").alias("y"), F.array(*[F.expr(f).cast("double") for f in of]).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def ridge_left_out(rows: DataFrame, width: int, penalty: float = RIDGE) -> DataFrame:
    """qid and w (the intercept last, not penalised) of each query: from all rows (qid, y, x) but its own. The sums of a query,
    (width + 1) x (width + 2), are one row; the driver sees those of all queries together. Rows that are dealt by qid are summed
    where they are; the sums over all queries come from the rows, so no query's sums are sent for them."""
    one = F.concat("x", F.array(F.lit(1.0)))
    long = rows.select("qid", "y", one.alias("x"))
    upper = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    xx = F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in upper])
    xy = F.array(*[F.sum(F.col("x")[i] * F.col("y")) for i in range(width + 1)])
    sums = long.groupBy("qid").agg(xx.alias("xx"), xy.alias("xy"))
    total = long.agg(xx.alias("xx"), xy.alias("xy")).first()
    every = np.array([x or 0.0 for x in (*total.xx, *total.xy)])
    sent = rows.sparkSession.sparkContext.broadcast(every)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.array(upper).T
        keep = np.diag([penalty] * width + [0.0])
        for batch in batches:
            left = sent.value - np.hstack((_matrix(batch.column(1), len(upper)), _matrix(batch.column(2), width + 1)))
            a = np.zeros((len(left), width + 1, width + 1))
            a[:, i, j] = a[:, j, i] = left[:, : len(upper)]
            # least squares, as nothing may be left
            w = [np.linalg.lstsq(m + keep, y, rcond=None)[0].tolist() for m, y in zip(a, left[:, len(upper) :], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.list_(pa.float64()))], ["qid", "w"])

    return sums.mapInArrow(solve, "qid long, w array<double>")


def fold_of(qid: Column, folds: int) -> Column:
    return F.pmod(F.crc32(qid.cast("string").cast("binary")), F.lit(folds)).cast("int")


def pairs_of(rows: DataFrame, folds: int, width: int) -> DataFrame:
    """fold and d, the differences of features of each pair of a query's candidates, the better one first."""
    other = rows.select("qid", F.col("y").alias("o_y"), F.col("x").alias("o_x"))
    better = rows.join(other, "qid").where("y > o_y")
    return better.select(fold_of(F.col("qid"), folds).alias("fold"), F.array(*[F.get("x", F.lit(i)) - F.get("o_x", F.lit(i)) for i in range(width)]).alias("d"))


def _slopes(pairs: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fold, over the pairs of all others: their number, the gradient and the second derivatives of the loss."""
    folds, width = w.shape
    sent = pairs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, (i, j) = sent.value, np.triu_indices(width)
        n, gradient, upper = np.zeros((folds, 1)), np.zeros((folds, width)), np.zeros((folds, len(i)))
        for batch in batches:
            fold, d = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            seen = fold[:, None] != np.arange(folds)
            miss = 1 / (1 + np.exp(np.clip(d @ w.T, -500, 500))) * seen
            n += seen.sum(axis=0)[:, None]
            gradient -= miss.T @ d
            # products of features are made once for all folds
            upper += (miss * (1 - miss)).T @ (d[:, i] * d[:, j])
        second = np.zeros((folds, width, width))
        second[:, i, j] = second[:, j, i] = upper
        out = np.hstack((n, gradient, second.reshape(folds, -1)))
        yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], ["fold", "s"])

    parts = pairs.select("fold", "d").mapInArrow(run, "fold int, s array<double>")
    rows = parts.groupBy("fold").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(1 + width + width * width)]).alias("s")).collect()  # a row for each fold
    s = np.zeros((folds, 1 + width + width * width))
    for r in rows:
        s[r.fold] = r.s
    return s[:, 0], s[:, 1 : 1 + width], s[:, 1 + width :].reshape(folds, width, width)


def pairwise_left_out(rows: DataFrame, width: int, folds: int = FOLDS, l2: float = L2) -> np.ndarray:
    """Weights of each fold from the pairs of all others (all-zero weights where there are none): the minimum of the mean
    logistic loss plus l2 / 2 of the squared weights, to ``STILL``."""
    pairs, w = written(pairs_of(rows, folds, width), "pairs"), np.zeros((folds, width))
    for _ in range(STEPS):
        n, gradient, second = _slopes(pairs, w)
        n = np.maximum(n, 1)
        steps = np.array([np.linalg.solve(second[k] / n[k] + l2 * np.eye(width), gradient[k] / n[k] + l2 * w[k]) for k in range(folds)])
        w = w - steps
        if np.abs(steps).max() < STILL:
            break
    return w


def scored(width: int, weights: Column) -> Column:
    """The inner product of x, and an intercept if there is a weight for one."""
    ones = [*[F.get("x", F.lit(i)) for i in range(width)], F.lit(1.0)]
    return F.round(sum((x * F.coalesce(F.get(weights, F.lit(i)), F.lit(0.0)) for i, x in enumerate(ones)), F.lit(0.0)), 6)


@query("l12_ridge_left_out")
def l12_all(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's score by weights from all other queries, over ten features."""
    rows = features(evaluation_by_query(spark, d))
    return rows.join(ridge_left_out(rows, len(FEATURES)), "qid").select("qid", "cand_key", scored(len(FEATURES), F.col("w")).alias("score"))


@query("l13_pairwise_left_out")
def l13_folds(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's score by weights from the pairs of all other folds of queries, over ten features."""
    rows = features(evaluation(spark, d))
    w = pairwise_left_out(features(evaluation_by_query(spark, d)), len(FEATURES))
    weights = spark.createDataFrame([(k, x) for k, x in enumerate(w.tolist())], "fold int, w array<double>")
    judged = rows.withColumn("fold", fold_of(F.col("qid"), FOLDS)).join(F.broadcast(weights), "fold")
    return judged.select("qid", "cand_key", scored(len(FEATURES), F.col("w")).alias("score"))
