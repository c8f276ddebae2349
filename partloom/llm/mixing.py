"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by md5 of the id, so reruns agree), passed through up to
``epochs`` times. A document's virtual finish time is the words of its source up to its end divided by the source's target;
all documents are sorted by it over ranges, and the order is cut where the total budget is reached. Virtual time ends at 1,
when every source has its target; what is being served then, one document of each source, is cut there.

Running sums never take a whole source into one task: a source's documents are split by leading digits of the shuffle
key, sums of these parts give each part its offset, and only documents of one part are summed in order. The order of all
documents is summed in the same way, range by range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.llm.shared import bounded, field, numbered, stored, white_space_words

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
PART_ROWS = 4_000


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_rank, source_size, target: the budget is dealt by weight, up to epochs times a source's size, and what
    is over is dealt again. One row for each source.

    In closed form: with sources in order of size by weight, the first j are full and the others share the rest at one
    rate; j is the smallest number at which no other source is over.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = sizes.withColumn("source_rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_rank", F.lit(len(weights))) + 1))
    sizes = sizes.withColumn("most", F.col("source_size") * epochs)
    fullest = Window.orderBy(F.col("most") / F.col("weight"), "source_rank")
    every = Window.partitionBy()
    full = F.coalesce(F.sum("most").over(fullest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(fullest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(every) * F.lit(share)
    sizes = sizes.withColumn("rate", (budget - full) / open_)
    fits = F.col("rate") <= F.col("most") / F.col("weight")
    level = F.min_by(F.when(fits, F.col("rate")), F.when(fits, F.col("most") / F.col("weight"))).over(every)
    return sizes.select("source", "source_rank", "source_size", F.least(F.coalesce(level * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double")).alias("target"))


def shuffle_key(doc_id: Column, row: Column) -> Column:
    """Documents without an id are told apart by their rows."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("row "), row.cast("string")))))


def queued(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with source_rank, target, source_size and before: words of the source that come before the document."""
    n = rows.count()
    digits = max(0, math.ceil(math.log(max(1, n / PART_ROWS), 16)))
    keyed = rows.join(bounded(targets), rows.source.eqNullSafe(targets.source)).select("row", "doc_id", "size", "source_rank", "source_size", "target", shuffle_key(F.col("doc_id"), F.col("row")).alias("key"))
    keyed = keyed.withColumn("part", F.substring("key", 1, digits))
    sums = keyed.groupBy("source_rank", "part").agg(F.sum("size").alias("part_size"))
    sums = sums.select("source_rank", "part", F.coalesce(F.sum("part_size").over(Window.partitionBy("source_rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = Window.partitionBy("source_rank", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return inside.join(sums, ["source_rank", "part"]).select("row", "doc_id", "size", "source_rank", "source_size", "target", (F.col("offset") + F.col("inside")).alias("before"))


def serve(queue: DataFrame, budget: int, epochs: int = EPOCHS) -> DataFrame:
    """The mix, in order: at (words of the mix before it), row, epoch and words."""
    passes = queue.where("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    begins = F.col("epoch") * F.col("source_size") + F.col("before")
    words = F.least(F.col("size"), F.ceil(F.col("target") - begins)).cast("long")
    order = ["finish", "source_rank", "doc_id", "size", "row", "epoch"]
    passes = passes.select(((begins + F.col("size")) / F.col("target")).alias("finish"), "source_rank", "doc_id", "size", "row", "epoch", words.alias("words")).where("words > 0")
    dealt = stored(passes.repartitionByRange("finish", "source_rank").sortWithinPartitions(*order).withColumn("span", F.spark_partition_id()), "order")
    spans = dealt.groupBy("span").agg(F.sum("words").alias("n"))
    spans = spans.select("span", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # one row for each range
    own = Window.partitionBy("span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("words").over(own), F.lit(0))).join(spans, "span").withColumn("at", F.col("offset") + F.col("inside"))
    return placed.where(F.col("at") < budget).select("at", "row", "epoch", F.least("words", F.lit(budget) - F.col("at")).alias("words"))


def mix_rows(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """rows (row, doc_id, source, size) to their queue and what the mix serves of it."""
    targets = stored(source_targets(rows, weights, share, epochs), "targets")
    queue = stored(queued(rows, targets), "queue")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return queue, serve(queue, math.floor(total * share), epochs)


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, row: Column | None = None) -> DataFrame:
    """The documents of the mix, all columns of docs: one row for each time that a document is taken. row: see ``numbered``.

    A document that the budget cuts keeps its first words, with the white space between them. Null and empty texts have
    size 0 and are never taken. A null source is a source of its own, last in order. Rows with equal ids are documents of
    their own. An empty table gives no rows.
    """
    docs = numbered(docs, row)
    rows = stored(docs.select("row", field(id_col).cast("long").alias("doc_id"), field(source_col).alias("source"), white_space_words(field(text_col)).alias("size")), "sizes")
    queue, served = mix_rows(rows, weights, share, epochs)
    taken = stored(served.join(queue.select("row", "size"), "row").select("row", F.col("words").alias("taken"), "size"), "taken")
    parts = F.split(F.regexp_replace(field(text_col), r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(parts, 1, F.col("taken").cast("int")), "")
    text = F.when(F.col("taken") < F.col("size"), cut).otherwise(field(text_col))
    return docs.join(taken, "row").select(F.col("doc").withField(text_col, text).alias("doc")).select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of size 0 have target 0; ties in the shuffle key go by doc_id and size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", white_space_words(F.col("text")).alias("size")), "sizes")
    queue, served = mix_rows(rows)
    taken = served.groupBy("row").agg(F.sum("words").alias("taken"))
    return queue.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
