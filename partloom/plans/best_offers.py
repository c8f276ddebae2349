"""A request's best offers by a bounded top-k join.

Offers of one class with the same attributes are a block. What an offer can be worth at most in a block follows from the
block's largest stock and smallest price, as an order key of the same kind that offers have. A request first meets blocks
alone. The offers of its k best blocks give the k-th best key; only blocks whose bound is not behind it are opened then. So
offers are read in proportion to requests and k, and every offer that could be among the best is judged exactly.

Offers that a request names stand before all others whatever their worth; they are found by an equality join of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.bindings import MARGIN, alike, for_each_request, offers, requests
from partloom.operators.assessment import ORDER_SQL, assessed, assessed_sql
from partloom.operators.checks import conflicts
from partloom.operators.matching import KEY, candidate_join
from partloom.registry import query
from partloom.sources.files import written

CLASS = ["family", "manufacturer"]
#: What the states of all constraints but the price follow from.
ATTRIBUTES = ["size_v", "rating_v", "colour", "kind", "moq"]
#: Bands of stock and price that part a block, so that bounds stay close however many offers have the same attributes.
STOCK_BANDS, PRICE_BANDS = 1, 1
#: An id whose offer is in production, in the basic library and named by nobody.
_BEST_ID = -12


def blocks_of(offered: DataFrame) -> DataFrame:
    """offers in stock with the number of their block."""
    bands = [F.floor(F.log2("stock") * STOCK_BANDS), F.floor(F.log2(F.greatest("unit_price", F.lit(1e-9))) * PRICE_BANDS)]
    return offered.where("stock > 0").withColumn("block", F.xxhash64(*CLASS, *ATTRIBUTES, *bands))


def order_key() -> Column:
    """The total order of assessed rows as one ascending column."""
    return F.struct("tier", "distance", (-F.col("final")).alias("f"), (-F.col("score")).alias("s"), (-F.col("stock")).alias("n"), F.coalesce("unit_price", F.lit(float("inf"))).alias("p"), *KEY)


def with_bounds(asked: DataFrame, blocks: DataFrame, margin: float) -> DataFrame:
    """asked with the blocks of its class and size: out, whether a constraint but the price is in conflict, n, and bound."""
    heads = blocks.groupBy(*CLASS, *ATTRIBUTES, "block").agg(F.max("stock").alias("stock"), F.min("unit_price").alias("unit_price"), F.count("*").alias("n"))
    heads = heads.select("*", F.lit("").alias("source"), F.lit("").alias("part_number"), F.lit(_BEST_ID).cast("long").alias("sk"))
    met = assessed(candidate_join(asked, heads.hint("rebalance"), margin))
    # rounding may have moved a score by half a unit in its sixth place
    bound = F.struct("tier", (F.col("distance") - 1e-6).alias("distance"), (-F.col("final") - 1e-6).alias("f"), (-F.col("score") - 1e-6).alias("s"), (-F.col("stock")).alias("n"), "unit_price", *KEY)
    return met.select(*asked.columns, "block", "n", (F.size(conflicts()) > 0).alias("out"), bound.alias("bound"))


def best_offers(asked: DataFrame, offered: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The max_results best offers of each request that no constraint but the price excludes, as assessed rows with nth, and
    left_out, the number of its candidates that are excluded. Requests without offers have no rows."""
    blocks = written(blocks_of(offered), "blocks")
    met = written(with_bounds(asked, blocks, margin), "bounds")
    left_out = met.groupBy("request_id").agg(F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("left_out"))
    open_ = met.where("not out").drop("n", "out")
    own = Window.partitionBy("request_id")
    first = open_.withColumn("nth_block", F.row_number().over(own.orderBy("bound", "block"))).where("nth_block <= max_results").drop("nth_block", "bound")
    of_block = blocks.drop("family", "manufacturer")

    def judged(pairs: DataFrame) -> DataFrame:
        return assessed(pairs.join(of_block, "block")).where(F.col("tier") >= 0)  # without named ones

    key = order_key()
    tried = judged(first).select("request_id", "max_results", key.alias("key"))
    kth = tried.withColumn("nth", F.row_number().over(own.orderBy("key"))).where("nth = max_results").select("request_id", F.col("key").alias("least"))
    passed = open_.join(kth, "request_id", "left").where(F.col("least").isNull() | (F.struct(*[F.col(f"bound.{c}") for c in ("tier", "distance", "f", "s", "n")]) <= F.struct(*[F.col(f"least.{c}") for c in ("tier", "distance", "f", "s", "n")])))
    rest = judged(passed.drop("bound", "least"))
    near = F.col("size_v").isNull() | F.col("size_v").between(F.col("want_size") - margin, F.col("want_size") + margin)
    by_name = blocks.withColumnRenamed("family", "of_family").withColumn("name", F.col("sk") % 50)
    named = asked.withColumn("name", F.col("request_id") % 50).join(by_name, F.expr("family = of_family and maker = manufacturer") & (asked.request_id % 50 == by_name.name) & near).drop("of_family", "name", "manufacturer")
    named = assessed(named)
    columns = [c for c in rest.columns if c in named.columns]
    every = rest.select(columns).unionByName(named.where(F.size(conflicts()) == 0).select(columns))
    best = every.withColumn("nth", F.row_number().over(own.orderBy(key))).where("nth <= max_results")
    return best.join(left_out, "request_id")


@query("f06_best_offers", assessed_sql(f"select request_id, source, part_number, nth from (select *, cast(row_number() over (partition by request_id order by {ORDER_SQL}) as int) nth from assessed where s_size <> 'conflict' and coalesce(s_rating, '') <> 'conflict' and coalesce(s_colour, '') <> 'conflict') where nth <= max_results"))
def f06_best(spark: SparkSession, d: str) -> DataFrame:
    heads, members = alike(requests(spark, d))
    return for_each_request(best_offers(heads, offers(spark, d)).select("request_id", *KEY, "nth"), members)
