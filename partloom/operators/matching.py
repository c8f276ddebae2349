"""Joins of requests, offers and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.bindings import alike, for_each_request, judged_candidates, named, offers, requests, with_views
from partloom.registry import query

KEY = ["source", "part_number"]


def _by_class(offered: DataFrame) -> DataFrame:
    return offered.withColumnRenamed("family", "of_family")


_SAME_CLASS = "family = of_family and maker = manufacturer"


def candidate_join(asked: DataFrame, offered: DataFrame, margin: float, live: Column | None = None) -> DataFrame:
    """An equality join on family and maker; the size is a condition of the join, so unstated sizes stay without a loop over
    pairs. live: which offers count as well as those in stock."""
    near = F.col("size_v").isNull() | F.col("size_v").between(F.col("want_size") - margin, F.col("want_size") + margin)
    return asked.join(_by_class(offered), F.expr(_SAME_CLASS) & near & (F.col("stock") > 0 if live is None else live)).drop("of_family")


def candidate_split_join(asked: DataFrame, offered: DataFrame, sizes: list[float]) -> DataFrame:
    """The same candidates by two equality joins: stated sizes on class and size, unstated ones on the class alone. For whole
    sizes, each request looks for the values within its margin."""
    stock = _by_class(offered.where("stock > 0"))
    wanted = asked.withColumn("size_key", F.explode(F.array(*[F.col("want_size") + s for s in sizes])))
    stated = wanted.join(stock.where("size_v is not null"), F.expr(f"{_SAME_CLASS} and size_key = size_v")).drop("size_key", "of_family")
    unstated = asked.join(stock.where("size_v is null"), F.expr(_SAME_CLASS)).drop("of_family")
    return stated.unionByName(unstated)


def old_state(offered: DataFrame) -> DataFrame:
    """What a table of offers held before: every second part."""
    return offered.where("pk % 2 = 0")


def normal_identifier(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


@query("d01_candidates", with_views("select request_id, source, part_number from candidates", "requests", "offers", "candidates"))
def d01(spark: SparkSession, d: str) -> DataFrame:
    return judged_candidates(spark, d, lambda found: found.select("request_id", *KEY))


@query("d01_candidates_split", with_views("select request_id, source, part_number from candidates", "requests", "offers", "candidates"))
def d01_split(spark: SparkSession, d: str) -> DataFrame:
    heads, members = alike(requests(spark, d))
    return for_each_request(candidate_split_join(heads, offers(spark, d), [-2.0, -1.0, 0.0, 1.0, 2.0]).select("request_id", *KEY), members)


_COVERAGE = """
select n.source, count(*) cached, count(o.part_number) indexed, count(case when o.extractor_version >= 2 then 1 end) current_rows
from offers n left join (select * from offers where pk % 2 = 0) o on n.source = o.source and n.part_number = o.part_number group by n.source
"""


def coverage(now: DataFrame, indexed: DataFrame, version: int) -> DataFrame:
    """cached, indexed and current rows of each source."""
    marks = indexed.select(*KEY, F.lit(True).alias("is_indexed"), (F.col("extractor_version") >= version).alias("is_current"))
    return now.join(marks, KEY, "left").groupBy("source").agg(F.count("*").alias("cached"), F.count_if("is_indexed").alias("indexed"), F.count_if("is_current").alias("current_rows"))


@query("d02_coverage", with_views(_COVERAGE, "offers"))
def d02(spark: SparkSession, d: str) -> DataFrame:
    now = offers(spark, d)
    return coverage(now, old_state(now), 2)


@query("d03_stale_rows", with_views("""
select n.source, n.part_number from offers n left join (select source, part_number, extractor_version v, stock - pk % 3 stock from offers where pk % 2 = 0) o
on n.source = o.source and n.part_number = o.part_number where o.part_number is null or o.v < 2 or o.stock is distinct from n.stock""", "offers"))
def d03(spark: SparkSession, d: str) -> DataFrame:
    now = offers(spark, d)
    was = old_state(now).select(*KEY, F.col("extractor_version").alias("v"), (F.col("stock") - F.col("pk") % 3).alias("old_stock"), F.lit(True).alias("found"))
    return now.join(was, KEY, "left").where("found is null or v < 2 or not (old_stock <=> stock)").select(*KEY)


@query("d04_update_from_equal_hash", with_views("""
select n.source, n.part_number, coalesce(o.fetched_at, n.fetched_at) fetched_at from offers n
left join (select source, part_number, md5(description) h, fetched_at from offers where pk % 2 = 0) o on n.source = o.source and n.part_number = o.part_number and o.h = md5(n.description)""", "offers"))
def d04(spark: SparkSession, d: str) -> DataFrame:
    now = offers(spark, d).withColumn("h", F.md5("description"))
    was = old_state(now).select(*KEY, "h", F.col("fetched_at").alias("old"))
    return now.join(was, [*KEY, "h"], "left").select(*KEY, F.coalesce("old", "fetched_at").alias("fetched_at"))


@query("d05_has_index_row", with_views("select source, part_number from offers n where exists (select 1 from offers o where o.pk % 2 = 0 and o.source = n.source and o.part_number = n.part_number)", "offers"))
def d05(spark: SparkSession, d: str) -> DataFrame:
    now = offers(spark, d)
    return now.join(old_state(now).select(*KEY), KEY, "left_semi").select(*KEY)


@query("d06_dropped", with_views("select source, part_number from offers n where not exists (select 1 from offers o where o.pk % 2 = 0 and o.source = n.source and o.part_number = n.part_number)", "offers"))
def d06(spark: SparkSession, d: str) -> DataFrame:
    now = offers(spark, d)
    return now.join(old_state(now).select(*KEY), KEY, "left_anti").select(*KEY)


@query("d07_hits_in_order", with_views("""
select h.request_id, h.nth, o.part_number, o.mpn, o.description from
(select request_id, part_number, source, cast(row_number() over (partition by request_id order by unit_price, source, part_number) as int) nth from candidates) h
join offers o on o.source = h.source and o.part_number = h.part_number where h.nth <= 3""", "requests", "offers", "candidates"))
def d07(spark: SparkSession, d: str) -> DataFrame:
    """Keys are ranked first; only the rows that stay are widened."""
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("unit_price", *KEY))

    def widened(found: DataFrame) -> DataFrame:
        hits = found.select("request_id", *KEY, "unit_price", nth.alias("nth")).where("nth <= 3").drop("unit_price")
        return hits.join(offers(spark, d).select(*KEY, "mpn", "description"), KEY).select("request_id", "nth", "part_number", "mpn", "description")

    return judged_candidates(spark, d, widened)


def prefix_join(asked: DataFrame, offered: DataFrame, shortest: int) -> DataFrame:
    """asked (id columns, prefix) with offered (id columns, mpn, part_number), where the prefix begins either identifier.

    Identifiers are cut to the lengths that prefixes have, so that an equality join decides everything; prefixes shorter
    than shortest ask for nothing.
    """
    keyed = asked.select("*", normal_identifier(F.col("prefix")).alias("start")).where(F.length("start") >= shortest)
    lengths = keyed.agg(F.sort_array(F.collect_set(F.length("start"))).alias("lengths"))  # as many as identifiers have letters at most
    parts = offered.select(*KEY, F.explode(F.array_distinct(F.array(normal_identifier(F.col("mpn")), normal_identifier(F.col("part_number"))))).alias("name")).withColumn("lengths", lengths.scalar())
    cut = parts.select(*KEY, "name", F.explode("lengths").alias("length")).where(F.length("name") >= F.col("length")).select(*KEY, F.expr("substring(name, 1, length)").alias("start")).distinct()
    # offers stand on the left: what a merge join holds of a start is its requests, never the offers that it begins
    return cut.join(keyed, "start").select(*asked.columns, *KEY)


@query("d08_prefix_join", with_views("""
select distinct r.request_id, o.source, o.part_number from requests r join offers o
on starts_with(upper(regexp_replace(o.mpn, '[^A-Za-z0-9]', '', 'g')), concat('BRAND', cast(r.request_id as varchar)))
or starts_with(upper(regexp_replace(o.part_number, '[^A-Za-z0-9]', '', 'g')), concat('BRAND', cast(r.request_id as varchar)))""", "requests", "offers"))
def d08(spark: SparkSession, d: str) -> DataFrame:
    asked = requests(spark, d).select("request_id", F.concat(F.lit("Brand-"), F.col("request_id").cast("string")).alias("prefix"))
    return prefix_join(asked, offers(spark, d), 5).drop("prefix")


@query("d09_equal_identifier_capped", with_views("""
select request_id, source, part_number, nth from (
select n.request_id, o.source, o.part_number, cast(row_number() over (partition by n.request_id order by o.stock desc, o.source, o.part_number) as int) nth
from named n join offers o on upper(regexp_replace(o.part_number, '[^A-Za-z0-9]', '', 'g')) = n.name) where nth <= 3""", "named", "offers"))
def d09(spark: SparkSession, d: str) -> DataFrame:
    """Three offers at most whose number, without separators, is the one that a customer names."""
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("stock"), *KEY))
    offered = offers(spark, d).select(*KEY, "stock", normal_identifier(F.col("part_number")).alias("name"))
    asked = named(spark, d).select("request_id", normal_identifier(F.col("name")).alias("name"))
    return asked.join(offered, "name").select("request_id", *KEY, nth.alias("nth")).where("nth <= 3")


@query("d10_compare_runs", with_views("""
select a.request_id, len(list_filter(a.parts, lambda x: not list_contains(b.parts, x))) only_a, len(list_filter(b.parts, lambda x: not list_contains(a.parts, x))) only_b
from (select request_id, list(distinct part_number) parts from candidates where rating_v is not null group by 1) a
join (select request_id, list(distinct part_number) parts from candidates where colour is not null group by 1) b using (request_id)""", "requests", "offers", "candidates"))
def d10(spark: SparkSession, d: str) -> DataFrame:
    """What one of two runs has and the other has not, counted by part; requests that only one run answers are left out."""

    def compared(found: DataFrame) -> DataFrame:
        parts = found.groupBy("request_id", "part_number").agg(F.bool_or(F.col("rating_v").isNotNull()).alias("a"), F.bool_or(F.col("colour").isNotNull()).alias("b"))
        counts = parts.groupBy("request_id").agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
        return counts.where("n_a > 0 and n_b > 0").select("request_id", "only_a", "only_b")

    return judged_candidates(spark, d, compared)


@query("d12_lists_complete_or_miss", with_views("""
select k.request_id, k.nth, k.part_number from
(select * from (select request_id, part_number, source, cast(row_number() over (partition by request_id order by unit_price, source, part_number) as int) nth from candidates) where nth <= 4) k
where k.request_id not in (
  select x.request_id from (select * from (select request_id, part_number, source, row_number() over (partition by request_id order by unit_price, source, part_number) nth from candidates) where nth <= 4) x
  join offers o on o.source = x.source and o.part_number = x.part_number where o.pk % 9 = 0)""", "requests", "offers", "candidates"))
def d12(spark: SparkSession, d: str) -> DataFrame:
    """Lists of ids meet the fresh offers; a list with an offer that isn't fresh is a miss as a whole."""
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("unit_price", *KEY))
    fresh = offers(spark, d).where("pk % 9 <> 0").select(*KEY, F.lit(True).alias("fresh"))

    def complete(found: DataFrame) -> DataFrame:
        lists = found.select("request_id", *KEY, "unit_price", nth.alias("nth")).where("nth <= 4")
        joined = lists.join(fresh, KEY, "left").withColumn("whole", F.every(F.coalesce("fresh", F.lit(False))).over(Window.partitionBy("request_id")))
        return joined.where("whole").select("request_id", "nth", "part_number")

    return judged_candidates(spark, d, complete)

