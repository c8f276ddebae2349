"""Counts, profiles and allocations over offers, candidates and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.bindings import judged_candidates, offers, table, with_views
from partloom.operators.checks import checked, checked_sql, conflicts, unverified
from partloom.operators.matching import KEY, old_state
from partloom.registry import query

ATTRIBUTES = ("size_v", "rating_v", "colour", "kind")


def counts_over(domain: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Counts by group, with 0 for groups of the domain that have no rows."""
    return domain.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def largest_remainder(pools: DataFrame, total: str, weight: str, group: str, key: str) -> DataFrame:
    """Shares of a group's total in proportion to weights, whole numbers that add up to it: what rounding down leaves goes
    to the largest remainders, ties in key order."""
    own = Window.partitionBy(group)
    exact = F.col(total) * F.col(weight)
    whole = F.sum(weight).over(own)
    shares = pools.withColumn("share", F.when(whole > 0, F.floor(exact / whole)).otherwise(0)).withColumn("rest", F.when(whole > 0, exact % whole).otherwise(0))
    left = F.when(F.sum(weight).over(own) > 0, F.col(total) - F.sum("share").over(own)).otherwise(0)
    place = F.row_number().over(own.orderBy(F.desc("rest"), key))
    return shares.withColumn("share", F.col("share") + (place <= left).cast("long")).drop("rest")


@query("e01_count_zero_filled", with_views("select n_name, coalesce(n, 0) n from nation left join (select concat('NATION_', cast(sk % 40 as varchar)) n_name, count(*) n from offers where stock > 0 group by 1) using (n_name)", "offers"))
def e01(spark: SparkSession, d: str) -> DataFrame:
    named = offers(spark, d).where("stock > 0").select(F.concat(F.lit("NATION_"), (F.col("sk") % 40).cast("string")).alias("n_name"))
    return counts_over(table(spark, d, "nation").select("n_name"), named, "n_name")


@query("e02_conditional_counts", with_views("select source, count(*) total, count(case when fetched_at >= timestamp '2001-01-01' then 1 end) fresh, count(case when fetched_at < timestamp '2001-01-01' and stock > 0 then 1 end) stale_stock, min(fetched_at) oldest from offers group by source", "offers"))
def e02(spark: SparkSession, d: str) -> DataFrame:
    fresh = F.col("fetched_at") >= F.lit("2001-01-01").cast("timestamp_ntz")
    return offers(spark, d).groupBy("source").agg(F.count("*").alias("total"), F.count_if(fresh).alias("fresh"), F.count_if(~fresh & (F.col("stock") > 0)).alias("stale_stock"), F.min("fetched_at").alias("oldest"))


@query("e03_distinct_per_type", "select event_type, count(distinct user_id) n_users from events group by event_type")
def e03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


@query("e04_two_key_counts", "select coalesce(nullif(event_type, 'view'), 'unknown') kind, user_id % 5 bucket, count(*) n from events group by 1, 2")
def e04(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("unknown"))
    return table(spark, d, "events").groupBy(kind.alias("kind"), (F.col("user_id") % 5).alias("bucket")).agg(F.count("*").alias("n"))


@query("e05_sum_by_tag", "select event_type, count(*) total from events where cast(json_extract_string(props, '$.k') as int) % 2 = 0 group by event_type")
def e05(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(F.lit("type"), F.col("event_type"), F.lit("parity"), (F.get_json_object("props", "$.k").cast("int") % 2).cast("string"))
    counted = table(spark, d, "events").select(tags.alias("tags"), F.lit(1).cast("long").alias("n"))
    return counted.where(F.col("tags")["parity"] == "0").groupBy(F.col("tags")["type"].alias("event_type")).agg(F.sum("n").alias("total"))


_REASON = "case when s_size = 'conflict' then 'size' when s_rating = 'conflict' then 'rating' when s_colour = 'conflict' then 'colour' end"


@query("e06_excluded_by_first_conflict", checked_sql(f"select request_id, source, {_REASON} reason, count(*) n from checked where {_REASON} is not null group by 1, 2, 3"))
def e06(spark: SparkSession, d: str) -> DataFrame:
    return judged_candidates(spark, d, lambda found: checked(found).withColumn("reason", F.get(conflicts(), 0)).where("reason is not null").groupBy("request_id", "source", "reason").agg(F.count("*").alias("n")))


@query("e07_below_spec_nearest", checked_sql("""
select request_id, nth, part_number, source, n_below from (select request_id, source, part_number, count(*) over (partition by request_id) n_below,
cast(row_number() over (partition by request_id order by abs(ln(rating_v / min_rating)), source, part_number) as int) nth from checked where s_rating = 'conflict') where nth <= 5"""))
def e07(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("request_id")
    nth = F.row_number().over(own.orderBy(F.abs(F.log(F.col("rating_v") / F.col("min_rating"))), *KEY))
    return judged_candidates(spark, d, lambda found: checked(found).where("s_rating = 'conflict'").select("request_id", *KEY, F.count("*").over(own).alias("n_below"), nth.alias("nth")).where("nth <= 5"))


@query("e08_fill_rate", with_views("select family, " + ", ".join(f"round(avg(case when {c} is not null then 1.0 else 0.0 end), 6) {c}" for c in ATTRIBUTES) + ", count(*) n from offers group by family having count(*) >= 20", "offers"))
def e08(spark: SparkSession, d: str) -> DataFrame:
    rates = [F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(c) for c in ATTRIBUTES]
    return offers(spark, d).groupBy("family").agg(*rates, F.count("*").alias("n")).where("n >= 20")


def attribute_rows(rows: DataFrame) -> DataFrame:
    """A row for each stated attribute."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in ATTRIBUTES])
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")


@query("e09_attribute_cardinality", with_views("select attribute, count(*) n, count(distinct value) n_distinct from (" + " union all ".join(f"select '{c}' attribute, cast({c} as varchar) as value from offers" for c in ATTRIBUTES) + ") where value is not null group by attribute", "offers"))
def e09(spark: SparkSession, d: str) -> DataFrame:
    return attribute_rows(offers(spark, d)).groupBy("attribute").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"))


@query("e09_top_values", with_views("select attribute, value, n, nth from (select *, cast(row_number() over (partition by attribute order by n desc, value) as int) nth from (select attribute, value, count(*) n from (" + " union all ".join(f"select '{c}' attribute, cast({c} as varchar) as value from offers" for c in ATTRIBUTES) + ") where value is not null group by 1, 2)) where nth <= 10", "offers"))
def e09_top(spark: SparkSession, d: str) -> DataFrame:
    counts = attribute_rows(offers(spark, d)).groupBy("attribute", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("nth", F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("n"), "value"))).where("nth <= 10")


@query("e10_spellings_per_value", with_views("select size_v, count(distinct description) spellings, count(*) n from offers where size_v is not null group by size_v", "offers"))
def e10(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where("size_v is not null").groupBy("size_v").agg(F.count_distinct("description").alias("spellings"), F.count("*").alias("n"))


@query("e11_unclassified_share", with_views("select kind, n, share from (select kind, n, round(n / sum(n) over (), 6) share, row_number() over (order by n desc, kind) nth from (select kind, count(*) n from offers where colour is null group by kind)) where nth <= 5", "offers"))
def e11(spark: SparkSession, d: str) -> DataFrame:
    counts = offers(spark, d).where("colour is null").groupBy("kind").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # a row for each kind
    return counts.select("kind", "n", F.round(share, 6).alias("share")).orderBy(F.desc("n"), "kind").limit(5)


@query("e12_classes_of_category", with_views("select kind, string_agg(family, ',' order by nth) families from (select kind, family, row_number() over (partition by kind order by count(*) desc, family) nth from offers group by kind, family) where nth <= 4 group by kind", "offers"))
def e12(spark: SparkSession, d: str) -> DataFrame:
    counts = offers(spark, d).groupBy("kind", "family").agg(F.count("*").alias("n"))
    top = counts.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "family"))).where("nth <= 4")
    names = F.transform(F.array_sort(F.collect_list(F.struct("nth", "family"))), lambda x: x.family)
    return top.groupBy("kind").agg(F.array_join(names, ",").alias("families"))


@query("e13_column_profile", with_views(" union all ".join(f"select '{c}' column_name, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) null_rate, count(distinct {c}) n_distinct from offers" for c in ATTRIBUTES), "offers"))
def e13(spark: SparkSession, d: str) -> DataFrame:
    facts = [F.struct(F.lit(c).alias("column_name"), F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias("null_rate"), F.count_distinct(c).alias("n_distinct")).alias(c) for c in ATTRIBUTES]
    return offers(spark, d).agg(*facts).select(F.explode(F.array(*ATTRIBUTES)).alias("p")).select("p.*")


def n_stated() -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in ATTRIBUTES), F.lit(0))


@query("e14_fields_per_row", with_views("select family, round(avg(k), 6) mean_fields, round(avg(case when k >= 3 then 1.0 else 0.0 end), 6) share_three from (select family, " + " + ".join(f"case when {c} is null then 0 else 1 end" for c in ATTRIBUTES) + " k from offers) group by family", "offers"))
def e14(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy("family").agg(F.round(F.avg(n_stated()), 6).alias("mean_fields"), F.round(F.avg((n_stated() >= 3).cast("double")), 6).alias("share_three"))


@query("e15_unconfirmed_everywhere", checked_sql("""
, shown as (select * from (select *, row_number() over (partition by request_id order by unit_price, source, part_number) nth from checked) where nth <= max_results)
select request_id, attribute, count(*) n from (select request_id, unnest(list_filter([case when s_size = 'unknown' then 'size' end, case when s_rating = 'unknown' then 'rating' end, case when s_colour = 'unknown' then 'colour' end], lambda x: x is not null)) attribute
from shown where request_id in (select request_id from shown group by 1 having bool_and('unknown' in (s_size, coalesce(s_rating, ''), coalesce(s_colour, ''))))) group by 1, 2""").replace(") , shown", "), shown"))
def e15(spark: SparkSession, d: str) -> DataFrame:
    """Only for requests of whose page every row leaves something unverified."""
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("unit_price", *KEY))

    def pages(found: DataFrame) -> DataFrame:
        shown = found.withColumn("nth", nth).where("nth <= max_results")
        rows = checked(shown).select("request_id", unverified().alias("open"))
        every = rows.groupBy("request_id").agg(F.bool_and(F.size("open") > 0).alias("all_open"), F.flatten(F.collect_list("open")).alias("open"))
        return every.where("all_open").select("request_id", F.explode("open").alias("attribute")).groupBy("request_id", "attribute").agg(F.count("*").alias("n"))

    return judged_candidates(spark, d, pages)


@query("e16_largest_remainder", """
with p as (select event_type grp, user_id % 7 k, count(*) w from events group by 1, 2),
s as (select *, 1000 // 1 total, 1000 * w // sum(w) over (partition by grp) share, 1000 * w % sum(w) over (partition by grp) rest from p)
select grp, k, cast(share + case when row_number() over (partition by grp order by rest desc, k) <= 1000 - sum(share) over (partition by grp) then 1 else 0 end as bigint) share from s""")
def e16(spark: SparkSession, d: str) -> DataFrame:
    pools = table(spark, d, "events").groupBy(F.col("event_type").alias("grp"), (F.col("user_id") % 7).alias("k")).agg(F.count("*").alias("w")).withColumn("total", F.lit(1000).cast("long"))
    return largest_remainder(pools, "total", "w", "grp", "k").select("grp", "k", "share")


def transfers(series: DataFrame, pools: DataFrame, name: str, key: str) -> DataFrame:
    """series (name, key, target, live, moved) and pools (name, pool) to held, amount and pool_left. What a series holds, be it
    counted live or moved before, counts against its target; what it lacks comes out of the pool of its name, in full where
    the pool covers all, else in proportion. So a name's total never changes, and a second run moves nothing twice."""
    held = series.withColumn("held", F.greatest("live", "moved")).withColumn("lacks", F.greatest(F.lit(0), F.col("target") - F.col("held")))
    own = Window.partitionBy(name)
    given = held.join(pools, name, "left").withColumn("pool", F.coalesce("pool", F.lit(0))).withColumn("total", F.least("pool", F.sum("lacks").over(own)))
    shared = largest_remainder(given, "total", "lacks", name, key).withColumnRenamed("share", "amount")
    return shared.withColumn("pool_left", F.col("pool") - F.sum("amount").over(own))


@query("e17_amounts_to_move", """
with s as (select event_type, user_id % 5 tag, count(case when value >= 10 then 1 end) target, count(case when value >= 30 then 1 end) live, count(case when event_id % 4 = 0 then 1 end) moved from events group by 1, 2),
p as (select event_type, count(case when value < case when event_type in ('view', 'click') then 60 else 8 end then 1 end) pool from events group by 1),
l as (select *, greatest(live, moved) held, greatest(0, target - greatest(live, moved)) lacks from s join p using (event_type)),
t as (select *, least(pool, sum(lacks) over w) total, sum(lacks) over w whole from l window w as (partition by event_type)),
q as (select *, case when whole > 0 then total * lacks // whole else 0 end part, case when whole > 0 then total * lacks % whole else 0 end rest from t),
a as (select *, part + case when whole > 0 and row_number() over (partition by event_type order by rest desc, tag) <= total - sum(part) over (partition by event_type) then 1 else 0 end amount from q)
select event_type, tag, target, held, cast(amount as bigint) amount, cast(pool - sum(amount) over (partition by event_type) as bigint) pool_left from a""")
def e17(spark: SparkSession, d: str) -> DataFrame:
    """Counters by type and tag, with what has no tag yet as the pool of the type; what they hold is half counted, half moved."""
    events, value = table(spark, d, "events"), F.col("value")
    series = events.groupBy("event_type", (F.col("user_id") % 5).alias("tag")).agg(F.count_if(value >= 10).alias("target"), F.count_if(value >= 30).alias("live"), F.count_if(F.col("event_id") % 4 == 0).alias("moved"))
    pools = events.groupBy("event_type").agg(F.count_if(value < F.when(F.col("event_type").isin("view", "click"), 60).otherwise(8)).alias("pool"))
    return transfers(series, pools, "event_type", "tag").select("event_type", "tag", "target", "held", "amount", "pool_left")


@query("e18_latency_summary", "select event_type, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.9), 6) p90, round(quantile_cont(value, 0.95), 6) p95, max(value) most from events group by event_type")
def e18(spark: SparkSession, d: str) -> DataFrame:
    at = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), *(F.round(F.percentile("value", F.lit(p)), 6).alias(k) for k, p in at.items()), F.max("value").alias("most"))


@query("e19_added_and_refreshed", with_views("select source, count(case when pk % 2 = 0 then 1 end) refreshed, count(case when pk % 2 <> 0 then 1 end) added from offers group by source", "offers"))
def e19(spark: SparkSession, d: str) -> DataFrame:
    now = offers(spark, d)
    known = old_state(now).select(*KEY, F.lit(True).alias("known"))
    return now.join(known, KEY, "left").groupBy("source").agg(F.count_if("known").alias("refreshed"), F.count_if(F.col("known").isNull()).alias("added"))


@query("e20_response_accounting", checked_sql("""
select request_id, source, count(*) fetched, count(case when s_size <> 'conflict' and coalesce(s_colour, '') <> 'conflict' and coalesce(s_rating, '') <> 'conflict' then 1 end) returned,
count(case when s_size = 'match' and coalesce(s_rating, 'match') = 'match' and coalesce(s_colour, 'match') = 'match' then 1 end) exact,
count(case when s_size = 'conflict' or s_colour = 'conflict' then 1 end) excluded, count(case when s_rating = 'conflict' and s_size <> 'conflict' and coalesce(s_colour, '') <> 'conflict' then 1 end) below_spec,
count(case when stock < quantity then 1 end) short from checked group by request_id, source"""))
def e20(spark: SparkSession, d: str) -> DataFrame:
    return judged_candidates(spark, d, lambda found: accounting(checked(found)))


def accounting(rows: DataFrame) -> DataFrame:
    """One row for each request and source, of one pass over the checked candidates."""
    reasons = conflicts()
    constraint = (F.col("s_size") == "conflict") | (F.coalesce("s_colour", F.lit("")) == "conflict")
    exact = (F.col("s_size") == "match") & (F.coalesce("s_rating", F.lit("match")) == "match") & (F.coalesce("s_colour", F.lit("match")) == "match")
    return rows.groupBy("request_id", "source").agg(
        F.count("*").alias("fetched"), F.count_if(F.size(reasons) == 0).alias("returned"), F.count_if(exact).alias("exact"), F.count_if(constraint).alias("excluded"),
        F.count_if(~constraint & (F.coalesce("s_rating", F.lit("")) == "conflict")).alias("below_spec"), F.count_if(F.col("stock") < F.col("quantity")).alias("short"),
    )
