"""Orders, quotas and limits over ranked candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.bindings import evaluation, judged_candidates, offers, requests, table, with_views
from partloom.operators.assessment import ORDER_SQL, assessed, assessed_sql, total_order
from partloom.operators.checks import checked, checked_sql
from partloom.operators.matching import KEY
from partloom.registry import query

ALL = ("requests", "offers", "candidates")


def with_rank_normal(rows: DataFrame, column: str, group: str, out: str) -> DataFrame:
    """Dense rank of values rounded to four decimals, from 0 to 1; a single value gives 1."""
    own = Window.partitionBy(group)
    ranked = rows.withColumn("_rank", F.dense_rank().over(own.orderBy(F.floor(F.col(column) * 10000 + 0.5))))
    most = F.max("_rank").over(own)
    return ranked.withColumn(out, F.when(most == 1, 1.0).otherwise((F.col("_rank") - 1) / (most - 1))).drop("_rank")


def first_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order; never just any row."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


_RN = "case when max(r{0}) over (partition by qid) = 1 then 1.0::double else (r{0} - 1)::double / (max(r{0}) over (partition by qid) - 1) end"
_RANKED = "(select *, dense_rank() over (partition by qid order by floor(score_a * 10000 + 0.5)) ra, dense_rank() over (partition by qid order by floor(score_b * 10000 + 0.5)) rb from evaluation)"


@query("f01_page_with_total", with_views("select request_id, part_number, source, total, nth from (select request_id, part_number, source, count(*) over (partition by request_id) total, cast(row_number() over (partition by request_id order by unit_price, source, part_number) as int) nth from candidates) where nth between 6 and 10", *ALL))
def f01(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("request_id")

    def pages(found: DataFrame) -> DataFrame:
        page = found.select("request_id", *KEY, F.count("*").over(own).alias("total"), F.row_number().over(own.orderBy("unit_price", *KEY)).alias("nth"))
        return page.where("nth between 6 and 10")

    return judged_candidates(spark, d, pages)


@query("f02_rank_normal", with_views(f"select qid, cand_key, round({_RN.format('a')}, 6) rn from {_RANKED}", "evaluation"))
def f02(spark: SparkSession, d: str) -> DataFrame:
    return with_rank_normal(evaluation(spark, d), "score_a", "qid", "rn").select("qid", "cand_key", F.round("rn", 6).alias("rn"))


@query("f03_blend", with_views(f"select qid, cand_key, round(greatest(0, 0.5 * ra + 0.5 * rb - case when label = 0 then 0.1 else 0 end), 6) blend from (select qid, cand_key, label, {_RN.format('a')} ra, {_RN.format('b')} rb from {_RANKED})", "evaluation"))
def f03(spark: SparkSession, d: str) -> DataFrame:
    rows = with_rank_normal(with_rank_normal(evaluation(spark, d), "score_a", "qid", "ra"), "score_b", "qid", "rb")
    penalty = F.when(F.col("label") == 0, 0.1).otherwise(0.0)
    return rows.select("qid", "cand_key", F.round(F.greatest(F.lit(0.0), 0.5 * F.col("ra") + 0.5 * F.col("rb") - penalty), 6).alias("blend"))


@query("f04_unscored_tail", with_views("select qid, cand_key, round(case when line_no <= 3 then score_b else coalesce(min(case when line_no <= 3 then score_b end) over (partition by qid), 1) * label / 10 end, 6) score from evaluation", "evaluation"))
def f04(spark: SparkSession, d: str) -> DataFrame:
    """Rows past the third have no score and go below the lowest one."""
    scored = F.when(F.col("line_no") <= 3, F.col("score_b"))
    floor = F.coalesce(F.min(scored).over(Window.partitionBy("qid")), F.lit(1.0))
    return evaluation(spark, d).select("qid", "cand_key", F.round(F.coalesce(scored, floor * F.col("label") / 10), 6).alias("score"))


def _levelled(height: Column, need: Column, floor: int) -> Column:
    """What each source gives if units are taken one at a time from the highest, first name first, down to floor: all that
    stands above a level, and one more from the first ones that reach it. The level is the greatest at which that is enough."""
    first = Window.orderBy(height.desc(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    k = F.count("*").over(first)
    level = F.greatest(F.max(F.floor((F.sum(height).over(first) + k - need) / k)).over(every), F.lit(floor + 1))
    above = F.greatest(height - level, F.lit(0))
    reached = height >= level
    nth = F.count_if(reached).over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(need > 0, above + (reached & (nth <= need - F.sum(above).over(every))).cast("long")).otherwise(0)


def quotas(counts: DataFrame, most: int, least: int = 5) -> DataFrame:
    """source, n to source and quota: in proportion, at least least (or all it has), and together no more than most. What
    is over goes one at a time to the source with most left; what is too much comes from the largest quotas. Windows hold a
    row for each source."""
    everything = Window.partitionBy()
    share = F.least(F.col("n"), F.greatest(F.lit(least).cast("long"), F.floor(F.lit(most) * F.col("n") / F.sum("n").over(everything))))
    base = counts.withColumn("quota", share).withColumn("spare", F.lit(most) - F.sum("quota").over(everything)).withColumn("left", F.col("n") - F.col("quota"))
    base = base.withColumn("more", _levelled(F.col("left"), F.col("spare"), 0)).withColumn("less", _levelled(F.col("quota"), -F.col("spare"), least))
    return base.select("source", "n", (F.col("quota") + F.col("more") - F.col("less")).alias("quota"))


@query("f05_source_quotas", with_views("""
, c as (select source, count(*) n from offers where stock > 0 and colour = 'red' group by source),
b as (select *, least(n, greatest(5, cast(floor(40 * n / sum(n) over ()) as bigint))) quota from c), s as (select *, 40 - sum(quota) over () spare from b),
m as (select source, count(*) more from (select source, spare, row_number() over (order by slot desc, source) nth from (select source, spare, unnest(generate_series(1, n - quota)) slot from s where spare > 0)) where nth <= spare group by 1),
l as (select source, count(*) less from (select source, spare, row_number() over (order by slot desc, source) nth from (select source, spare, unnest(generate_series(6, quota)) slot from s where spare < 0)) where nth <= -spare group by 1)
select source, n, cast(quota + coalesce(more, 0) - coalesce(less, 0) as bigint) quota from s left join m using (source) left join l using (source)""", "offers").replace(") , c as", "), c as"))
def f05(spark: SparkSession, d: str) -> DataFrame:
    return quotas(offers(spark, d).where("stock > 0 and colour = 'red'").groupBy("source").agg(F.count("*").alias("n")), 40)


@query("f06_total_order", assessed_sql(f"select request_id, source, part_number, cast(row_number() over (partition by request_id order by {ORDER_SQL}) as int) nth from assessed"))
def f06(spark: SparkSession, d: str) -> DataFrame:
    return judged_candidates(spark, d, lambda found: assessed(found).select("request_id", *KEY, F.row_number().over(Window.partitionBy("request_id").orderBy(*total_order())).alias("nth")))


@query("f07_monotone_scores", with_views("select qid, cand_key, case when label = 3 then 1.0::double else round(min(score_b) over (partition by qid order by line_no, cand_key rows between unbounded preceding and current row), 6) end score from evaluation", "evaluation"))
def f07(spark: SparkSession, d: str) -> DataFrame:
    """Scores never rise down the list; named rows, here those of label 3, stand at 1."""
    running = F.min("score_b").over(Window.partitionBy("qid").orderBy("line_no", "cand_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return evaluation(spark, d).select("qid", "cand_key", F.when(F.col("label") == 3, 1.0).otherwise(F.round(running, 6)).alias("score"))


@query("f08_top_k_per_source", with_views("select request_id, source, part_number, nth from (select request_id, source, part_number, max_results, cast(row_number() over (partition by request_id, source order by unit_price, part_number) as int) nth from candidates) where nth <= max_results", *ALL))
def f08(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("request_id", "source").orderBy("unit_price", "part_number"))
    return judged_candidates(spark, d, lambda found: found.select("request_id", *KEY, "max_results", nth.alias("nth")).where("nth <= max_results").drop("max_results"))


@query("f09_reserved_place", with_views("""
select request_id, part_number, source, nth from (
select request_id, part_number, source, stock, named, cast(row_number() over (partition by request_id order by not (named and stock = 0) and stock = 0, named and stock = 0, unit_price, source, part_number) as int) nth,
count(case when stock > 0 then 1 end) over (partition by request_id) live, max(case when named and stock = 0 then 1 else 0 end) over (partition by request_id) listed
from (select r.request_id, o.part_number, o.source, o.stock, o.unit_price, o.pk % 50 = r.request_id % 50 named from requests r join offers o on o.family = r.family and o.manufacturer = r.maker) where stock > 0 or named) where (stock > 0 and nth <= 3 - listed) or (stock = 0 and nth = live + 1)""", "requests", "offers"))
def f09(spark: SparkSession, d: str) -> DataFrame:
    """Three places among a request's offers; if one that it names is listed without stock, the last place is its.

    What is in stock is ranked once a class and what is not once a class and name, so requests meet four offers each."""
    classes, named = ["family", "manufacturer"], F.col("pk") % 50
    every = offers(spark, d).select(*classes, *KEY, "unit_price", "stock", named.alias("name"))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("unit_price", *KEY))
    live = every.where("stock > 0").withColumn("nth", nth(*classes)).where("nth <= 3").drop("stock", "name", "unit_price")
    listed = every.where("stock = 0").withColumn("first", nth(*classes, "name")).where("first = 1").select(*classes, "name", *KEY)
    n_live = every.where("stock > 0").groupBy(*classes).agg(F.count("*").alias("live"))
    asked = requests(spark, d).select("request_id", "family", F.col("maker").alias("manufacturer"), (F.col("request_id") % 50).alias("name"))
    reserved = asked.join(listed, [*classes, "name"]).join(n_live, classes, "left").select("request_id", "part_number", "source", (F.coalesce("live", F.lit(0)) + 1).cast("int").alias("nth"))
    held = reserved.select("request_id", F.lit(1).alias("listed"))
    places = asked.join(live, classes).join(held, "request_id", "left").where(F.col("nth") <= 3 - F.coalesce("listed", F.lit(0)))
    return places.select("request_id", "part_number", "source", "nth").union(reserved)


@query("f10_keep_first", with_views("select mpn, source, part_number from (select mpn, source, part_number, row_number() over (partition by mpn order by unit_price, source, part_number) nth from offers) where nth = 1", "offers"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    # dealt to as many tasks as a shuffle has before any is sorted
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = offers(spark, d).select("mpn", "unit_price", *KEY).repartition(n, "mpn")
    return first_by_key(dealt, ["mpn"], ["unit_price", *KEY]).select("mpn", *KEY)


@query("f11_cap_of_live_rows", with_views("select family, source, part_number from (select family, source, part_number, sum(case when stock > 0 then 1 else 0 end) over (partition by family order by unit_price, source, part_number rows between unbounded preceding and current row) live from offers) where live <= 10", "offers"))
def f11(spark: SparkSession, d: str) -> DataFrame:
    """All that comes before the eleventh row in stock. Only that row is looked for, by a limit that tasks apply before they
    send anything, so no family is ever sorted as a whole."""
    rows = offers(spark, d)
    edge = live_rows(rows, 11).where("nth = 11").select("family", _place().alias("edge"))
    return rows.join(F.broadcast(edge), "family", "left").where(F.col("edge").isNull() | (_place() < F.col("edge"))).select("family", *KEY)


def _place() -> Column:
    return F.struct("unit_price", *KEY)


def live_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first rows in stock of each family, numbered."""
    nth = F.row_number().over(Window.partitionBy("family").orderBy("unit_price", *KEY))
    return rows.where("stock > 0").withColumn("nth", nth).where(F.col("nth") <= most)


@query("f11_capped_list", with_views("select family, source, part_number from offers where stock <= 0 union all select family, source, part_number from (select family, source, part_number, row_number() over (partition by family order by unit_price, source, part_number) nth from offers where stock > 0) where nth <= 100", "offers"))
def f11_capped(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows in stock, and every row that is listed without stock."""
    rows = offers(spark, d)
    return rows.where("stock <= 0").select("family", *KEY).union(live_rows(rows, 100).select("family", *KEY))


STALE_PENALTIES = {"nth": 1.0, "nth_mild": 0.2}


def stale_last(rows: DataFrame, penalty: float, out: str) -> DataFrame:
    """rows (request_id, grp, rank, score, stale) with their place out once stale rows are lowered by penalty.

    Scores don't rise down a list, and rows of a group stand together. So to put each stale row before the first fresh one of its
    group that scores less than what is left of its score is to merge both by that score, fresh rows first where it is equal.
    """
    left = F.round(F.col("score") - F.when(F.col("stale"), penalty).otherwise(0.0), 6)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy("request_id").orderBy("grp", left.desc(), "stale", "rank")))


_STALE_ORDER = "cast(row_number() over (partition by request_id order by grp, round(score - case when stale then {} else 0e0 end, 6) desc, stale, rank) as int)"


@query("f12_stale_demotion", assessed_sql(f"""
, ranked as (select *, row_number() over (partition by request_id order by {ORDER_SQL}) rank from assessed),
listed as (select request_id, source, part_number, rank, fetched_at < timestamp '2001-01-01' stale, min(final) over (partition by request_id order by rank rows between unbounded preceding and current row) score,
case when named then -1 else 2 * class_no + case when tier % 16 >= 8 then 1 else 0 end end grp from ranked)
select request_id, source, part_number, {_STALE_ORDER.format("1e0")} nth, {_STALE_ORDER.format("2e-1")} nth_mild from listed"""))
def f12(spark: SparkSession, d: str) -> DataFrame:
    """Groups are named parts, then match classes, each with what meets the request before what is below spec."""
    own = Window.partitionBy("request_id")

    def demoted(found: DataFrame) -> DataFrame:
        rows = assessed(found).withColumn("rank", F.row_number().over(own.orderBy(*total_order())))
        class_no = F.when(F.col("match_class") == "complete", 0).when(F.col("match_class") == "partial", 2).otherwise(4)
        group = F.when(F.col("tier") < 0, -1).otherwise(class_no + (F.col("tier") % 16 >= 8).cast("int"))
        running = F.min("final").over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        stale = F.col("fetched_at") < F.lit("2001-01-01").cast("timestamp_ntz")
        rows = rows.select("request_id", *KEY, "rank", stale.alias("stale"), running.alias("score"), group.alias("grp"))
        for out, penalty in STALE_PENALTIES.items():
            rows = stale_last(rows, penalty, out)
        return rows.select("request_id", *KEY, *STALE_PENALTIES)

    return judged_candidates(spark, d, demoted)


def relaxation(rows: DataFrame, steps: int, enough: int) -> DataFrame:
    """rows (request_id, step, confirmed) to the least relaxed step with enough rows, one of them confirmed; else the last.

    step is the first at which a row passes; counts over steps add up, so no step is tried by itself.
    """
    counts = rows.groupBy("request_id", "step").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("sure"))
    domain = counts.select("request_id").distinct().select("request_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    running = Window.partitionBy("request_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = domain.join(counts, ["request_id", "step"], "left").select("request_id", "step", F.sum(F.coalesce("n", F.lit(0))).over(running).alias("n"), F.sum(F.coalesce("sure", F.lit(0))).over(running).alias("sure"))
    passes = (F.col("n") >= enough) & (F.col("sure") >= 1)
    return upto.groupBy("request_id").agg(F.coalesce(F.min(F.when(passes, F.col("step"))), F.lit(steps - 1)).alias("step"), F.max("n").alias("n_all"))


_STEP = "case when s_colour = 'conflict' then 2 when kind <> 'bolt' then 1 else 0 end"


def relax_step() -> Column:
    """0: all groups hold; 1: without the text; 2: without the colour too."""
    return F.when(F.col("s_colour") == "conflict", 2).when(F.col("kind") != "bolt", 1).otherwise(0)


@query("f13_relaxation", checked_sql(f"""
, t as (select request_id, {_STEP} step, size_v is not null sure from checked where s_size <> 'conflict'),
g as (select request_id, s step, (select count(*) from t where t.request_id = r.request_id and t.step <= s) n, (select count(*) from t where t.request_id = r.request_id and t.step <= s and sure) sure from (select distinct request_id from t) r, (values (0), (1), (2)) v(s))
select request_id, coalesce(min(case when n >= 20 and sure >= 1 then step end), 2) step, max(n) n_all from g group by 1""").replace(") , t as", "), t as"))
def f13(spark: SparkSession, d: str) -> DataFrame:

    def relaxed(found: DataFrame) -> DataFrame:
        rows = checked(found).where("s_size <> 'conflict'").select("request_id", relax_step().alias("step"), F.col("size_v").isNotNull().alias("confirmed"))
        return relaxation(rows, 3, 20)

    return judged_candidates(spark, d, relaxed)


@query("f14_stratified_sample", "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) nth from documents) where nth <= 10")
def f14(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return table(spark, d, "documents").select("lang", "doc_id", nth.alias("nth")).where("nth <= 10").drop("nth")


@query("f15_round_robin", with_views("select part_number, source, cast(row_number() over (order by nth, source) as int) place from (select part_number, source, row_number() over (partition by source order by unit_price, part_number) nth from offers) where nth <= 20", "offers"))
def f15(spark: SparkSession, d: str) -> DataFrame:
    """Numbering comes after the cut to 20 rows a source."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("unit_price", "part_number"))
    return offers(spark, d).select(*KEY, nth.alias("nth")).where("nth <= 20").select(*KEY, F.row_number().over(Window.orderBy("nth", "source")).alias("place"))


#: Leading digits of a hash by which rows are counted before any is sorted.
DIGITS = 3


def among_first(rows: DataFrame, groups: list[str], by: Column, k: int) -> DataFrame:
    """rows that can be among the first k of their group in the order of a hexadecimal hash, all of them, with few others: counts by
    leading digits tell where the k-th is. So no task sorts more than it keeps, however large the groups are."""
    lead = F.coalesce(F.substring(by, 1, DIGITS), F.lit(""))  # no hash comes first
    upto = F.sum("n").over(Window.partitionBy(*groups).orderBy("_lead"))  # a row for each group and digits
    counts = rows.groupBy(*groups, lead.alias("_lead")).agg(F.count("*").alias("n")).withColumn("before", upto - F.col("n"))
    last = counts.where(F.col("before") < k).groupBy(*groups).agg(F.max("_lead").alias("_last"))
    edges = last.select(*(F.col(g).alias(f"_{g}") for g in groups), "_last")
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups])
    return rows.join(F.broadcast(edges), same & (lead <= F.col("_last"))).select(*rows.columns)  # a row for each group


@query("f16_label_capped_sample", with_views("""
, a as (select category, label, cand_key, row_number() over (partition by category, label order by md5(cand_key)) nl from evaluation), b as (select *, row_number() over (partition by category order by case when nl <= 10 then 0 else 1 end, md5(cand_key)) nth from a)
select category, cand_key, label from b where nth <= 40""", "evaluation").replace(") , a as", "), a as"))
def f16(spark: SparkSession, d: str) -> DataFrame:
    """At most ten of each label first, then others up to forty."""
    by = F.md5("cand_key")
    # before a label's row beyond the fortieth stand forty of that label
    first = among_first(evaluation(spark, d), ["category", "label"], by, 40)
    rows = first.withColumn("nl", F.row_number().over(Window.partitionBy("category", "label").orderBy(by)))
    nth = F.row_number().over(Window.partitionBy("category").orderBy((F.col("nl") > 10).cast("int"), by))
    return rows.withColumn("nth", nth).where("nth <= 40").select("category", "cand_key", "label")


def average_rank(order: Column, group: str) -> Column:
    """Ties are counted in the window that ranks, as the frame of equal values: one sort for an order, one shuffle for a group."""
    own = Window.partitionBy(group).orderBy(order)
    return F.rank().over(own) + (F.count("*").over(own.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


@query("f17_average_ranks", with_views("select qid, cand_key, cast(rank() over (partition by qid order by label) + (count(*) over (partition by qid, label) - 1) / 2 as double) avg_rank from evaluation", "evaluation"))
def f17(spark: SparkSession, d: str) -> DataFrame:
    return evaluation(spark, d).select("qid", "cand_key", average_rank(F.col("label"), "qid").cast("double").alias("avg_rank"))


@query("f18_hybrid_orders", with_views("""
select qid, cand_key, cast(row_number() over (partition by qid order by score_a / 100000 + score_b / 100 desc, cand_key) as int) additive, cast(row_number() over (partition by qid order by floor(score_a / 100000 / 0.05) desc, score_b desc, cand_key) as int) banded,
cast(row_number() over (partition by qid order by score_b >= 25 desc, score_a desc, cand_key) as int) threshold from evaluation""", "evaluation"))
def f18(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("score_a") / 100000, F.col("score_b")
    place = lambda *o: F.row_number().over(Window.partitionBy("qid").orderBy(*o, "cand_key"))
    return evaluation(spark, d).select("qid", "cand_key", place((a + b / 100).desc()).alias("additive"), place(F.floor(a / 0.05).desc(), b.desc()).alias("banded"), place((b >= 25).desc(), F.desc("score_a")).alias("threshold"))


@query("f19_hash_tie_break", with_views("select qid, cand_key, cast(row_number() over (partition by qid order by label desc, sha1(cand_key)) as int) nth from evaluation", "evaluation"))
def f19(spark: SparkSession, d: str) -> DataFrame:
    return evaluation(spark, d).select("qid", "cand_key", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("label"), F.sha1("cand_key"))).alias("nth"))


@query("g01_tiered_order", with_views("select request_id, source, part_number, cast(row_number() over (partition by request_id order by case when min_rating is null then 0 when rating_v is null then 1 when rating_v >= min_rating then 2 else 0 end desc, (size_v is not null and rating_v is not null and colour is not null) desc, coalesce(colour = want_colour, false) desc, source, part_number) as int) nth from candidates", *ALL))
def g01(spark: SparkSession, d: str) -> DataFrame:
    rated = F.when(F.col("min_rating").isNull(), 0).when(F.col("rating_v").isNull(), 1).when(F.col("rating_v") >= F.col("min_rating"), 2).otherwise(0)
    sure = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("size_v", "rating_v", "colour")])
    soft = F.coalesce(F.col("colour") == F.col("want_colour"), F.lit(False))
    return judged_candidates(spark, d, lambda found: found.select("request_id", *KEY, F.row_number().over(Window.partitionBy("request_id").orderBy(rated.desc(), sure.desc(), soft.desc(), *KEY)).alias("nth")))


@query("g02_most_stated_first", with_views("select source, part_number, nth from (select source, part_number, cast(row_number() over (order by case when size_v is null then 0 else 1 end + case when rating_v is null then 0 else 1 end + case when colour is null then 0 else 1 end desc, stock desc, source, part_number) as int) nth from offers) where nth <= 100", "offers"))
def g02(spark: SparkSession, d: str) -> DataFrame:
    """The hundred that state most; the limit is taken before rows are numbered."""
    n = sum((F.col(c).isNotNull().cast("int") for c in ("size_v", "rating_v", "colour")), F.lit(0))
    order = [F.desc("n"), F.desc("stock"), *KEY]
    top = offers(spark, d).select(*KEY, "stock", n.alias("n")).orderBy(*order).limit(100)
    return top.select(*KEY, F.row_number().over(Window.orderBy(*order)).alias("nth"))


@query("g03_page", with_views("select source, part_number, unit_price from offers order by unit_price, source, part_number limit 50 offset 100", "offers"))
def g03(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select(*KEY, "unit_price").orderBy("unit_price", *KEY).offset(100).limit(50)


@query("g06_ordered_union", "select user_id, array_to_string(list_concat(a, list_filter(b, lambda x: not list_contains(a, x))), ',') kinds from (select user_id, list(distinct event_type order by event_type) filter (where value < 5) a, list(distinct event_type order by event_type) filter (where value >= 5) b from events group by 1) where a is not null and b is not null")
def g06(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(F.col("value") < 5, F.col("event_type")))).alias("a"), F.sort_array(F.collect_set(F.when(F.col("value") >= 5, F.col("event_type")))).alias("b"))
    return sets.where((F.size("a") > 0) & (F.size("b") > 0)).select("user_id", F.array_join(F.array_union("a", "b"), ",").alias("kinds"))


@query("g07_merge_hits", with_views("""
select request_id, part_number, source, origin from (select *, row_number() over (partition by request_id order by origin, unit_price, source, part_number) nth from (
select *, row_number() over (partition by request_id, source, part_number order by origin) again from (
select request_id, part_number, source, unit_price, 1 origin from candidates where rating_v is not null and rating_v >= 40 union all select request_id, part_number, source, unit_price, 2 from candidates where contains(kind, 'bolt'))) where again = 1) where nth <= 8""", *ALL))
def g07(spark: SparkSession, d: str) -> DataFrame:
    """Typed hits, then text hits, each offer once, until the window is full."""

    def merged(found: DataFrame) -> DataFrame:
        found = found.select("request_id", *KEY, "unit_price", "rating_v", "kind")
        both = found.where("rating_v >= 40").withColumn("origin", F.lit(1)).union(found.where(F.col("kind").contains("bolt")).withColumn("origin", F.lit(2)))
        once = first_by_key(both, ["request_id", *KEY], ["origin"])
        nth = F.row_number().over(Window.partitionBy("request_id").orderBy("origin", "unit_price", *KEY))
        return once.withColumn("nth", nth).where("nth <= 8").select("request_id", "part_number", "source", "origin")

    return judged_candidates(spark, d, merged)
