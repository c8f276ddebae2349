"""Tables over time: upserts, freshness, repair and counters, each as one join of old and new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.bindings import MARGIN, alike, judged_candidates, offers, requests, table, with_views
from partloom.operators.matching import KEY, candidate_join, coverage, old_state
from partloom.registry import query

AS_OF = "2001-06-01"
#: Days that rows of a source are kept; null is for ever.
RETENTION = (("S0", 30), ("S1", 365), ("S2", None))
OLD, NEW = "(select * from offers where pk % 2 = 0)", "(select *, stock + 1 new_stock, fetched_at + interval 1 day new_at from offers where pk % 3 = 0)"


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def new_state(rows: DataFrame) -> DataFrame:
    """What has been fetched since: every third part, a day later, with one more in stock."""
    later = (F.col("fetched_at") + F.expr("interval 1 day")).alias("new_at")
    return rows.where("pk % 3 = 0").select(*KEY, (F.col("stock") + 1).alias("new_stock"), later)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest stock of each key; times never go back."""
    merged = old.select(*KEY, "stock", "fetched_at").join(new, KEY, "full")
    return merged.select(*KEY, F.coalesce("new_stock", "stock").alias("stock"), F.greatest("fetched_at", "new_at").alias("fetched_at"))


@query("j01_upsert", with_views(f"select source, part_number, coalesce(n.new_stock, o.stock) stock, greatest(o.fetched_at, n.new_at) fetched_at from {OLD} o full join {NEW} n using (source, part_number)", "offers"))
def j01(spark: SparkSession, d: str) -> DataFrame:
    rows = offers(spark, d)
    return upsert(old_state(rows), new_state(rows))


@query("j02_insert_if_absent", with_views(f"select source, part_number, stock from {OLD} union all select source, part_number, new_stock from {NEW} n where pk % 2 <> 0", "offers"))
def j02(spark: SparkSession, d: str) -> DataFrame:
    rows = offers(spark, d)
    old = old_state(rows).select(*KEY, "stock")
    return old.union(new_state(rows).join(old, KEY, "left_anti").select(*KEY, "new_stock"))


@query("j03_update_existing", with_views(f"select source, part_number, coalesce(n.new_stock, o.stock) stock from {OLD} o left join {NEW} n using (source, part_number)", "offers"))
def j03(spark: SparkSession, d: str) -> DataFrame:
    rows = offers(spark, d)
    return old_state(rows).join(new_state(rows), KEY, "left").select(*KEY, F.coalesce("new_stock", "stock").alias("stock"))


@query("j04_soft_delete", with_views(f"select source, part_number, n.new_stock is not null and o.stock > 0 in_stock, description from {OLD} o left join {NEW} n using (source, part_number)".replace("description", "o.description"), "offers"))
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the new answer lacks are sold out; what is known of them stays."""
    rows = offers(spark, d)
    joined = old_state(rows).join(new_state(rows), KEY, "left")
    return joined.select(*KEY, (F.col("new_stock").isNotNull() & (F.col("stock") > 0)).alias("in_stock"), "description")


@query("j05_fresh", "select event_id, ts >= timestamp '2024-01-15' - case when value < 5 then interval 1 day else interval 7 day end fresh from events")
def j05(spark: SparkSession, d: str) -> DataFrame:
    """Empty answers, here values under 5, age faster."""
    ttl = F.when(F.col("value") < 5, F.expr("interval 1 day")).otherwise(F.expr("interval 7 day"))
    return table(spark, d, "events").select("event_id", (F.col("ts").cast("timestamp_ntz") >= _ts("2024-01-15") - ttl).alias("fresh"))


@query("j06_retention", with_views(f"select source, part_number from offers join (values {', '.join(f'({chr(39)}{s}{chr(39)}, {n if n else chr(110) + chr(117) + chr(108) + chr(108)})' for s, n in RETENTION)}) r(source, days) using (source) where days is null or fetched_at >= timestamp '{AS_OF}' - days * interval 1 day", "offers"))
def j06(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(list(RETENTION), "source string, days int")
    age = F.datediff(_ts(AS_OF), F.col("fetched_at"))
    return offers(spark, d).join(rules, "source").where(F.col("days").isNull() | (age <= F.col("days"))).select(*KEY)


@query("j07_incremental_reindex", with_views("select source, part_number, lower(description) search_text, coalesce(pk % 2 = 0 and extractor_version >= 2, false) kept from offers", "offers"))
def j07(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are missing or of an old version are extracted anew, the others are taken as they are."""
    rows = offers(spark, d)
    index = old_state(rows).select(*KEY, F.lower("description").alias("old_text"), (F.col("extractor_version") >= 2).alias("current"))
    joined = rows.join(index, KEY, "left")
    kept = F.coalesce("current", F.lit(False))
    return joined.select(*KEY, F.when(kept, F.col("old_text")).otherwise(F.lower("description")).alias("search_text"), kept.alias("kept"))


@query("j08_completeness_gate", with_views("select source, count(case when (pk % 2 = 0 or source = 'S1') and extractor_version >= 1 then 1 end) >= count(*) complete from offers group by source", "offers"))
def j08(spark: SparkSession, d: str) -> DataFrame:
    """A source may answer alone if every cached row is in the index, as the extractor's version now makes it."""
    rows = offers(spark, d)
    return coverage(rows, rows.where("pk % 2 = 0 or source = 'S1'"), 1).select("source", (F.col("current_rows") >= F.col("cached")).alias("complete"))


@query("j09_rederived_rows", "select event_id, upper(event_type) kind from events where upper(event_type) <> event_type and event_type <> 'view'")
def j09(spark: SparkSession, d: str) -> DataFrame:
    """Only rows of which the derived column changes."""
    derived = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.upper("event_type"))
    return table(spark, d, "events").withColumn("kind", derived).where(~F.col("kind").eqNullSafe(F.col("event_type"))).select("event_id", "kind")


@query("j10_backfill_hash", with_views("select source, part_number, case when pk % 4 = 0 then 'kept' else md5(description) end h from offers", "offers"))
def j10(spark: SparkSession, d: str) -> DataFrame:
    held = F.when(F.col("pk") % 4 == 0, "kept")
    return offers(spark, d).select(*KEY, F.coalesce(held, F.md5("description")).alias("h"))


_TOP = "(select request_id, source, part_number, stock, row_number() over (partition by request_id order by unit_price, source, part_number) nth from candidates)"


@query("j11_stock_updates", with_views(f"select request_id, source, part_number, cast(row_number() over (partition by request_id order by nth) as int) place from {_TOP} where not (cast(split_part(part_number, '-', 2) as int) % 4 = 0 and nth <= 3) qualify row_number() over (partition by request_id order by nth) <= 3", "requests", "offers", "candidates"))
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Rows about to be shown are refreshed; sold out ones go and the next ones move up."""
    own = Window.partitionBy("request_id")

    def refreshed(found: DataFrame) -> DataFrame:
        top = found.select("request_id", *KEY, "sk", F.row_number().over(own.orderBy("unit_price", *KEY)).alias("nth"))
        updates = top.where("nth <= 3 and sk % 4 = 0").select("request_id", *KEY, F.lit(True).alias("sold_out"))
        left = top.join(updates, ["request_id", *KEY], "left").where("sold_out is null")
        return left.select("request_id", *KEY, F.row_number().over(own.orderBy("nth")).alias("place")).where("place <= 3")

    return judged_candidates(spark, d, refreshed)


@query("j12_due_list", with_views("select distinct source, part_number from (select source, part_number, fetched_at, row_number() over (partition by request_id order by unit_price, source, part_number) nth from candidates) where nth <= 5 and fetched_at < timestamp '2001-06-01' - interval 1 day", "requests", "offers", "candidates"))
def j12(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("unit_price", *KEY))
    found = candidate_join(alike(requests(spark, d))[0], offers(spark, d).hint("rebalance"), MARGIN)
    return found.select(*KEY, "fetched_at", nth.alias("nth")).where((F.col("nth") <= 5) & (F.col("fetched_at") < _ts("2001-05-31"))).select(*KEY).distinct()


@query("j13_cache_decision", with_views("select request_id, case when n is null then 'miss' when oldest < timestamp '1998-06-01' then 'stale' when n < 50 then 'partial' else 'hit' end decision from requests left join (select request_id, count(*) n, min(fetched_at) oldest from candidates where request_id in (select o_custkey from orders) group by 1) using (request_id)", "requests", "offers", "candidates"))
def j13(spark: SparkSession, d: str) -> DataFrame:
    """Lists are there for customers that have ordered before."""
    ordered = table(spark, d, "orders").select(F.col("o_custkey").alias("request_id")).distinct()
    lists = judged_candidates(spark, d, lambda found: found.groupBy("request_id").agg(F.count("*").alias("n"), F.min("fetched_at").alias("oldest"))).join(ordered, "request_id", "left_semi")
    decision = F.when(F.col("n").isNull(), "miss").when(F.col("oldest") < _ts("1998-06-01"), "stale").when(F.col("n") < 50, "partial").otherwise("hit")
    return requests(spark, d).join(lists, "request_id", "left").select("request_id", decision.alias("decision"))


@query("j14_journal_from_history", with_views("select request_id, step, lower(concat_ws(' ', family, case when step < 1 then want_colour end)) phrase from requests, (values (0), (1)) v(step) where request_id % 5 <> 0", "requests"))
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Each request with its ladder of phrases, unless the journal has it."""
    rows = requests(spark, d)
    known = rows.where("request_id % 5 = 0").select("request_id")
    steps = rows.select("request_id", "family", "want_colour", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    phrase = F.lower(F.concat_ws(" ", "family", F.when(F.col("step") < 1, F.col("want_colour"))))
    return steps.join(known, "request_id", "left_anti").select("request_id", "step", phrase.alias("phrase"))


@query("j15_append_and_merge", "select user_id, cast(count(*) as bigint) n_parts, max(case when event_type = 'error' then value end) last_error from events group by user_id")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Arrays are appended and maps merged, the later value winning."""
    by = table(spark, d, "events").groupBy("user_id")
    halves = by.agg(F.collect_list(F.when(F.col("value") < 5, F.col("event_id"))).alias("a"), F.collect_list(F.when((F.col("value") >= 5) | F.col("value").isNull(), F.col("event_id"))).alias("b"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("m"))
    merged = F.map_from_entries(F.filter(F.array(F.struct(F.lit("error").alias("k"), F.col("m").alias("v"))), lambda e: e.v.isNotNull()))
    return halves.select("user_id", F.size(F.concat("a", "b")).cast("long").alias("n_parts"), F.try_element_at(merged, F.lit("error")).alias("last_error"))


_COUNTS = "(select event_type, user_id % 10 u, count(*) n from events where {} group by 1, 2)"


def _counters(spark: SparkSession, d: str, where: str) -> DataFrame:
    return table(spark, d, "events").where(where).groupBy("event_type", (F.col("user_id") % 10).alias("u")).agg(F.count("*").alias("n"))


@query("j16_changed_counters", f"select a.event_type, a.u, greatest(a.n, coalesce(b.n, 0)) n from {_COUNTS.format('value < 50')} a left join {_COUNTS.format('value < 20')} b on a.event_type = b.event_type and a.u = b.u where a.n is distinct from b.n")
def j16(spark: SparkSession, d: str) -> DataFrame:
    now, saved = _counters(spark, d, "value < 50"), _counters(spark, d, "value < 20").withColumnRenamed("n", "saved")
    changed = now.join(saved, ["event_type", "u"], "left").where("not (n <=> saved)")
    return changed.select("event_type", "u", F.greatest("n", F.coalesce("saved", F.lit(0))).alias("n"))


@query("j17_restore_counters", f"select event_type, u, coalesce(a.n, 0) + coalesce(b.n, 0) n from {_COUNTS.format('value < 5')} a full join {_COUNTS.format('value >= 60')} b using (event_type, u)")
def j17(spark: SparkSession, d: str) -> DataFrame:
    stored, since = _counters(spark, d, "value < 5"), _counters(spark, d, "value >= 60").withColumnRenamed("n", "more")
    return stored.join(since, ["event_type", "u"], "full").select("event_type", "u", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))


@query("j18_bounded_transfers", f"select event_type, u, least(greatest(60 - before, 0), n) moved from (select *, cast(coalesce(sum(n) over (partition by event_type order by u rows between unbounded preceding and 1 preceding), 0) as bigint) before from {_COUNTS.format('true')})")
def j18(spark: SparkSession, d: str) -> DataFrame:
    """Counters are moved from a pool of 60 in order, never more than is left of it."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("event_type").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _counters(spark, d, "true").select("event_type", "u", F.least(F.greatest(F.lit(60) - before, F.lit(0)), F.col("n")).alias("moved"))


@query("j19_tag_migration", "select event_id, case when event_type = 'view' then 'type=page_view' else concat('type=', event_type) end tags from events")
def j19(spark: SparkSession, d: str) -> DataFrame:
    """Only tags of the old form are rewritten, so a second run changes nothing."""
    tags = F.concat(F.lit("type="), "event_type")
    once = F.when(tags == "type=view", "type=page_view").otherwise(tags)
    return table(spark, d, "events").select("event_id", F.when(once == "type=view", "type=page_view").otherwise(once).alias("tags"))


@query("j20_partial_refetch", with_views(f"select request_id, bool_and(cast(split_part(part_number, '-', 2) as int) % 5 <> 0) usable from {_TOP} where nth <= 3 group by 1", "requests", "offers", "candidates"))
def j20(spark: SparkSession, d: str) -> DataFrame:
    """A list of which one key can't be fetched is a miss as a whole."""
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("unit_price", *KEY))

    def lists_of(found: DataFrame) -> DataFrame:
        lists = found.select("request_id", *KEY, nth.alias("nth")).where("nth <= 3")
        here = offers(spark, d).where("sk % 5 <> 0").select(*KEY, F.lit(True).alias("here"))
        return lists.join(here, KEY, "left").groupBy("request_id").agg((F.count("here") == F.count("*")).alias("usable"))

    return judged_candidates(spark, d, lists_of)
