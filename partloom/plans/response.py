"""From a table of requests to ranked, accounted responses in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.bindings import alike, for_each_request, offers, requests
from partloom.operators.assessment import ORDER_SQL, assessed_sql
from partloom.operators.checks import VERDICT_SQL, verdict
from partloom.operators.matching import KEY
from partloom.plans.best_offers import best_offers
from partloom.registry import query

_CONFLICT = "(s_size = 'conflict' or coalesce(s_rating, '') = 'conflict' or coalesce(s_colour, '') = 'conflict')"


@query("top_offers", assessed_sql(f"""
select request_id, nth, source, part_number, round(grade, 6) grade, {VERDICT_SQL} verdict, left_out from (
select *, cast(row_number() over (partition by request_id order by {_CONFLICT}, {ORDER_SQL}) as int) nth,
count(case when {_CONFLICT} then 1 end) over (partition by request_id) left_out from assessed) where not {_CONFLICT} and nth <= max_results"""))
def top_offers(spark: SparkSession, d: str) -> DataFrame:
    """Each request's best offers with grade and verdict, and how many candidates conflict with it."""
    heads, members = alike(requests(spark, d))
    return for_each_request(best_offers(heads, offers(spark, d)).select("request_id", "nth", *KEY, F.round("grade", 6).alias("grade"), verdict().alias("verdict"), "left_out"), members)
