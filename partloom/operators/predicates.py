"""Predicates that keep what an offer doesn't state: null never means no."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.bindings import offers, requests, table, with_views
from partloom.registry import query


def in_range(c: Column, low, high) -> Column:
    return c.isNull() | c.between(low, high)


def at_least(c: Column, least, rating: bool = False) -> Column:
    """A rating of 0 or less counts as unstated."""
    kept = c.isNull() | (c >= least)
    return kept | (c <= 0) if rating else kept


def at_most(c: Column, most) -> Column:
    return c.isNull() | (c <= most)


def equal(c: Column, value) -> Column:
    return c.isNull() | (c == value)


def one_of(c: Column, values: list) -> Column:
    return c.isNull() | c.isin(values)


def none_of(c: Column, values: list) -> Column:
    return c.isNull() | ~c.isin(values)


def any_in_range(array: Column, low, high) -> Column:
    """An element lies in the range, or there are none."""
    return array.isNull() | (F.size(array) == 0) | F.exists(array, lambda x: x.between(low, high))


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return reduce(Column.__or__, [c.startswith(p) for p in prefixes], F.lit(False))


def slack_bounds(value: Column, slack: Column, margin: Column) -> tuple[Column, Column]:
    """Bounds widened by a relative slack, an absolute margin and the rounding of stored values."""
    wide = F.abs(value) * (slack + F.lit(1e-8)) + margin
    return value - wide, value + wide


def stated(columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


_KEY = ("source", "part_number")


def _offers(sql: str, *columns: str) -> str:
    return with_views(f"select source, part_number{''.join(', ' + c for c in columns)} from offers where {sql}", "offers")


@query("c01_source_in_stock", _offers("source = 'S1' and stock > 0", "stock"))
def c01(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where((F.col("source") == "S1") & (F.col("stock") > 0)).select(*_KEY, "stock")


@query("c02_range_keep_unstated", _offers("size_v is null or size_v between 10 and 14", "size_v"))
def c02(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where(in_range(F.col("size_v"), 10, 14)).select(*_KEY, "size_v")


@query("c03_minimum_rating", _offers("rating_v is null or rating_v >= 35 or rating_v <= 0", "rating_v"))
def c03(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where(at_least(F.col("rating_v"), 35, rating=True)).select(*_KEY, "rating_v")


@query("c04_maximum", _offers("rating_v is null or rating_v <= 20", "rating_v"))
def c04(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where(at_most(F.col("rating_v"), 20)).select(*_KEY, "rating_v")


@query("c05_equal_column_or_key", with_views("select o.source, o.part_number, e.event_id from offers o join events e on e.event_id = o.pk where (o.colour is null or o.colour = 'red') and (json_extract_string(e.props, '$.k') is null or json_extract_string(e.props, '$.k') = '7')", "offers"))
def c05(spark: SparkSession, d: str) -> DataFrame:
    joined = offers(spark, d).join(table(spark, d, "events"), F.col("event_id") == F.col("pk"))
    return joined.where(equal(F.col("colour"), "red") & equal(F.get_json_object("props", "$.k"), "7")).select(*_KEY, "event_id")


@query("c06_closed_vocabulary", _offers("colour is null or colour in ('red', 'blue')", "colour"))
def c06(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where(one_of(F.col("colour"), ["red", "blue"])).select(*_KEY, "colour")


@query("c07_open_vocabulary", _offers("colour is null or colour not in ('red', 'blue')", "colour"))
def c07(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where(none_of(F.col("colour"), ["red", "blue"])).select(*_KEY, "colour")


@query("c08_array_any_in_range", "select vec_id from embeddings where embedding is null or len(embedding) = 0 or len(list_filter(embedding, lambda x: x between 0.30 and 0.31)) > 0")
def c08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(any_in_range(F.col("embedding"), F.lit(0.30), F.lit(0.31))).select("vec_id")


@query("c10_must_not_state", _offers("colour is null"))
def c10(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where(F.col("colour").isNull()).select(*_KEY)


@query("c11_word_or_substring", "select doc_id from documents where contains(concat(' ', lower(text), ' '), ' of the ') or contains(text, '100%_')")
def c11(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").where(F.concat(F.lit(" "), F.lower(text), F.lit(" ")).contains(" of the ") | text.contains("100%_")).select("doc_id")


@query("c12_identifier_prefixes", _offers("starts_with(mpn, 'Brand-1') or starts_with(mpn, 'Brand-22')", "mpn"))
def c12(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where(starts_with_any(F.col("mpn"), ["Brand-1", "Brand-22"])).select(*_KEY, "mpn")


@query("c13_slack_bounds", with_views("select request_id, round(want_size - (abs(want_size) * (0.05 + 1e-8) + 0.5), 6) low, round(want_size + (abs(want_size) * (0.05 + 1e-8) + 0.5), 6) high from requests", "requests"))
def c13(spark: SparkSession, d: str) -> DataFrame:
    low, high = slack_bounds(F.col("want_size"), F.lit(0.05), F.lit(0.5))
    return requests(spark, d).select("request_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("c16_confirmed", with_views("select source, part_number, size_v is not null and rating_v is not null and colour is not null confirmed from offers", "offers"))
def c16(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select(*_KEY, stated(["size_v", "rating_v", "colour"]).alias("confirmed"))


@query("c17_old_version_bypass", _offers("extractor_version < 2 or ((size_v is null or size_v between 10 and 14) and (colour is null or colour = 'red'))", "extractor_version"))
def c17(spark: SparkSession, d: str) -> DataFrame:
    fits = in_range(F.col("size_v"), 10, 14) & equal(F.col("colour"), "red")
    return offers(spark, d).where((F.col("extractor_version") < 2) | fits).select(*_KEY, "extractor_version")


@query("c18_states_constraint", with_views("select request_id, (case when min_rating is null then 0 else 1 end + case when want_colour is null then 0 else 1 end) n_stated, min_rating is not null or want_colour is not null selective from requests", "requests"))
def c18(spark: SparkSession, d: str) -> DataFrame:
    n = sum((F.col(c).isNotNull().cast("int") for c in ("min_rating", "want_colour")), F.lit(0))
    return requests(spark, d).select("request_id", n.alias("n_stated"), (n > 0).alias("selective"))
