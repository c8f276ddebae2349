"""Sources and sinks of offers: flat and nested rows to one schema, nested evaluation sets, exports and reloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.bindings import evaluation, offers, table, with_views
from partloom.operators.matching import KEY
from partloom.registry import query
from partloom.sources.files import new_path, swap_generation


def blank_to_null(c: str):
    return F.nullif(F.trim(c), F.lit(""))


@query("a01_catalogue_scan", with_views("select part_number, source, manufacturer, description from offers where try_cast(cast(stock as varchar) as int) > 0", "offers"))
def a01(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where(F.col("stock").cast("string").try_cast("int") > 0).select("part_number", "source", "manufacturer", "description")


@query("a02_json_payload_scan", "select event_id, cast(json_extract_string(props, '$.k') as int) k from events where cast(json_extract_string(props, '$.k') as int) > 0")
def a02(spark: SparkSession, d: str) -> DataFrame:
    """Unreadable payloads and those that break the invariant are left out."""
    read = F.from_json("props", "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return table(spark, d, "events").select("event_id", read.alias("p")).where("p._bad is null and p.k > 0").select("event_id", F.col("p.k").alias("k"))


@query("a03_flat_rows", with_views("select part_number, source, concat(kind, ' / ', family) category, nullif(trim(case when pk % 6 = 0 then '  ' else colour end), '') colour, case when stock = 0 then null else stock end stock from offers", "offers"))
def a03(spark: SparkSession, d: str) -> DataFrame:
    flat = offers(spark, d).withColumn("raw", F.when(F.col("pk") % 6 == 0, "  ").otherwise(F.col("colour")))
    return flat.select("part_number", "source", F.concat_ws(" / ", "kind", "family").alias("category"), blank_to_null("raw").alias("colour"), F.when(F.col("stock") > 0, F.col("stock")).alias("stock"))


@query("a04_nested_source", "select p_partkey symbol, p_size stock, p_retailprice price, p_type t from part where p_partkey % 9 <> 0")
def a04(spark: SparkSession, d: str) -> DataFrame:
    """Products, prices and parameters as JSON documents of their own, read and joined by symbol; excluded statuses go."""
    part = table(spark, d, "part")
    key = F.col("p_partkey").alias("symbol")
    status = F.array(F.when(F.col("p_partkey") % 9 == 0, "WITHDRAWN").otherwise("ACTIVE")).alias("status")
    products = part.select(F.to_json(F.struct(key, status)).alias("j")).select(F.from_json("j", "symbol long, status array<string>").alias("x")).select("x.*")
    prices = part.select(F.to_json(F.struct(key, F.col("p_size").alias("stock"), F.array(F.struct(F.lit(1).alias("amount"), F.col("p_retailprice").alias("price"))).alias("elements"))).alias("j")).select(F.from_json("j", "symbol long, stock int, elements array<struct<amount int, price double>>").alias("x")).select("x.symbol", "x.stock", F.col("x.elements")[0]["price"].alias("price"))
    parameters = part.select(F.to_json(F.struct(key, F.array(F.struct(F.lit("type").alias("name"), F.col("p_type").alias("value"))).alias("parameters"))).alias("j")).select(F.from_json("j", "symbol long, parameters array<struct<name string, value string>>").alias("x"))
    parameters = parameters.select("x.symbol", F.map_from_entries("x.parameters")["type"].alias("t"))
    live = products.where(~F.arrays_overlap("status", F.array(F.lit("WITHDRAWN"), F.lit("INVALID"))))
    return live.select("symbol").join(prices, "symbol").join(parameters, "symbol")


@query("a05_attribute_list_source", "select p_partkey, p_brand brand, cast(p_size as varchar) size, round(p_retailprice, 2) price from part")
def a05(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("Brand").alias("name"), F.col("p_brand").alias("value")), F.struct(F.lit("Size").alias("name"), F.col("p_size").cast("string").alias("value")))
    raw = table(spark, d, "part").select("p_partkey", pairs.alias("attributes"), F.concat(F.lit("$"), F.format_number(F.round("p_retailprice", 2), 2)).alias("price"))
    named = F.map_from_entries(F.transform("attributes", lambda a: F.struct(F.lower(a["name"]), a["value"])))
    return raw.select("p_partkey", named["brand"].alias("brand"), named["size"].alias("size"), F.regexp_replace("price", "[^0-9.]", "").cast("double").alias("price"))


@query("a06_unified_sources", with_views("select source, part_number, case when source = 'S0' then colour end colour, case when source <> 'S0' then rating_v end rating_v from offers", "offers"))
def a06(spark: SparkSession, d: str) -> DataFrame:
    rows = offers(spark, d)
    return rows.where("source = 'S0'").select(*KEY, "colour").unionByName(rows.where("source <> 'S0'").select(*KEY, "rating_v"), allowMissingColumns=True)


@query("a07_nested_evaluation_set", with_views("select qid, cand_key, label from evaluation", "evaluation"))
def a07(spark: SparkSession, d: str) -> DataFrame:
    """Written as one JSON line for each query with its candidates, and read again as one row for each candidate."""
    path = new_path(spark, "evaluation")
    nested = evaluation(spark, d).groupBy("qid").agg(F.collect_list(F.struct("cand_key", "label")).alias("candidates"))
    nested.write.json(path)
    read = spark.read.schema("qid long, candidates array<struct<cand_key string, label int>>").json(path)
    return read.select("qid", F.explode("candidates").alias("c")).select("qid", "c.cand_key", "c.label")


@query("a08_report_sink", with_views("select category, count(*) n from evaluation group by category", "evaluation"))
def a08(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "report")
    evaluation(spark, d).groupBy("category").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("category string, n long").json(path)


@query("a09_export_by_key_range", with_views("select part_number, source, stock from offers", "offers"))
def a09(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "export")
    offers(spark, d).select("part_number", "source", "stock").repartitionByRange("part_number").write.option("header", True).csv(path)
    return spark.read.schema("part_number string, source string, stock long").option("header", True).csv(path)


@query("a10_generation_swap", with_views("select part_number, source, stock + 1 stock from offers", "offers"))
def a10(spark: SparkSession, d: str) -> DataFrame:
    base, rows = new_path(spark, "generations"), offers(spark, d).select("part_number", "source", "stock")
    first = swap_generation(rows, base, 1)
    return swap_generation(first.withColumn("stock", F.col("stock") + 1), base, 2)
