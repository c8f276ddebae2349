"""Availability and lifecycle by hand: severities, notes, null and blank values, stale offers."""

import datetime

from pyspark.sql import functions as F

from partloom.functions.availability import availability, lifecycle, stale


def test_by_hand(spark):
    cases = [
        # stock, quantity, flags, text, most, full -> lifecycle, status, note
        ((0, 1, ["ONLY_FOR_SPECIAL_ORDER"], None, None, True), ("active", "out_of_stock", "Out of stock.")),
        ((-3, 0, None, None, None, False), ("active", "out_of_stock", "Out of stock.")),
        ((100, 1, None, None, None, False), ("active", "in_stock", "Ships now.")),
        ((100, 1, [], "  ", 0, True), ("active", "in_stock", "Ships now.")),
        ((10, 5, [], None, None, False), ("active", "in_stock", "Ships now.")),
        ((9, 1, [], None, None, False), ("active", "low_stock", "Only 9 in stock.")),
        ((99, 50, [], None, None, False), ("active", "low_stock", "Only 99 in stock, less than twice the 50 asked for.")),
        ((49, 50, [], None, None, False), ("active", "limited", "Only 49 in stock, 50 are asked for.")),
        ((49, 50, ["EXTERNAL_WAREHOUSE", "ONLY_FOR_SPECIAL_ORDER"], None, None, False), ("active", "special_order", "Only 49 in stock, 50 are asked for. By special order only. Comes from another warehouse, and later.")),
        ((100, 1, ["AVAILABLE_WHILE_STOCKS_LAST", "HARDLY_AVAILABLE", "NEW"], None, None, False), ("last_time_buy", "last_units", "No new stock will come. Scarce on the market.")),
        ((100, 1, ["HARDLY_AVAILABLE", "NEW"], None, None, True), ("supply_constrained", "in_stock", "Ships now. Scarce on the market. New in the catalogue.")),
        ((100, 1, ["DANGEROUS", "OVERSIZED", "UNKNOWN"], None, None, True), ("active", "in_stock", "Ships now. Restricted shipping: dangerous goods.")),
        ((100, 1, ["OVERSIZED"], None, None, True), ("active", "in_stock", "Ships now. Restricted shipping: oversized.")),
        ((100, 1, [], " NRND ", None, False), ("last_time_buy", "last_units", "Status: NRND.")),
        ((100, 1, [], "New Product", None, False), ("new", "in_stock", "Ships now.")),
        ((100, 1, [], "New Product", 5, True), ("new", "in_stock", "Ships now. Status: New Product. At most 5 an order.")),
        ((100, 6, [], None, 5, False), ("active", "in_stock", "Ships now. At most 5 an order.")),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, stock long, quantity long, flags array<string>, text string, most long, full boolean").cache()
    told = availability(*map(F.col, ("stock", "quantity", "flags", "text", "most", "full")))
    got = {r.i: (r.life, r.status, r.note) for r in rows.select("i", lifecycle(F.col("flags"), F.col("text")).alias("life"), told.alias("t")).select("i", "life", "t.*").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_stale(spark):
    now, day = datetime.datetime(2024, 3, 1), datetime.timedelta(days=1)
    cases = [(0, "Ships now.", now - day), (1, "Ships now. Promoted.", now - 2 * day - day / 2), (2, "Only 9 in stock.", None), (3, None, now)]
    rows = spark.createDataFrame([(i, 9, ("x", n), at) for i, n, at in cases], "i int, stock long, current struct<status: string, note: string>, at timestamp_ntz")
    got = {r.i: r.t.note for r in rows.select("i", stale(F.col("current"), F.col("stock"), F.col("at"), F.lit(now).cast("timestamp_ntz")).alias("t")).collect()}
    assert got == {0: "Last confirmed on 2024-02-29 (1 day ago); last known stock: 9.", 1: "Last confirmed on 2024-02-27 (2 days ago); last known stock: 9. Promoted.", 2: "Last confirmed; last known stock: 9. Only 9 in stock.", 3: "Last confirmed on 2024-03-01 (0 days ago); last known stock: 9."}
