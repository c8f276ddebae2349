"""Column functions on cases written by hand."""

import hashlib

from pyspark.sql import functions as F

from partloom.functions import extraction, text_keys, vocabularies


def told(spark, f, cases, kind="string"):
    rows = spark.createDataFrame(list(enumerate(cases)), f"n int, x {kind}")
    return [r.y for r in rows.select("n", f(F.col("x")).alias("y")).orderBy("n").collect()]


def test_code_keys(spark):
    same = [["SOT-23-3", "sot-23-3L", "SOT-23", "TO-236AB", "SC-59"], ["SO-8", "SOP-8", "SOIC-8", "SOIC-8_150mil", "sop-8-EP"], ["DPAK", "TO-252", "TO-252-3L"], ["SMA", "DO-214AC"], ["PDIP-14", "DIP-14"], ["0603"], ["QFN-16"], ["TSSOP-16"]]
    keys = [set(told(spark, text_keys.code_key, group)) for group in same]
    assert all(len(k) == 1 for k in keys) and len(set.union(*keys)) == len(same)
    assert told(spark, text_keys.code_key, [None, "", "  "]) == [None] * 3


def test_display_is_read_back(spark):
    values = [0.0, 4.7e-9, 1e-6, 0.047, 2.2, 999.0, 1000.0, 4.7e6, 1e10, None]
    assert told(spark, lambda v: extraction.display(v, "F"), values, "double") == ["0F", "4.7nF", "1uF", "47mF", "2.2F", "999F", "1kF", "4.7MF", "10GF", None]
    back = told(spark, lambda v: F.round(extraction.si_value(extraction.display(v, "F"), "F"), 12), values, "double")
    assert all(a == b or abs(a - b) < 1e-9 * a for a, b in zip(values, back))
    assert told(spark, lambda v: extraction.display(v, "ohm", F.when(v > 0, "100MHz")), [120.0, 0.0, 1.5e3], "double") == ["120ohm @100MHz", "0ohm", "1.5kohm @100MHz"]


def test_canonical_hash(spark):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    same = ['{"size":1.5,"type":"é","brand":{"z":[1,{"b":null,"a":2}],"y":true}}', ' { "other": 1, "brand": {"y": true, "z": [1.0, {"a": 2.00, "b": null}]}, "type": "\\u00e9", "size": 1.50 } ']
    assert set(told(spark, extraction.canonical_hash, same)) == {md5('{"brand":{"y":true,"z":[1,{"a":2,"b":null}]},"size":1.5,"type":"é"}')}
    lacks = ["{}", '{"brand":null}', '{"other":3}']
    assert set(told(spark, extraction.canonical_hash, lacks)) == {md5('{"brand":null,"size":null,"type":null}')}
    whole = ["[1]", "3", "{", "", '"{}"', None]
    assert told(spark, extraction.canonical_hash, whole) == ["x" + md5(t or "")[1:] for t in whole]


def test_words_of_a_request(spark):
    text = "At least 50V, red 4.7uF with 100kohm for the PROMO Brand#7 x5R old"
    row = spark.createDataFrame([(text,)], "x string").select(text_keys.tokens(F.col("x")).alias("w"))
    got = row.select(*(v.alias(k) for k, v in extraction.typed_values(F.col("w")).items()), extraction.left_over(F.col("w")).alias("rest"), extraction.class_in(F.col("w")).alias("class")).first()
    assert (got["size"], got.rating, got.resistance, got.frequency, got.colour, got.family) == (4.7, 50.0, 1e5, None, "red", "PROMO")
    assert got.rest == ["Brand#7", "x5R"] and got["class"] == "coloured"
    assert told(spark, lambda x: extraction.class_in(text_keys.tokens(x)), ["old red ring", "old gear", "none", "", None]) == ["fastener", "drive", None, None, None]


def test_smallest_brackets(spark):
    rows = [[(100, 0.7), (1, 1.0), (10, 0.9), (5, 0.95), (1, 0.8)], [(5, 1.0)], []]
    got = told(spark, extraction.smallest_brackets, rows, "array<struct<quantity:int,price:double>>")
    assert [[tuple(b) for b in g] for g in got] == [[(1, 0.8), (5, 0.95), (10, 0.9)], [(5, 1.0)], []]


def test_class_grades(spark):
    cases = [("SMALL", "MEDIUM", "SMALL", "MEDIUM", False), ("MEDIUM", None, "SMALL", "MEDIUM", False), ("SMALL", "MEDIUM", "MEDIUM", None, False), ("SMALL", "MEDIUM", "LARGE", "MEDIUM", True), ("SMALL", "MEDIUM", None, None, True), ("SMALL", "MEDIUM", None, None, False), ("MEDIUM", None, "STANDARD", None, False)]
    rows = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, w string, wp string, a string, ap string, m boolean")
    grade = vocabularies.class_grade(*(F.col(c) for c in ("w", "wp", "a", "ap", "m")))
    assert [r.g for r in rows.select("n", grade.alias("g")).orderBy("n").collect()] == [1, 1, 0, -1, 1, 0, -1]


def test_tolerances_powers_heat_and_ranges(spark):
    texts = ["±5% 1/8W 105C", "± 0.5% 2W -40°C", "1/0W 5CC R5C", "", None]
    assert told(spark, extraction.tolerance_percent, texts) == [5.0, 0.5, None, None, None]
    assert told(spark, extraction.watts, texts) == [0.125, 2.0, None, None, None]
    assert told(spark, extraction.celsius, texts) == [105.0, -40.0, None, None, None]
    spans = told(spark, lambda c: extraction.range_of(c, "nm"), ["620~630nm", "5nm", "x", None])
    assert [tuple(x) for x in spans] == [(620.0, 625.0, 630.0), (5.0, 5.0, 5.0), (None, None, None), (None, None, None)]


def test_hours_henry_and_temperatures_by_hand(spark):
    from pyspark.sql import functions as F

    from partloom.functions.extraction import hours_or_henry, temperature

    cases = {("2000h", None): (2000.0, None), ("2000hrs", True): (2000.0, None), ("2000Hours", None): (2000.0, None), ("3000H", False): (3000.0, None), ("99H", False): (None, 99.0), ("3000H", None): (None, 3000.0), ("3000H", True): (None, 3000.0), ("10uH", False): (None, 1e-5), ("10uh", False): (None, 1e-5), ("2.5mH", None): (None, 0.0025), ("H", None): (None, None), ("10V", None): (None, None), ("", None): (None, None), (None, None): (None, None)}
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, token string, inductive boolean")
    got = {r.i: (r.v.hours, r.v.henry and round(r.v.henry, 9)) for r in rows.select("i", hours_or_henry(F.col("token"), F.col("inductive")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    warm = {"105C": 105.0, "69C": None, "70C": 70.0, "201C": None, "25°C": 25.0, "+125°C": 125.0, "85°": 85.0, "C": None, None: None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(warm)], "i int, token string")
    assert [r.c for r in rows.orderBy("i").select(temperature(F.col("token")).alias("c")).collect()] == list(warm.values())


def test_class_of_two_by_hand(spark):
    from pyspark.sql import functions as F

    from partloom.functions.vocabularies import class_of_two

    # category, named, parent of named, all classes of the category -> class
    cases = [("a", None, None, ["a"], "a"), (None, "b", None, [], "b"), (None, None, None, None, None), ("a", "b", "a", ["a"], "b"), ("a", "b", "c", ["a"], "a"), ("a", "o", None, ["a"], "o"), ("o", "a", None, ["o"], "o"), ("x", "y", None, ["x"], "x"), ("x", "y", None, ["y", "x", "z"], "y"), ("x", "y", None, None, "x"), ("x", "z", None, ["x", "y"], "x")]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, category string, named string, parent string, categories array<string>")
    got = rows.orderBy("i").select(class_of_two(F.col("category"), F.col("named"), F.col("parent"), (("o", "a"),), (("x", "y"),), F.col("categories")).alias("c")).collect()
    assert [r.c for r in got] == [c[4] for c in cases]


def test_typed_rows_are_read_once_a_part(spark, small):
    """What reads a description stands below the join with the offers, and the texts of parts are those of their offers."""
    from partloom.bindings import PART_TEXTS, offers, offers_read_by_part
    from partloom.catalogue import QUERIES
    from pyspark.sql import functions as F

    plan = QUERIES["b25_typed_row"](spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(n for n, line in enumerate(plan) if "split(" in line) > next(n for n, line in enumerate(plan) if "Join Inner" in line)
    both = offers_read_by_part(spark, small, {k: F.col(k) for k in PART_TEXTS})
    assert both.count() == offers(spark, small).count()
    assert both.where(" or ".join(f"not (read.{k} <=> {k})" for k in PART_TEXTS)).count() == 0
