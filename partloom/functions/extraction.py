"""Values, dimensions, prices and attributes out of texts and maps, as column expressions and joins with small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.bindings import offers, offers_read_by_part, requests, table, with_views
from partloom.functions.text_keys import CLASS_WORDS, normal_key, tokens
from partloom.operators.matching import KEY
from partloom.registry import query

#: Prefixes of units and their powers of ten; M is mega and m is milli.
PREFIXES = (("p", -12), ("n", -9), ("u", -6), ("m", -3), ("", 0), ("k", 3), ("M", 6), ("G", 9))
#: Units with the factor to their base unit.
UNITS = (("CFM", "m3/h", 1.699011), ("mmH2O", "Pa", 9.80665), ("gf", "N", 0.00980665), ("inch", "mm", 25.4), ("mil", "mm", 0.0254))
#: Attribute names that may state an attribute, first precedence first.
SOURCES = (("size", "capacity", 1), ("size", "value", 2), ("rating", "voltage", 1), ("rating", "v_max", 2))

#: Columns of a request or offer that a value's unit tells: unit, column, factor from the base unit to the column's.
TYPED = (("F", "size", 1e6), ("V", "rating", 1.0), ("Hz", "frequency", 1.0), ("ohm", "resistance", 1.0))
#: Words of requests that are values of a column, and those that say nothing.
WORD_COLUMNS = {"colour": ("red", "blue", "green", "old", "new", "cold", "hot"), "family": ("promo", "economy", "medium", "small", "standard", "large")}
SAYS_NOTHING = ("with", "at", "least", "a", "the", "for", "of")
#: The column that a request is mainly about is the first of these that it states.
PRIMARY = ("size", "resistance", "frequency", "rating", "family", "colour")
#: Fields of a payload that its hash covers, in this order.
HASHED = ("brand", "size", "type")
#: A lifetime is at least so many hours; prefixes of henry.
LIFETIME_HOURS = 100
HENRY_PREFIXES = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "k": 1e3}


def si_value(c: Column, unit: str) -> Column:
    """The value of a number with an SI prefix and a unit, in the base unit, case-sensitive; null for other texts."""
    number, prefix = F.regexp_extract(c, rf"^([0-9]+(?:\.[0-9]+)?)([pnumkMG]?){unit}$", 1), F.regexp_extract(c, rf"^([0-9]+(?:\.[0-9]+)?)([pnumkMG]?){unit}$", 2)
    powers = F.create_map(*[F.lit(x) for p, e in PREFIXES for x in (p, 10.0**e)])
    return F.when(number != "", number.cast("double") * powers[prefix])


def infix_value(c: Column) -> Column:
    """4k7, 2R2, 4u7: the letter stands for the point and the power."""
    parts = lambda i: F.regexp_extract(c, r"^([0-9]+)([pnumRkM])([0-9]+)$", i)
    powers = F.create_map(*[F.lit(x) for p, e in (*PREFIXES, ("R", 0)) for x in (p, 10.0**e)])
    return F.when(parts(2) != "", F.concat(parts(1), F.lit("."), parts(3)).cast("double") * powers[parts(2)])


def display(v: Column, unit: str, condition: Column | None = None) -> Column:
    """A value in base units with the largest prefix that leaves 1 or more, to three decimals without zeros at the end; behind
    it the condition that it was measured at, where there is one."""
    number = lambda x: F.regexp_replace(F.round(x, 3).cast("decimal(38,3)").cast("string"), r"\.?0+$", "")
    scaled = lambda prefix, power: F.concat(number(v / 10.0**power), F.lit(f"{prefix}{unit}"))
    shown = scaled(*PREFIXES[0])
    for prefix, power in PREFIXES[1:]:
        shown = F.when(F.abs(v) >= 10.0**power, scaled(prefix, power)).otherwise(shown)
    shown = F.when(v == 0, f"0{unit}").otherwise(shown)
    return shown if condition is None else F.concat(shown, F.coalesce(F.concat(F.lit(" @"), condition), F.lit("")))


def first_value(words: Column, unit: str) -> Column:
    """The first word that is a value of the unit, in its base unit."""
    return F.get(F.filter(F.transform(words, lambda w: si_value(w, unit)), lambda v: v.isNotNull()), 0)


def first_word(words: Column, known: tuple[str, ...]) -> Column:
    return F.get(F.filter(words, lambda w: F.lower(w).isin(*known)), 0)


def typed_values(words: Column) -> dict[str, Column]:
    """For each declared column what the words state of it; null where they don't."""
    stated = {column: F.round(first_value(words, unit) * factor, 6) for unit, column, factor in TYPED}
    return stated | {column: first_word(words, known) for column, known in WORD_COLUMNS.items()}


def class_in(words: Column) -> Column:
    """The class of the word with the first priority, without a shuffle."""
    known = F.create_map(*[x for word, name, priority in CLASS_WORDS for x in (F.lit(word), F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("class")))])
    return F.array_min(F.transform(words, lambda w: F.try_element_at(known, w)))["class"]


def left_over(words: Column) -> Column:
    """Words that are neither values, words of a column nor empty talk."""
    value = rf"^[0-9]+(\.[0-9]+)?[pnumkMG]?({'|'.join(u for u, _, _ in TYPED)})$"
    return F.filter(words, lambda w: ~w.rlike(value) & ~F.lower(w).isin(*SAYS_NOTHING, *(x for known in WORD_COLUMNS.values() for x in known)))


def canonical_hash(payload: Column, fields: tuple[str, ...] = HASHED) -> Column:
    """md5 of the named fields of a JSON object: keys sorted at all depths, 1.50 as 1.5, a missing field as null; other fields
    don't count. What is no JSON object hashes as a whole, marked by a leading x. Numbers with exponents keep a point."""
    parsed = F.try_parse_json(payload)
    listed = [F.concat(F.lit(f'"{f}":'), F.coalesce(F.to_json(F.try_variant_get(parsed, f"$.{f}", "variant")), F.lit("null"))) for f in fields]
    readable = F.md5(F.concat(F.lit("{"), F.concat_ws(",", *listed), F.lit("}")))
    whole = F.concat(F.lit("x"), F.substring(F.md5(F.coalesce(payload, F.lit(""))), 2, 31))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), readable).otherwise(whole)


def round_digits(v: Column, digits: int = 9) -> Column:
    """Rounded to so many significant digits, halves up; null and 0 stay."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(v))))
    return F.when(v.isNull() | (v == 0), v).otherwise(F.floor(v * scale + 0.5) / scale)


def tolerance_percent(text: Column) -> Column:
    """±5% as 5; null where the text has none."""
    return F.regexp_extract(text, r"± *([0-9]+(?:\.[0-9]+)?)%", 1).try_cast("double")


def watts(text: Column) -> Column:
    """1/8W as 0.125, 2W as 2: a fraction goes before a whole number."""
    part = lambda i: F.regexp_extract(text, r"\b([0-9]+)/([0-9]+)W\b", i).try_cast("double")
    whole = F.regexp_extract(text, r"(?<![/0-9.])([0-9]+(?:\.[0-9]+)?)W\b", 1).try_cast("double")
    return F.coalesce(part(1) / F.nullif(part(2), F.lit(0.0)), whole)


def celsius(text: Column) -> Column:
    """A temperature as 105C or 105°C; nothing else that ends in C."""
    return F.regexp_extract(text, r"(?<![A-Za-z0-9.])(-?[0-9]+)°?C\b", 1).try_cast("double")


def temperature(token: Column) -> Column:
    """105°C and 105° as they stand; 105C only from 70 to 200, as a smaller or larger number before a bare C is no temperature."""
    marked = F.regexp_extract(token, r"^[+]?([0-9]{1,3}(?:\.[0-9]+)?)°[cC]?$", 1).try_cast("double")
    bare = F.regexp_extract(token, r"^([0-9]{2,3})C$", 1).try_cast("double")
    return F.coalesce(marked, F.when(bare.between(70, 200), bare))


def hours_or_henry(token: Column, inductive: Column, least: float = LIFETIME_HOURS) -> Column:
    """hours and henry, of which one at most is stated. h, hr, hrs, hour and hours after a bare number are hours, all but h in any case; H is henry, but hours if
    the part's class is known not to be inductive and the number is at least ``least``; with a prefix both h and H are henry.
    ``inductive`` is null where the class isn't known."""
    number = lambda pattern: F.regexp_extract(token, pattern, 1).try_cast("double")
    small, bare, scaled = number(r"^([0-9]+(?:\.[0-9]+)?)(?:h|(?i:hrs?|hours?))$"), number(r"^([0-9]+(?:\.[0-9]+)?)H$"), number(r"^([0-9]+(?:\.[0-9]+)?)[pnuµmk][hH]$")
    lifetime = F.coalesce(~inductive, F.lit(False)) & (bare >= least)
    factor = F.create_map(*[F.lit(x) for p in HENRY_PREFIXES.items() for x in p])
    henry = F.coalesce(scaled * F.try_element_at(factor, F.regexp_extract(token, "([pnuµmk])[hH]$", 1)), F.when(~lifetime, bare))
    return F.struct(F.coalesce(small, F.when(lifetime, bare)).alias("hours"), henry.alias("henry"))


def range_of(text: Column, unit: str) -> Column:
    """low~high of a unit as low, centre and high; one value is all three."""
    end = lambda i: F.regexp_extract(text, rf"^([0-9.]+)(?:[~-]([0-9.]+))?{unit}$", i).try_cast("double")
    low, high = end(1), F.coalesce(end(2), end(1))
    return F.struct(low.alias("low"), ((low + high) / 2).alias("centre"), high.alias("high"))


def price_brackets(raw: Column) -> Column:
    """1-199:0.013,200-:0.01 as sorted brackets (quantity, price); malformed ones go, the first of a quantity stays.

    A fold over what was read: an expression that names the list again, for each of its brackets, reads all of it again."""
    bracket = r"^\s*([0-9]+)(?:-[0-9]*)?:([0-9.]+)\s*$"
    read = lambda p, i: F.regexp_extract(p, bracket, i)
    parts = F.transform(F.split(raw, ","), lambda p: F.struct(read(p, 1).try_cast("int").alias("quantity"), read(p, 2).try_cast("double").alias("price")))
    none = F.array().cast("array<struct<quantity:int,price:double>>")
    unread = lambda p: p.quantity.isNull() | p.price.isNull()
    first = F.aggregate(parts, none, lambda held, p: F.when(unread(p) | F.exists(held, lambda h: h.quantity == p.quantity), held).otherwise(F.array_append(held, p)))
    return F.array_sort(first)


def brackets_of(price: Column) -> Column:
    return F.array(*[F.struct(F.lit(q).alias("quantity"), (price * f).alias("price")) for q, f in ((1, 1.0), (10, 0.9), (100, 0.8))])


def order_quantity(quantity: Column, moq: Column, multiple: Column) -> Column:
    """At least the minimum, rounded up to the multiple."""
    return (F.ceil(F.greatest(quantity, moq) / multiple) * multiple).cast("int")


def bracket_price(brackets: Column, quantity: Column) -> Column:
    """The price of the last bracket that the quantity reaches."""
    return F.element_at(F.filter(brackets, lambda b: b.quantity <= quantity), -1).price


def dimensions(c: Column) -> Column:
    """LxWxH as length, width, height; DxL as diameter and length; null otherwise."""
    box = lambda i: F.regexp_extract(c, r"^([0-9.]+)x([0-9.]+)x([0-9.]+)mm$", i).try_cast("double")
    can = lambda i: F.regexp_extract(c, r"^D([0-9.]+)xL([0-9.]+)mm$", i).try_cast("double")
    return F.struct(F.least(box(1), box(2)).alias("short_side"), F.greatest(box(1), box(2)).alias("long_side"), box(3).alias("height"), can(1).alias("diameter"), can(2).alias("length"))


def resolve_attributes(rows: DataFrame, keys: list[str], attributes: str) -> DataFrame:
    """Of a map of attributes, for each declared attribute the value under the name of first precedence."""
    declared = rows.sparkSession.createDataFrame(list(SOURCES), "attribute string, name string, precedence int")
    stated = rows.select(*keys, F.explode(attributes).alias("name", "value")).where("value is not null").join(declared, "name")
    nth = F.row_number().over(Window.partitionBy(*keys, "attribute").orderBy("precedence"))
    return stated.withColumn("nth", nth).where("nth = 1").select(*keys, "attribute", "value")


@query("b04_si_values", with_views("select part_number, source, round(cast(regexp_extract(description, '([0-9]+)uF', 1) as double) * 1e-6, 12) farad, cast(regexp_extract(description, '([0-9]+)V', 1) as double) volt from offers", "offers"))
def b04(spark: SparkSession, d: str) -> DataFrame:
    words = tokens(F.col("description"))
    return offers(spark, d).select(*KEY, F.round(first_value(words, "F"), 12).alias("farad"), first_value(words, "V").alias("volt"))


@query("b05_infix_values", "select p_partkey, round((p_partkey % 10 + (p_partkey % 7) / 10.0) * case p_partkey % 3 when 0 then 1000 when 1 then 1 else 0.000001 end, 9)::double ohm from part")
def b05(spark: SparkSession, d: str) -> DataFrame:
    pk = F.col("p_partkey")
    letter = F.when(pk % 3 == 0, "k").when(pk % 3 == 1, "R").otherwise("u")
    text = F.concat((pk % 10).cast("string"), letter, (pk % 7).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.round(infix_value(text), 9).alias("ohm"))


@query("b06_tolerance", "select p_partkey, cast(p_partkey % 20 as double) percent, round(1.0 / (p_partkey % 8 + 1), 6)::double watt, cast(85 + p_partkey % 40 as double) celsius from part")
def b06(spark: SparkSession, d: str) -> DataFrame:
    """Tolerances in percent, powers as fractions of a watt, bare temperatures."""
    pk = F.col("p_partkey")
    text = F.concat(F.lit("±"), (pk % 20).cast("string"), F.lit("% 1/"), (pk % 8 + 1).cast("string"), F.lit("W "), (85 + pk % 40).cast("string"), F.lit("C"))
    return table(spark, d, "part").select("p_partkey", tolerance_percent(text).alias("percent"), F.round(watts(text), 6).alias("watt"), celsius(text).alias("celsius"))


_LIFE = "case p_partkey % 7 when 0 then 'h' when 1 then 'H' when 2 then 'hrs' when 3 then 'uH' when 4 then 'mh' when 5 then 'C' else '°C' end"
_INDUCTIVE = "case when p_type = 'SMALL' then true when p_type in ('MEDIUM', 'LARGE') then false end"


@query("b06_hours_or_henry", f"""
with t as (select p_partkey, p_partkey % 9 * 100 + p_size n, {_LIFE} unit, {_INDUCTIVE} inductive from part)
select p_partkey, cast(case when unit in ('h', 'hrs') or unit = 'H' and inductive is not null and not inductive and n >= {LIFETIME_HOURS} then n end as double) as hours,
       round(case when unit = 'uH' then n / 1e6 when unit = 'mh' then n / 1e3 when unit = 'H' and (inductive is null or inductive or n < {LIFETIME_HOURS}) then n end, 9)::double henry,
       cast(case when unit = '°C' and n < 1000 or unit = 'C' and n between 70 and 200 then n end as double) celsius from t""")
def b06_hours(spark: SparkSession, d: str) -> DataFrame:
    """A number with h or H is a lifetime or an inductance, by its letters and the part's class."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(f"concat(cast(p_partkey % 9 * 100 + p_size as string), {_LIFE})").alias("token"), F.expr(_INDUCTIVE).alias("inductive"))
    both = rows.withColumn("v", hours_or_henry(F.col("token"), F.col("inductive")))
    return both.select("p_partkey", "v.hours", F.round("v.henry", 9).alias("henry"), temperature(F.col("token")).alias("celsius"))


@query("b07_unit_factors", f"select p_partkey, u.base, round(p_size * u.factor, 6) as v from (select p_partkey, p_size, case p_partkey % 5 when 0 then 'CFM' when 1 then 'mmH2O' when 2 then 'gf' when 3 then 'inch' else 'mil' end unit from part) join (values {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)}, {c}::double)' for a, b, c in UNITS)}) u(unit, base, factor) using (unit)")
def b07(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(u) for u, _, _ in UNITS])
    sized = table(spark, d, "part").select("p_partkey", "p_size", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("unit"))
    return sized.join(spark.createDataFrame(list(UNITS), "unit string, base string, factor double"), "unit").select("p_partkey", "base", F.round(F.col("p_size") * F.col("factor"), 6).alias("v"))


_SHOWN = "case when v = 0 then '0ohm' " + " ".join(f"when v >= 1e{e} then concat(regexp_replace(cast(cast(round(v / 1e{e}, 3) as decimal(38, 3)) as varchar), '\\.?0+$', ''), '{p}ohm')" for p, e in reversed(PREFIXES)) + " end"


@query("b08_display", f"select p_partkey, concat({_SHOWN}, case when p_partkey % 4 = 0 then ' @100MHz' else '' end) shown from (select p_partkey, case when p_partkey % 50 = 0 then 0 else p_size * 47 * pow(10.0, p_partkey % 14 - 7) end v from part)")
def b08(spark: SparkSession, d: str) -> DataFrame:
    pk = F.col("p_partkey")
    v = F.when(pk % 50 == 0, 0.0).otherwise(F.col("p_size") * 47 * F.pow(F.lit(10.0), pk % 14 - 7))
    return table(spark, d, "part").select("p_partkey", display(v, "ohm", F.when(pk % 4 == 0, "100MHz")).alias("shown"))


@query("b09_nine_digits", with_views("select part_number, source, case when v is null or v = 0 then v else floor(v * pow(10.0, 8 - floor(log10(abs(v)))) + 0.5) / pow(10.0, 8 - floor(log10(abs(v)))) end v from (select *, unit_price / 7 v from offers)", "offers"))
def b09(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select(*KEY, round_digits(F.col("unit_price") / 7).alias("v"))


@query("b12_dimensions", "select p_partkey, case when p_partkey % 2 = 0 then least(p_size, 7)::double end short_side, case when p_partkey % 2 = 0 then greatest(p_size, 7)::double end long_side, case when p_partkey % 2 = 0 then 3::double end height, case when p_partkey % 2 = 1 then p_size::double end diameter, case when p_partkey % 2 = 1 then 11::double end length from part")
def b12(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit("x7x3mm"))).otherwise(F.concat(F.lit("D"), size, F.lit("xL11mm")))
    return table(spark, d, "part").select("p_partkey", dimensions(text).alias("s")).select("p_partkey", "s.*")


@query("b16_attributes_by_precedence", "select p_partkey, 'size' as attribute, cast(case when p_partkey % 3 = 0 then p_size else p_size + 1 end as varchar) as value from part union all select p_partkey, 'rating', cast(p_size * 2 as varchar) from part where p_partkey % 2 = 0")
def b16(spark: SparkSession, d: str) -> DataFrame:
    pk, size = F.col("p_partkey"), F.col("p_size")
    stated = F.map_from_entries(F.array(F.struct(F.lit("capacity"), F.when(pk % 3 == 0, size.cast("string"))), F.struct(F.lit("value"), (size + 1).cast("string")), F.struct(F.lit("v_max"), F.when(pk % 2 == 0, (size * 2).cast("string")))))
    return resolve_attributes(table(spark, d, "part").select("p_partkey", stated.alias("attributes")), ["p_partkey"], "attributes")


@query("b18_largest_value", with_views("select part_number, source, cast(list_max(list_transform(regexp_extract_all(concat(description, ' 25V'), '([0-9]+)V', 1), lambda x: cast(x as double))) as double) most from offers", "offers"))
def b18(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all(F.concat("description", F.lit(" 25V")), F.lit("([0-9]+)V"), 1)
    return offers(spark, d).select(*KEY, F.array_max(F.transform(found, lambda x: x.cast("double"))).alias("most"))


@query("b19_range_centre", "select p_partkey, (p_size + p_size + 10) / 2.0::double centre, cast(p_size + 10 as double) upper_end from part")
def b19(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("p_size").cast("string"), F.lit("~"), (F.col("p_size") + 10).cast("string"), F.lit("nm"))
    span = range_of(text, "nm")
    return table(spark, d, "part").select("p_partkey", span.centre.alias("centre"), span.high.alias("upper_end"))


@query("b24_strip_derived_keys", "select p_partkey, concat('brand=', p_brand) as attributes from part")
def b24(spark: SparkSession, d: str) -> DataFrame:
    """Adds derived attributes to a map, which later go again; the source's own stay as they are."""
    own = F.create_map(F.lit("brand"), F.col("p_brand"))
    full = F.map_concat(F.create_map(F.lit("d_size"), F.col("p_size").cast("string"), F.lit("d_type"), F.col("p_type")), own)
    stored = F.map_filter(full, lambda k, v: ~k.isin("d_size", "d_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(stored), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("attributes"))


_CLASS = "case " + " ".join(f"when list_contains(w, '{word}') then '{name}'" for word, name, _ in sorted(CLASS_WORDS, key=lambda x: x[2])) + " end"
_COLOURS = ", ".join(f"'{x}'" for x in WORD_COLUMNS["colour"])
_FAMILIES = ", ".join(f"'{x}'" for x in WORD_COLUMNS["family"])


@query("b25_typed_row", with_views(f"""
select source, part_number, size, rating, colour, family, class, in_stock, n_typed, search_text, concat_ws(',', 'class=' || class, 'colour=' || colour, 'family=' || family) attributes from (
select *, cast((size is not null)::int + (rating is not null)::int + (colour is not null)::int + (family is not null)::int as int) n_typed from (
select source, part_number, cast(regexp_extract(description, '([0-9]+)uF', 1) as double) size, cast(regexp_extract(description, '([0-9]+)V', 1) as double) rating, list_filter(w, lambda x: x in ({_COLOURS}))[1] colour,
list_filter(w, lambda x: x in ({_FAMILIES}))[1] family, {_CLASS} as class, stock > 0 in_stock, lower(concat_ws(' ', mpn, manufacturer, description)) search_text from (select *, string_split(description, ' ') w from offers)))""", "offers"))
def b25(spark: SparkSession, d: str) -> DataFrame:
    """The wide row of an offer out of its description: values by unit, words of columns, the class, and a text to search."""
    words = tokens(F.col("description"))
    typed = {k: v for k, v in typed_values(words).items() if k not in ("frequency", "resistance")}  # no description states these
    read = typed | {"class": class_in(words), "search_text": normal_key(F.concat_ws(" ", "mpn", "manufacturer", "description"))}
    rows = offers_read_by_part(spark, d, read).select(*KEY, *(f"read.{k}" for k in typed), "read.class", (F.col("stock") > 0).alias("in_stock"), "read.search_text")
    attributes = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), k) for k in ("class", "colour", "family")))
    return rows.withColumns({"n_typed": sum(F.col(k).isNotNull().cast("int") for k in typed), "attributes": attributes})


@query("b26_request_parsing", with_views("""
select request_id, want_size size, min_rating rating, cast(null as double) frequency, case when request_id % 5 = 0 then 4700.0::double end resistance, want_colour colour, lower(family) family,
case when request_id % 7 <> 0 then 'size' when request_id % 5 = 0 then 'resistance' when min_rating is not null then 'rating' else 'family' end primary_kind, concat_ws(' ', 'shiny', maker) keywords
from (select * replace (case when request_id % 7 <> 0 then want_size end as want_size) from requests)""", "requests"))
def b26(spark: SparkSession, d: str) -> DataFrame:
    """Texts of requests: typed values, the column that each is mainly about, and the keywords that are left."""
    number, request = lambda c: F.col(c).cast("int").cast("string"), F.col("request_id")
    size, rating = F.when(request % 7 != 0, F.concat(number("want_size"), F.lit("uF"))), F.concat(F.lit("at least "), number("min_rating"), F.lit("V,"))
    text = F.concat_ws(" ", F.lit("a shiny"), F.initcap("family"), size, F.lit("with"), rating, F.when(request % 5 == 0, "4.7kohm"), "want_colour", F.lit("for the"), "maker")
    words = tokens(text)
    typed = typed_values(words) | {"family": F.lower(typed_values(words)["family"])}
    rows = requests(spark, d).select("request_id", *(v.alias(k) for k, v in typed.items()), F.array_join(left_over(words), " ").alias("keywords"))
    return rows.withColumn("primary_kind", F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in PRIMARY)))


@query("b30_price_brackets", "select p_partkey, concat('1:', cast(p_size as varchar), '.0,10:', cast(p_size as varchar), '.5') as brackets from part")
def b30(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.concat(F.lit("10-99:"), size, F.lit(".5,bad,1-9:"), size, F.lit(",10-:99,x:1"))
    listed = F.transform(price_brackets(raw), lambda b: F.concat(b.quantity.cast("string"), F.lit(":"), b.price.cast("string")))
    # few bytes, but much to read in each: dealt to as many tasks as a shuffle has, which by bytes would be coalesced
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, d, "part").select("p_partkey", "p_size").repartition(n, "p_partkey").select("p_partkey", F.array_join(listed, ",").alias("brackets"))


@query("b31_localised_price", "select p_partkey, round(p_retailprice, 2) as price from part")
def b31(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace(F.translate(F.format_number(F.round("p_retailprice", 2), 2), ",.", "_,"), "_", ".")  # 1.234,56
    plain = F.translate(F.regexp_replace(F.concat(text, F.lit(" €")), r"[^0-9,.-]", ""), ".", "")
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(plain, ",", ".").cast("double").alias("price"))


@query("b32_canonical_hash", """
select p_partkey, case p_partkey % 5 when 0 then concat('x', substr(md5(concat('{"size":', cast(p_size as varchar))), 2))
when 1 then md5(concat('{"brand":null,"size":', cast(p_size as varchar), '.5,"type":"', p_type, '"}')) else md5(concat('{"brand":{"a":"', p_brand, '","b":[1,2.5]},"size":', cast(p_size as varchar), '.5,"type":"', p_type, '"}')) end h from part""")
def b32(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with their keys in any order and blanks; some lack a field, some break off."""
    pk, size = F.col("p_partkey"), F.col("p_size").cast("string")
    rest = F.concat(F.lit('"type": "'), "p_type", F.lit('", "size": '), size, F.lit(".50, \"seen\": "), pk.cast("string"), F.lit("}"))
    payload = F.when(pk % 5 == 0, F.concat(F.lit('{"size":'), size)).when(pk % 5 == 1, F.concat(F.lit("{"), rest)).otherwise(F.concat(F.lit('{"brand": {"b": [1, 2.50], "a": "'), "p_brand", F.lit('"}, '), rest))
    return table(spark, d, "part").select("p_partkey", canonical_hash(payload).alias("h"))


_AVAILABLE = "case when stock = 0 then 'none' when stock < 5 then 'short' when stock < 40 then 'low' else 'good' end"


@query("b34_availability", with_views(f"select part_number, source, {_AVAILABLE} availability, concat_ws(',', case when stock < 40 then 'stock' end, case when moq > 5 then 'minimum' end) notes from offers", "offers"))
def b34(spark: SparkSession, d: str) -> DataFrame:
    """The worst of several flags by order of severity."""
    names = F.array(*map(F.lit, ("none", "short", "low", "good")))
    flags = F.array(F.when(F.col("stock") == 0, 1), F.when(F.col("stock") < 5, 2), F.when(F.col("stock") < 40, 3), F.lit(4))
    notes = F.concat_ws(",", F.when(F.col("stock") < 40, "stock"), F.when(F.col("moq") > 5, "minimum"))
    return offers(spark, d).select(*KEY, F.element_at(names, F.array_min(F.array_compact(flags))).alias("availability"), notes.alias("notes"))


@query("b35_lifecycle", with_views("select part_number, source, case when extractor_version = 1 then 'obsolete' when extractor_version = 2 and stock = 0 then 'last_time_buy' else 'active' end lifecycle from offers", "offers"))
def b35(spark: SparkSession, d: str) -> DataFrame:
    status = F.array(F.when(F.col("extractor_version") == 1, "DISCONTINUED"), F.when((F.col("extractor_version") == 2) & (F.col("stock") == 0), "LTB"))
    return offers(spark, d).select(*KEY, F.when(F.array_contains(status, "DISCONTINUED"), "obsolete").when(F.array_contains(status, "LTB"), "last_time_buy").otherwise("active").alias("lifecycle"))


@query("b36_low_stock", with_views("select request_id, part_number, source, stock < greatest(20, 2 * quantity) low from candidates", "requests", "offers", "candidates"))
def b36(spark: SparkSession, d: str) -> DataFrame:
    from partloom.bindings import judged_candidates

    return judged_candidates(spark, d, lambda found: found.select("request_id", *KEY, (F.col("stock") < F.greatest(F.lit(20), 2 * F.col("quantity"))).alias("low")))


@query("b37_order_pricing", with_views("""
select request_id, part_number, source, n order_quantity, round(n * unit_price * case when n >= 100 then 0.8 when n >= 10 then 0.9 else 1.0 end, 4) total from (
select *, cast(ceil(greatest(quantity, moq) / order_multiple) * order_multiple as int) n from candidates)""", "requests", "offers", "candidates"))
def b37(spark: SparkSession, d: str) -> DataFrame:
    from partloom.bindings import judged_candidates

    n = order_quantity(F.col("quantity"), F.col("moq"), F.col("order_multiple"))

    def priced(found: DataFrame) -> DataFrame:
        rows = found.select("request_id", *KEY, n.alias("order_quantity"), brackets_of(F.col("unit_price")).alias("b"))
        return rows.select("request_id", *KEY, "order_quantity", F.round(F.col("order_quantity") * bracket_price(F.col("b"), F.col("order_quantity")), 4).alias("total"))

    return judged_candidates(spark, d, priced)


def smallest_brackets(brackets: Column, n: int = 3) -> Column:
    """Those of the n smallest quantities; of a quantity's prices the lowest."""
    ordered = F.array_sort(brackets)
    quantities = F.transform(ordered, lambda b: b.quantity)
    return F.slice(F.filter(ordered, lambda b, i: F.array_position(quantities, b.quantity) == i + 1), 1, n)


@query("b38_three_smallest_brackets", with_views("select part_number, source, array_to_string(list_slice(list_sort(list_distinct([stock + 1, moq, 10 * order_multiple, 200])), 1, 3), ',') quantities from offers", "offers"))
def b38(spark: SparkSession, d: str) -> DataFrame:
    quantities = (F.lit(200), F.col("stock") + 1, 10 * F.col("order_multiple"), F.col("moq"))
    brackets = F.array(*[F.struct(q.cast("long").alias("quantity"), (F.col("unit_price") * f).alias("price")) for q, f in zip(quantities, (0.7, 0.8, 0.9, 1.0))])
    return offers(spark, d).select(*KEY, F.array_join(F.transform(smallest_brackets(brackets), lambda b: b.quantity.cast("string")), ",").alias("quantities"))
