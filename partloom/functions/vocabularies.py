"""Hierarchies, labelled values and rules on identifiers, by joins with small declared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.bindings import alike, for_each_request, offers, requests, table, with_views
from partloom.functions.text_keys import CODE_KEY_SQL, SPELLING_SQL, code_key, spelling
from partloom.operators.matching import KEY
from partloom.operators.ranking import first_by_key
from partloom.registry import query

#: Classes and their parents.
PARENTS = (("ECONOMY", "STANDARD"), ("PROMO", "STANDARD"), ("SMALL", "MEDIUM"), ("LARGE", "MEDIUM"), ("MEDIUM", None), ("STANDARD", None))
#: Words of a name that stand for a class.
NAME_CLASSES = (("bolt", "SMALL"), ("gear", "LARGE"), ("widget", "PROMO"), ("ring", "ECONOMY"))
#: Rules on identifiers with what they say of the package; the longest pattern wins.
IDENTIFIER_RULES = (("^Brand-1", "T1"), ("^Brand-1[0-4]", "T14"), ("^Brand-2", "T2"))
#: The text's class wins over the category's for these pairs (text, category), and within a group all of which
#: the category names.
OVERRIDES = (("SMALL", "PROMO"), ("ECONOMY", "LARGE"))
UNDECIDED = (("SMALL", "LARGE"),)
_PARENT_VALUES = ", ".join(f"('{c}', {repr(p) if p else 'null'})" for c, p in PARENTS)


def parents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARENTS), "class string, parent string")


def dimensions_fit(length: Column, width: Column, want_length: Column, want_width: Column, margin: float) -> Column:
    """In either orientation."""
    near = lambda a, b: F.abs(a - b) <= margin
    return (near(length, want_length) & near(width, want_width)) | (near(length, want_width) & near(width, want_length))


@query("b15_class_of_two_texts", f"""
with h(class, parent) as (values {_PARENT_VALUES}), n(word, named) as (values {", ".join(str(x) for x in NAME_CLASSES)})
select p_partkey, case when h.parent = p_type then n.named else p_type end as class from part left join n on n.word = split_part(p_name, ' ', 2) left join h on h.class = n.named""")
def b15(spark: SparkSession, d: str) -> DataFrame:
    """The class that the name tells counts if it specialises the category's class, else the category does."""
    named = table(spark, d, "part").withColumn("word", F.split_part("p_name", F.lit(" "), F.lit(2))).join(spark.createDataFrame(list(NAME_CLASSES), "word string, named string"), "word", "left")
    joined = named.join(parents(spark).withColumnRenamed("class", "named"), "named", "left")
    return joined.select("p_partkey", F.when(F.col("parent") == F.col("p_type"), F.col("named")).otherwise(F.col("p_type")).alias("class"))


def class_of_two(category: Column, named: Column, parent_of_named: Column, overrides: tuple, undecided: tuple, categories: Column) -> Column:
    """The class of an offer whose category and text each name one (null: none). The text's class counts where the category
    names none, where it specialises the category's, where the pair (text, category) is declared to override, and where the
    category names all of an undecided group of classes and the text one of them; else the category's counts.
    ``categories`` are all classes that the category names."""
    pair = F.lit(False)
    for text, of in overrides:
        pair = pair | ((named == text) & (category == of))
    for group in undecided:
        pair = pair | (named.isin(*group) & category.isin(*group) & (F.size(F.array_intersect(categories, F.array(*map(F.lit, group)))) == len(group)))
    return F.when(category.isNull() | F.coalesce(pair | (parent_of_named == category), F.lit(False)), F.coalesce(named, category)).otherwise(category)


_CATEGORY = "case when p_size % 5 = 0 then null else p_type end"


@query("b15_class_with_overrides", f"""
with h(class, parent) as (values {_PARENT_VALUES}), n(word, named) as (values {", ".join(str(x) for x in NAME_CLASSES)}),
o(named, category) as (values {", ".join(str(x) for x in OVERRIDES)}),
t as (select p_partkey, {_CATEGORY} category, case when p_size % 4 = 1 then 'LARGE' end also_named, named from part left join n on n.word = split_part(p_name, ' ', 2))
select p_partkey, case when t.category is null then t.named when h.parent = t.category or o.named is not null then t.named
       when t.category = 'SMALL' and also_named = 'LARGE' and t.named = 'LARGE' then t.named else t.category end as class
from t left join h on h.class = t.named left join o on o.named = t.named and o.category = t.category""")
def b15_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Categories are the parts' types, some of which name a second class; one in five names none."""
    named = table(spark, d, "part").withColumn("word", F.split_part("p_name", F.lit(" "), F.lit(2))).join(F.broadcast(spark.createDataFrame(list(NAME_CLASSES), "word string, named string")), "word", "left")
    joined = named.join(F.broadcast(parents(spark).withColumnRenamed("class", "named")), "named", "left")
    category = F.expr(_CATEGORY)
    every = F.array_compact(F.array(category, F.when(F.col("p_size") % 4 == 1, "LARGE")))
    return joined.select("p_partkey", class_of_two(category, F.col("named"), F.col("parent"), OVERRIDES, UNDECIDED, every).alias("class"))


@query("b17_key_contains", "select p_partkey, cast(p_size as varchar) voltage from part where p_partkey % 3 <> 0")
def b17(spark: SparkSession, d: str) -> DataFrame:
    """Any voltage whose name doesn't say that it is of another kind."""
    pk, size = F.col("p_partkey"), F.col("p_size").cast("string")
    stated = F.create_map(F.lit("Forward Voltage"), F.lit("0.7"), F.when(pk % 3 == 0, "Clamping Voltage").otherwise("Rated voltage (DC)"), size)
    keys = table(spark, d, "part").select("p_partkey", F.explode(stated).alias("name", "value"))
    name = F.lower("name")
    return keys.where(name.contains("voltage") & ~name.rlike("forward|clamp|reverse|isolation")).select("p_partkey", F.col("value").alias("voltage"))


@query("b20_labelled_values", "select p_partkey, cast(p_size as double) isat, round(p_size / 1000.0, 6)::double dcr, cast(-40 as double) t_low, cast(85 + p_size as double) t_high from part")
def b20(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("Isat="), size, F.lit("A DCR "), size, F.lit("mOhm -40…"), (F.col("p_size") + 85).cast("string"), F.lit("°C"))
    part = lambda pattern, i=1: F.regexp_extract(text, pattern, i).try_cast("double")
    heat = r"(-?[0-9]+)…([0-9]+)°C"
    return table(spark, d, "part").select("p_partkey", part(r"Isat\s*=\s*([0-9.]+)A").alias("isat"), F.round(part(r"DCR\s*([0-9.]+)mOhm") / 1000, 6).alias("dcr"), part(heat).alias("t_low"), part(heat, 2).alias("t_high"))


@query("b21_identifier_rules", with_views(f"select source, part_number, case when regexp_matches(mpn, '^Brand-1[0-4]') then 'T14' when regexp_matches(mpn, '^Brand-1') then 'T1' when regexp_matches(mpn, '^Brand-2') then 'T2' end package from offers", "offers"))
def b21(spark: SparkSession, d: str) -> DataFrame:
    """Rules meet identifiers on the five letters that all patterns begin with; the longest that fits wins."""
    rules = spark.createDataFrame([("Brand", p, t, len(p)) for p, t in IDENTIFIER_RULES], "start string, pattern string, package string, length int")
    rows = offers(spark, d).select(*KEY, "mpn", F.substring("mpn", 1, 5).alias("start"))
    fits = rows.join(rules, "start").where(F.expr("mpn rlike pattern"))
    best = first_by_key(fits, KEY, [F.desc("length")]).select(*KEY, "package")
    return rows.join(best, KEY, "left").select(*KEY, "package")


@query("b22_relabelled_by_class", "select p_partkey, case when p_type = 'SMALL' then 'ripple' else 'rated' end as label, p_size as current from part")
def b22(spark: SparkSession, d: str) -> DataFrame:
    """What a value is called depends on the class."""
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") == "SMALL", "ripple").otherwise("rated").alias("label"), F.col("p_size").alias("current"))


def enriched(attributes: Column, derived: Column) -> tuple[Column, Column]:
    """A map with derived keys that it lacks, and which were added; what the source states stays."""
    new = F.map_filter(derived, lambda k, v: v.isNotNull() & ~F.map_contains_key(attributes, k))
    return F.map_concat(attributes, new), F.array_sort(F.map_keys(new))


@query("b23_idempotent_enrichment", "select p_partkey, case when p_partkey % 2 = 0 then 'source' else 'derived' end as size_by, case when p_partkey % 2 = 0 then 'type' else 'size,type' end added, '' as added_again from part")
def b23(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("size"), F.lit("source"))).otherwise(F.create_map().cast("map<string,string>"))
    derived = F.create_map(F.lit("size"), F.lit("derived"), F.lit("type"), F.col("p_type"))
    rows = table(spark, d, "part").select("p_partkey", own.alias("own"), derived.alias("derived"))
    full, added = enriched(F.col("own"), F.col("derived"))
    rows = rows.select("p_partkey", full.alias("full"), added.alias("added"), "derived")
    return rows.select("p_partkey", F.col("full")["size"].alias("size_by"), F.array_join("added", ",").alias("added"), F.array_join(enriched(F.col("full"), F.col("derived"))[1], ",").alias("added_again"))


@query("c09_code_match", with_views(f", k as (select *, {CODE_KEY_SQL} from (select *, {SPELLING_SQL.format('pk')} code from offers)) select source, part_number from k where code_key = 'SOIC8' or abs(size_v - 20) <= 2 or kind = 'ring' or code_key is null", "offers").replace(") , k as", "), k as"))
def c09(spark: SparkSession, d: str) -> DataFrame:
    """The code is of the wanted package, or its size is within the margin, or it is of a neutral class, or can't be read."""
    kind, size, key = F.col("kind"), F.col("size_v"), code_key(spelling(F.col("pk")))
    return offers(spark, d).where((key == code_key(F.lit("SOP-8"))) | (F.abs(size - 20) <= 2) | (kind == "ring") | key.isNull()).select(*KEY)


def class_grade(wanted: Column, wanted_parent: Column, actual: Column, actual_parent: Column, mentioned: Column) -> Column:
    """The wanted class or one that specialises it 1, its generic class 0, another -1; without a class 1 where the text names it."""
    stated = F.when((actual == wanted) | (actual_parent == wanted), 1).when(actual == wanted_parent, 0).otherwise(-1)
    return F.when(actual.isNotNull(), stated).when(mentioned, 1).otherwise(0)


@query("h20_class_grade", with_views(f""", h(class, parent) as (values {_PARENT_VALUES}) select r.request_id, o.source, o.part_number,
case when o.kind = 'ring' then case when contains(lower(o.description), lower(r.family)) then 1 else 0 end when o.family = r.family or a.parent = r.family then 1 when o.family = w.parent then 0 else -1 end grade
from requests r join offers o on o.manufacturer = r.maker and o.size_v = r.want_size left join h w on w.class = r.family left join h a on a.class = o.family""", "requests", "offers").replace(") , h(", "), h("))
def h20(spark: SparkSession, d: str) -> DataFrame:
    """Grades of offers of the wanted maker and size; those of kind ring count as without a class, so their text tells."""
    of = offers(spark, d).withColumnRenamed("family", "of_family")
    heads, members = alike(requests(spark, d))
    pairs = heads.join(of.hint("rebalance"), (F.col("manufacturer") == F.col("maker")) & (F.col("size_v") == F.col("want_size")))
    for name in ("family", "of_family"):
        pairs = pairs.join(parents(spark).toDF(name, f"{name}_parent"), name, "left")
    actual = F.when(F.col("kind") == "ring", None).otherwise(F.col("of_family"))
    grade = class_grade(F.col("family"), F.col("family_parent"), actual, F.col("of_family_parent"), F.lower("description").contains(F.lower("family")))
    return for_each_request(pairs.select("request_id", *KEY, grade.alias("grade")), members)


@query("c14_compatible_vocabulary", f"with h(class, parent) as (values {_PARENT_VALUES}) select a.class wanted, string_agg(b.class, ',' order by b.class) accepted from h a join h b on a.class = b.class or a.parent = b.class or b.parent = a.class group by 1")
def c14(spark: SparkSession, d: str) -> DataFrame:
    """For each class, those that are it, its parent or its specialisations, of the classes that parts have."""
    known = table(spark, d, "part").select(F.col("p_type").alias("class")).distinct()
    pairs = parents(spark).join(known, "class")
    same = pairs.select(F.col("class").alias("wanted"), F.col("class").alias("ok"))
    up = pairs.where("parent is not null").select("class", "parent")
    both = same.union(up).union(up.select("parent", "class"))
    return both.groupBy("wanted").agg(F.array_join(F.sort_array(F.collect_set("ok")), ",").alias("accepted"))


@query("d11_parents_of_parts", f"with h(class, parent) as (values {_PARENT_VALUES}) select p_partkey, coalesce(parent, class) as root from part join h on h.class = p_type")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(parents(spark), F.col("p_type") == F.col("class")).select("p_partkey", F.coalesce("parent", "class").alias("root"))


@query("h19_either_orientation", "select p_partkey, (abs(p_size - 20) <= 3 and abs(p_partkey % 30 - 10) <= 3) or (abs(p_size - 10) <= 3 and abs(p_partkey % 30 - 20) <= 3) fits from part")
def h19(spark: SparkSession, d: str) -> DataFrame:
    fits = dimensions_fit(F.col("p_size"), F.col("p_partkey") % 30, F.lit(20), F.lit(10), 3)
    return table(spark, d, "part").select("p_partkey", fits.alias("fits"))


@query("l19_synthetic_requests", with_views("select r.request_id, k.kind from requests r join (select distinct family, kind from offers) k on k.family = r.family where md5(concat(cast(r.request_id as varchar), k.kind)) < '8' and not (r.family = 'PROMO' and k.kind = 'bolt')", "requests", "offers"))
def l19(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of a request and a kind of its family, half of them by a hash, without excluded ones."""
    kinds = offers(spark, d).select("family", "kind").distinct()
    out = spark.createDataFrame([("PROMO", "bolt")], "family string, kind string")
    made = requests(spark, d).select("request_id", "family").join(kinds, "family").where(F.md5(F.concat(F.col("request_id").cast("string"), "kind")) < "8")
    return made.join(out, ["family", "kind"], "left_anti").select("request_id", "kind")


@query("m01_sql_functions", with_views("select source, part_number, regexp_matches(description, '(^|[^0-9.])5uF') has_value, len(list_filter(regexp_extract_all(description, '([0-9]+)V', 1), lambda x: cast(x as double) >= 40)) > 0 at_least from offers", "offers"))
def m01(spark: SparkSession, d: str) -> DataFrame:
    """The two text predicates as SQL functions of the session."""
    spark.sql(r"create or replace temporary function text_has_value(t string, token string) returns boolean return t rlike concat('(?<![0-9.])\\Q', token, '\\E')")
    spark.sql(r"create or replace temporary function text_at_least(t string, unit string, least double) returns boolean return exists(regexp_extract_all(t, concat('([0-9]+(?:\\.[0-9]+)?)', unit), 1), x -> cast(x as double) >= least)")
    found = spark.sql("select source, part_number, text_has_value(description, '5uF') has_value, text_at_least(description, 'V', 40) at_least from {o}", o=offers(spark, d))
    for name in ("text_has_value", "text_at_least"):  # they stand in the plan by now
        spark.sql(f"drop temporary function {name}")
    return found
