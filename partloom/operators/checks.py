"""The exact check of candidates and their scores: match, unknown or conflict for each constraint, kept apart to the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.bindings import judged_candidates, offers, requests, with_views
from partloom.operators.matching import KEY
from partloom.registry import query

#: Kind, what relaxing does with it, weight. Policy of the constraints that the bound views have.
POLICY = (("family", "NEVER", 0.3), ("size", "NEVER", 0.4), ("rating", "BELOW_SPEC", 0.3), ("colour", "LADDER", 0.15))
OVERRIDES = (("PROMO", "colour", "SOFT"), ("ECONOMY", "size", "SOFT"), ("LARGE", "rating", "NEVER"))
OVERSHOOT_RATIO, LOW_STOCK = 2.0, 20


def state(wanted: Column, actual: Column, holds: Column) -> Column:
    """Null if nothing is wanted, else match, unknown (not stated) or conflict."""
    return F.when(wanted.isNull(), F.lit(None)).when(actual.isNull(), "unknown").when(holds, "match").otherwise("conflict")


def checked(found: DataFrame) -> DataFrame:
    """Candidates with a state for each constraint."""
    size = state(F.col("want_size"), F.col("size_v"), F.abs(F.col("size_v") - F.col("want_size")) <= 1)
    rating = state(F.col("min_rating"), F.when(F.col("rating_v") > 0, F.col("rating_v")), F.col("rating_v") >= F.col("min_rating"))
    colour = state(F.col("want_colour"), F.col("colour"), F.lower("colour") == F.lower("want_colour"))
    return found.withColumns({"s_size": size, "s_rating": rating, "s_colour": colour})


CHECKED = """
select *, case when size_v is null then 'unknown' when abs(size_v - want_size) <= 1 then 'match' else 'conflict' end s_size,
  case when min_rating is null then null when rating_v is null or rating_v <= 0 then 'unknown' when rating_v >= min_rating then 'match' else 'conflict' end s_rating,
  case when want_colour is null then null when colour is null then 'unknown' when lower(colour) = lower(want_colour) then 'match' else 'conflict' end s_colour
from candidates"""
_ALL = ("requests", "offers", "candidates")


def checked_sql(body: str) -> str:
    return with_views("", *_ALL).rstrip() + f", checked as ({CHECKED}) {body.strip()}"


def conflicts() -> Column:
    """Names of constraints in conflict, in check order."""
    return F.filter(F.array(*[F.when(F.col(f"s_{k}") == "conflict", k) for k in ("size", "rating", "colour")]), lambda x: x.isNotNull())


def unverified() -> Column:
    return F.filter(F.array(*[F.when(F.col(f"s_{k}") == "unknown", k) for k in ("size", "rating", "colour")]), lambda x: x.isNotNull())


def overshoot(actual: Column, wanted: Column, ratio: float = OVERSHOOT_RATIO) -> Column:
    """A quarter for each octave beyond the ratio, two octaves at most."""
    octaves = F.log2(actual / (wanted * ratio))
    return F.when(actual > wanted * ratio, 0.25 * F.least(F.lit(2.0), octaves)).otherwise(0.0)


def verdict() -> Column:
    return F.when((F.col("s_size") == "conflict") | (F.col("s_colour") == "conflict"), "constraint").when(F.col("s_rating") == "conflict", "below_spec").when(F.col("s_rating") == "unknown", "unverified_rating").otherwise("meets")


VERDICT_SQL = "case when s_size = 'conflict' or s_colour = 'conflict' then 'constraint' when s_rating = 'conflict' then 'below_spec' when s_rating = 'unknown' then 'unverified_rating' else 'meets' end"


@query("h01_policy", f"""
with p(kind, role, weight) as (values {", ".join(f"('{k}', '{r}', {w})" for k, r, w in POLICY)}), o(family, kind, role) as (values {", ".join(f"('{f}', '{k}', '{r}')" for f, k, r in OVERRIDES)})
select f.family, p.kind, coalesce(o.role, p.role) as role, cast(p.weight as double) weight from (select distinct p_type family from part) f cross join p left join o on o.family = f.family and o.kind = p.kind""")
def h01(spark: SparkSession, d: str) -> DataFrame:
    """Every family's policy: the declared one unless the family has its own."""
    families = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("family")).distinct()
    base = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("base"), F.lit(w).alias("weight")) for k, r, w in POLICY]))
    own = spark.createDataFrame(list(OVERRIDES), "family string, kind string, own string")
    return families.select("family", base.alias("p")).select("family", "p.*").join(own, ["family", "kind"], "left").select("family", "kind", F.coalesce("own", "base").alias("role"), "weight")


@query("h02_hard_check", checked_sql("select request_id, source, part_number, s_size, s_rating, s_colour, concat_ws(',', case when s_size = 'conflict' then 'size' end, case when s_rating = 'conflict' then 'rating' end, case when s_colour = 'conflict' then 'colour' end) conflicts from checked"))
def h02(spark: SparkSession, d: str) -> DataFrame:
    return judged_candidates(spark, d, lambda found: checked(found).select("request_id", *KEY, "s_size", "s_rating", "s_colour", F.array_join(conflicts(), ",").alias("conflicts")))


@query("h03_comparison_modes", checked_sql("""
select request_id, part_number, source, size_v = want_size m_equal, lower(colour) = lower(want_colour) m_ignore_case, rating_v >= min_rating m_at_least, size_v <= want_size m_at_most,
abs(size_v - want_size) <= 0.1 * want_size m_tolerance, case when size_v = want_size then 2 when abs(size_v - want_size) <= 1 then 1 else 0 end m_graded from checked"""))
def h03(spark: SparkSession, d: str) -> DataFrame:
    size, want = F.col("size_v"), F.col("want_size")
    modes = {"m_equal": size == want, "m_ignore_case": F.lower("colour") == F.lower("want_colour"), "m_at_least": F.col("rating_v") >= F.col("min_rating"), "m_at_most": size <= want, "m_tolerance": F.abs(size - want) <= 0.1 * want, "m_graded": F.when(size == want, 2).when(F.abs(size - want) <= 1, 1).otherwise(0)}
    return judged_candidates(spark, d, lambda found: found.select("request_id", *KEY, *(v.alias(k) for k, v in modes.items())))


@query("h06_mismatches", checked_sql("""
select request_id, source, part_number, concat_ws('; ', case when s_size = 'conflict' then concat('size: ', cast(cast(size_v as int) as varchar), ' instead of ', cast(cast(want_size as int) as varchar)) end,
case when s_rating = 'conflict' then concat('rating: ', cast(cast(rating_v as int) as varchar), 'V below ', cast(cast(min_rating as int) as varchar), 'V') end,
case when s_colour = 'conflict' then concat('colour: ', colour, ' instead of ', want_colour) end) mismatches from checked"""))
def h06(spark: SparkSession, d: str) -> DataFrame:
    whole = lambda c: F.col(c).cast("int").cast("string")
    words = [
        F.when(F.col("s_size") == "conflict", F.concat(F.lit("size: "), whole("size_v"), F.lit(" instead of "), whole("want_size"))),
        F.when(F.col("s_rating") == "conflict", F.concat(F.lit("rating: "), whole("rating_v"), F.lit("V below "), whole("min_rating"), F.lit("V"))),
        F.when(F.col("s_colour") == "conflict", F.concat(F.lit("colour: "), "colour", F.lit(" instead of "), "want_colour")),
    ]
    return judged_candidates(spark, d, lambda found: checked(found).select("request_id", *KEY, F.concat_ws("; ", *words).alias("mismatches")))


@query("h07_unverified", checked_sql("select request_id, source, part_number, concat_ws(',', case when s_size = 'unknown' then 'size' end, case when s_rating = 'unknown' then 'rating' end, case when s_colour = 'unknown' then 'colour' end) unverified from checked"))
def h07(spark: SparkSession, d: str) -> DataFrame:
    return judged_candidates(spark, d, lambda found: checked(found).select("request_id", *KEY, F.array_join(unverified(), ",").alias("unverified")))


@query("h08_below_spec_distance", checked_sql("select request_id, source, part_number, round(case when s_rating = 'conflict' then abs(ln(rating_v / min_rating)) else 0 end, 6) distance from checked"))
def h08(spark: SparkSession, d: str) -> DataFrame:
    distance = F.when(F.col("s_rating") == "conflict", F.abs(F.log(F.col("rating_v") / F.col("min_rating")))).otherwise(0.0)
    return judged_candidates(spark, d, lambda found: checked(found).select("request_id", *KEY, F.round(distance, 6).alias("distance")))


@query("h09_closest_rating", checked_sql("select request_id, source, part_number, round(1 - least(1, log2(rating_v / min_rating) / 2), 6) closeness from checked where s_rating = 'match'"))
def h09(spark: SparkSession, d: str) -> DataFrame:
    close = 1 - F.least(F.lit(1.0), F.log2(F.col("rating_v") / F.col("min_rating")) / 2)
    return judged_candidates(spark, d, lambda found: checked(found).where("s_rating = 'match'").select("request_id", *KEY, F.round(close, 6).alias("closeness")))


@query("h10_overshoot", checked_sql("select request_id, source, part_number, round(case when rating_v > min_rating * 2 then 0.25 * least(2, log2(rating_v / (min_rating * 2))) else 0 end, 6) penalty from checked where s_rating = 'match'"))
def h10(spark: SparkSession, d: str) -> DataFrame:
    return judged_candidates(spark, d, lambda found: checked(found).where("s_rating = 'match'").select("request_id", *KEY, F.round(overshoot(F.col("rating_v"), F.col("min_rating")), 6).alias("penalty")))


_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("h11_keyword_overlap", f"""
with q as (select item_id, unnest({_WORDS}) w, len({_WORDS}) n from benchmark), t as (select doc_id, unnest({_WORDS}) w from documents)
select item_id, doc_id, round(count(*) / n, 6) overlap from q join t using (w) group by item_id, doc_id, n""")
def h11(spark: SparkSession, d: str) -> DataFrame:
    """The share of a text's keywords that a document has, for every document that has one of them."""
    keywords = lambda name, key: spark.read.parquet(f"{d}/{name}.parquet").select(key, F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")).alias("words"))
    asked = keywords("benchmark", "item_id").select("item_id", F.size("words").alias("n"), F.explode("words").alias("w"))
    held = keywords("documents", "doc_id").select("doc_id", F.explode("words").alias("w"))
    # a merge join holds all rows that its right side has of a word, so documents stand on the left
    shared = held.join(asked, "w").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("same"))
    return shared.select("item_id", "doc_id", F.round(F.col("same") / F.col("n"), 6).alias("overlap"))


@query("h15_verdict", checked_sql(f"select request_id, source, part_number, {VERDICT_SQL} verdict from checked"))
def h15(spark: SparkSession, d: str) -> DataFrame:
    return judged_candidates(spark, d, lambda found: checked(found).select("request_id", *KEY, verdict().alias("verdict")))


@query("h16_soft_preference", with_views("select source, part_number, round(0.5 / (1 + size_v / 25), 6) preference from offers where size_v is not null", "offers"))
def h16(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where("size_v is not null").select(*KEY, F.round(0.5 / (1 + F.col("size_v") / 25), 6).alias("preference"))


@query("h17_missing_feature", with_views("select source, part_number, case when colour is null then -1.0::double when colour = 'red' then 1.0::double else -1.0::double end required, case when colour is null then 0.0::double when colour = 'red' then 1.0::double else -1.0::double end ignored from offers", "offers"))
def h17(spark: SparkSession, d: str) -> DataFrame:
    """A feature that isn't stated: counted as a miss where it is required, as nothing where absence is ignored."""
    by = lambda none: F.when(F.col("colour").isNull(), none).when(F.col("colour") == "red", 1.0).otherwise(-1.0)
    return offers(spark, d).select(*KEY, by(-1.0).alias("required"), by(0.0).alias("ignored"))


@query("h18_two_digit_code", with_views("select request_id, source, part_number, floor(rating_v / 10) >= floor(min_rating / 10) and rating_v % 10 >= min_rating % 10 dominates from candidates where rating_v is not null and min_rating is not null", *_ALL))
def h18(spark: SparkSession, d: str) -> DataFrame:
    """Both digits of a rating as IP codes have them: the first and the second have to be reached each."""
    have, want = F.col("rating_v"), F.col("min_rating")

    def dominating(found: DataFrame) -> DataFrame:
        found = found.where(have.isNotNull() & want.isNotNull())
        return found.select("request_id", *KEY, ((F.floor(have / 10) >= F.floor(want / 10)) & (have % 10 >= want % 10)).alias("dominates"))

    return judged_candidates(spark, d, dominating)


@query("h21_really_relaxed", checked_sql("select request_id, 'colour' as relaxed from checked where want_colour is not null group by request_id having sum(case when s_colour = 'match' then 1 else 0 end) < 5 and sum(case when s_colour = 'conflict' then 1 else 0 end) > 0"))
def h21(spark: SparkSession, d: str) -> DataFrame:
    """Constraints that were loosened, as too few rows met them, and that some row misses."""

    def relaxed(found: DataFrame) -> DataFrame:
        counts = checked(found).where("want_colour is not null").groupBy("request_id").agg(F.count_if(F.col("s_colour") == "match").alias("met"), F.count_if(F.col("s_colour") == "conflict").alias("missed"))
        return counts.where("met < 5 and missed > 0").select("request_id", F.lit("colour").alias("relaxed"))

    return judged_candidates(spark, d, relaxed)


@query("h22_explanation", checked_sql("""
select request_id, string_agg(concat(cast(n as varchar), ' x ', reason), ', ' order by n desc, reason) hint from (
select request_id, reason, count(*) n from (select request_id, case when s_size = 'conflict' then 'size' when s_rating = 'conflict' then 'rating' when s_colour = 'conflict' then 'colour' end reason from checked) where reason is not null group by 1, 2) group by 1"""))
def h22(spark: SparkSession, d: str) -> DataFrame:

    def hints(found: DataFrame) -> DataFrame:
        counts = checked(found).select("request_id", F.get(conflicts(), 0).alias("reason")).where("reason is not null").groupBy("request_id", "reason").count()
        listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "reason", "count")))
        words = F.transform(listed, lambda x: F.concat(x["count"].cast("string"), F.lit(" x "), x.reason))
        return counts.groupBy("request_id").agg(F.array_join(words, ", ").alias("hint"))

    return judged_candidates(spark, d, hints)


@query("h23_declared_constraints", f"with p(kind, role, weight) as (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{r}{chr(39)}, {w})' for k, r, w in POLICY)}), n as ({with_views('select count(*) total, count(size_v) size, count(rating_v) rating, count(colour) colour, count(family) family from offers', 'offers')}) select kind, role, cast(weight as double) weight, case kind when 'size' then size when 'rating' then rating when 'colour' then colour else family end stated from p, n")
def h23(spark: SparkSession, d: str) -> DataFrame:
    """The declared constraints with how many offers state each."""
    stated = offers(spark, d).agg(F.count("family").alias("family"), F.count("size_v").alias("size"), F.count("rating_v").alias("rating"), F.count("colour").alias("colour"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("role"), F.lit(w).alias("weight"), F.col(k).alias("stated")) for k, r, w in POLICY]))
    return stated.select(rows.alias("r")).select("r.*")
