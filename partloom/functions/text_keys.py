"""Normal forms of texts, identifiers and codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.bindings import offers, table, with_views
from partloom.operators.matching import KEY, normal_identifier
from partloom.registry import query

#: Symbols folded to ASCII.
FOLDED, FOLDS = "µμ", "uu"
#: Phrase rewrites, applied in this order.
REWRITES = ((r"\+/-", "±"), (r"(?<=\d),(?=\d)", "."), (r"\bvolts?\b", "V"), (r"(\d) +(uF|V|ohm)\b", "$1$2"))
#: Words of classes with their priority; the smallest wins.
CLASS_WORDS = (("widget", "device", 1), ("gear", "drive", 2), ("bolt", "fastener", 3), ("ring", "fastener", 3), ("red", "coloured", 8), ("blue", "coloured", 8), ("old", "used", 9))
#: Package codes with the code that they stand for.
CODE_ALIASES = {
    "SOT-23-3": "SOT-23", "SOT-25": "SOT-23-5", "SOT-753": "SOT-23-5", "SOT-26": "SOT-23-6", "TO-236": "SOT-23", "TO-236AB": "SOT-23", "SC-70": "SOT-323",
    "SC-70-3": "SOT-323", "SOT-323-3": "SOT-323", "SC-70-5": "SOT-353", "SC-70-6": "SOT-363", "SC-88": "SOT-363", "SC-88A": "SOT-353", "SC-59": "SOT-23",
    "SOT-223-3": "SOT-223", "SOT-223-4": "SOT-223", "SOT-89-3": "SOT-89", "DPAK": "TO-252", "TO-252AA": "TO-252", "TO-252-3": "TO-252", "D2PAK": "TO-263",
    "TO-263AB": "TO-263", "TO-263-3": "TO-263", "TO-220AB": "TO-220", "TO-220-3": "TO-220", "TO-92-3": "TO-92", "TO-247-3": "TO-247", "DO-214AC": "SMA",
    "DO-214AA": "SMB", "DO-214AB": "SMC", "SOD-123FL": "SOD-123F", "MINI-MELF": "MINIMELF", "LL-34": "MINIMELF", "LL34": "MINIMELF",
}
#: Classes of packages that are told apart by their number of leads alone, and those that are one class.
LEADED = (
    "SOIC", "SOP", "SO", "SSOP", "TSSOP", "MSOP", "QSOP", "VSSOP", "HTSSOP", "HSOP", "ESOP", "QFN", "DFN", "VQFN", "WQFN", "UQFN", "TQFN", "LQFP", "TQFP", "QFP", "BGA", "LGA", "WLCSP", "DIP", "PDIP", "SIP", "ZIP", "PLCC", "SON", "WSON", "VSON", "TDFN", "UDFN", "XDFN", "USON", "LFCSP", "CSP",
)
SAME_CLASS = {"SO": "SOIC", "SOP": "SOIC", "PDIP": "DIP"}
#: Spellings that the queries on codes give to parts in turn.
SPELLINGS = ("so-8", "SOP-8-EP", "SOIC-8_150mil", "TO-236AB", "SOT-23-3L", "sot-23", "DPAK", " TO-252-3 ", "PDIP-14", "QFN-16(EP)", "0603", "")
#: Metric sizes and the imperial ones they stand for.
IMPERIAL = (("1005", "0402"), ("1608", "0603"), ("2012", "0805"), ("3216", "1206"))


def normal_key(c: Column) -> Column:
    """Lower case, folded symbols, single blanks."""
    folded = F.regexp_replace(F.translate(F.lower(c), FOLDED, FOLDS), "ω", "ohm")
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def prepared(c: Column) -> Column:
    for pattern, to in REWRITES:
        c = F.regexp_replace(c, pattern, to)
    return c


def tokens(c: Column) -> Column:
    """Words without punctuation at their edges; those without a letter or digit go."""
    words = F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.filter(words, lambda w: w != "")


def code_key(c: Column) -> Column:
    """Equal for codes of the same package: the L of a lead count goes, aliases and classes are merged, what follows the leads
    and all punctuation goes. Null for blank codes."""
    looked_up = lambda table, k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), k), k)
    code = looked_up(CODE_ALIASES, F.regexp_replace(F.upper(F.trim(c)), _LEADS, "$1"))
    part = lambda i: F.regexp_extract(code, _LEADED, i)
    named = F.when(part(1) != "", F.concat(looked_up(SAME_CLASS, part(1)), part(2))).otherwise(code)
    return F.when(F.trim(c) != "", F.regexp_replace(named, "[^A-Z0-9]", ""))


def spelling(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SPELLINGS)), (n % len(SPELLINGS) + 1).cast("int"))


#: A lead count that may end in L; a class, its leads and what follows.
_LEADS = "^((?:SOT|SOD|SC|TO)-[0-9]{2,3}-[0-9]{1,2})L$"
_LEADED = f"^({'|'.join(LEADED)})-([0-9]{{1,4}}).*$"
_listed = lambda pairs: "map {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"
SPELLING_SQL = "([" + ", ".join(f"'{x}'" for x in SPELLINGS) + f"])[{{}} % {len(SPELLINGS)} + 1]"
#: The key of column code as a lateral chain of SQL columns.
CODE_KEY_SQL = f"""regexp_replace(upper(trim(code)), '{_LEADS}', '\\1') c1, coalesce({_listed(CODE_ALIASES)}[c1], c1) c2, regexp_extract(c2, '{_LEADED}', 1) c3,
case when trim(code) = '' then null else regexp_replace(case when c3 <> '' then concat(coalesce({_listed(SAME_CLASS)}[c3], c3), regexp_extract(c2, '{_LEADED}', 2)) else c2 end, '[^A-Z0-9]', '', 'g') end code_key"""


def phrase_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens(F.lower(c)))), " ")


def looks_like_identifier(w: Column) -> Column:
    """Letters and digits mixed, five characters or more, and neither a value with its unit nor a size."""
    return (F.length(w) >= 5) & w.rlike("[A-Za-z]") & w.rlike("[0-9]") & ~w.rlike(r"^[0-9.]+(uF|V|ohm|Hz)$") & ~w.rlike(r"^[0-9]+x[0-9]+$")


def class_of(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """key and the class of the word with the first priority, by an equality join with the vocabulary."""
    vocabulary = rows.sparkSession.createDataFrame(list(CLASS_WORDS), "word string, class string, priority int")
    return rows.select(key, F.explode(words).alias("word")).join(vocabulary, "word").groupBy(key).agg(F.min(F.struct("priority", "class")).alias("m")).select(key, F.col("m.class").alias("class"))


_TEXT = "select doc_id, {} from documents"


@query("b01_normal_key", _TEXT.format("trim(regexp_replace(replace(translate(lower(text), 'µμ', 'uu'), 'ω', 'ohm'), '\\s+', ' ', 'g')) as text_key"))
def b01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normal_key(F.col("text")).alias("text_key"))


@query("b02_prepared", with_views("select part_number, source, regexp_replace(regexp_replace(replace(concat('tol +/-5 ', description, ' 3,5 volts'), '+/-', '±'), '([0-9]),([0-9])', '\\1.\\2', 'g'), '\\bvolts?\\b', 'V', 'g') as text from offers", "offers").replace("regexp_replace(regexp_replace(replace(", "regexp_replace(regexp_replace(regexp_replace(replace(").replace("'V', 'g')", "'V', 'g'), '([0-9]) +(uF|V|ohm)\\b', '\\1\\2', 'g')"))
def b02(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select(*KEY, prepared(F.concat(F.lit("tol +/-5 "), "description", F.lit(" 3,5 volts"))).alias("text"))


@query("b03_tokens", _TEXT.format("len(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda w: w <> '')) n_tokens"))
def b03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("b10_code_key", f"select p_partkey, code, code_key from (select *, {CODE_KEY_SQL} from (select p_partkey, {SPELLING_SQL.format('p_partkey')} code from part))")
def b10(spark: SparkSession, d: str) -> DataFrame:
    code = spelling(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", code.alias("code"), code_key(code).alias("code_key"))


@query("b11_labelled_metric_code", f"select p_partkey, coalesce(m.imperial, '') code from (select p_partkey, regexp_extract(concat(case when p_partkey % 2 = 0 then 'metric ' else '' end, case p_partkey % 3 when 0 then '1608' when 1 then '3216' else '0603' end), 'metric ([0-9]{{4}})', 1) found from part) left join (values {', '.join(str(a) for a in IMPERIAL)}) m(metric, imperial) on m.metric = found")
def b11(spark: SparkSession, d: str) -> DataFrame:
    """A code is metric only where the text says so."""
    pk = F.col("p_partkey")
    text = F.concat(F.when(pk % 2 == 0, "metric ").otherwise(""), F.when(pk % 3 == 0, "1608").when(pk % 3 == 1, "3216").otherwise("0603"))
    found = table(spark, d, "part").select("p_partkey", F.regexp_extract(text, "metric ([0-9]{4})", 1).alias("metric"))
    return found.join(spark.createDataFrame(list(IMPERIAL), "metric string, imperial string"), "metric", "left").select("p_partkey", F.coalesce("imperial", F.lit("")).alias("code"))


@query("b13_first_class", f"select p_partkey, arg_min(class, priority) as class from (select p_partkey, unnest(string_split(p_name, ' ')) word from part) join (values {', '.join(str(a) for a in CLASS_WORDS)}) v(word, class, priority) using (word) group by 1")
def b13(spark: SparkSession, d: str) -> DataFrame:
    return class_of(table(spark, d, "part"), "p_partkey", F.split("p_name", " "))


@query("b14_all_classes", f"select p_partkey, string_agg(distinct class, ',' order by class) classes from (select p_partkey, unnest(string_split(p_name, ' ')) word from part) join (values {', '.join(str(a) for a in CLASS_WORDS)}) v(word, class, priority) using (word) group by 1")
def b14(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = spark.createDataFrame(list(CLASS_WORDS), "word string, class string, priority int")
    found = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).join(vocabulary, "word")
    return found.groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("class")), ",").alias("classes"))


@query("b27_identifier_tokens", _TEXT.format("len(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda w: length(w) >= 5 and regexp_matches(w, '[A-Za-z]') and regexp_matches(w, '[0-9]') and not regexp_matches(w, '^[0-9.]+(uF|V|ohm|Hz)$') and not regexp_matches(w, '^[0-9]+x[0-9]+$'))) n_ids"))
def b27(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(tokens(F.col("text")), looks_like_identifier)).cast("long").alias("n_ids"))


@query("b28_normal_identifier", with_views("select part_number, source, upper(regexp_replace(mpn, '[^A-Za-z0-9]', '', 'g')) as name from offers", "offers"))
def b28(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select(*KEY, normal_identifier(F.col("mpn")).alias("name"))


@query("b29_bounded_label", "select event_id, case when event_type in ('click', 'view', 'error') then event_type else 'unknown' end as label from events")
def b29(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("event_type").isin("click", "view", "error")
    return table(spark, d, "events").select("event_id", F.when(known, F.col("event_type")).otherwise("unknown").alias("label"))


@query("b33_url_rewrite", "select page_id, case when contains(url, '.example.net/') then regexp_replace(url, '^http://', 'https://') else url end as url from pages")
def b33(spark: SparkSession, d: str) -> DataFrame:
    rewritten = F.when(F.col("url").contains(".example.net/"), F.regexp_replace("url", "^http://", "https://")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", rewritten.alias("url"))


@query("b39_canonical_tags", "select event_id, concat('k=', json_extract_string(props, '$.k'), ',type=', event_type) as tags from events")
def b39(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.map_concat(F.create_map(F.lit("type"), F.col("event_type")), F.from_json("props", "map<string,string>"))
    return table(spark, d, "events").select("event_id", canonical_tags(pairs).alias("tags"))


def canonical_tags(tags: Column) -> Column:
    """Sorted k=v, with separators in values escaped; no tags give none."""
    escaped = lambda v: F.regexp_replace(v, r"([\\,=])", r"\\$1")
    listed = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e.key, F.lit("="), escaped(e.value)))
    return F.when(F.size(tags) > 0, F.array_join(listed, ",")).otherwise("none")


@query("i13_phrase_key", "select item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda w: w <> ''))), ' ') phrase from benchmark")
def i13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", phrase_key(F.col("text")).alias("phrase"))
