"""What an offer's stock, flags and status text say of an order: its lifecycle, its availability and notes on it.

Flags are declared in a table: what each makes of the status and of the lifecycle, and its note. The status is the most severe
of all that apply, in the declared order. All of it is one expression over an offer's columns, without joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.bindings import offers, with_views
from partloom.operators.matching import KEY
from partloom.registry import query


@dataclass(frozen=True)
class Flag:
    flag: str
    note: str
    status: str = ""
    lifecycle: str = ""
    always: bool = True  # else noted only where all notes are asked for
    unless: str = ""  # not noted beside this flag


#: Statuses, the most severe first; lifecycles by precedence; texts that stand for the end of a life.
SEVERITY = ("special_order", "external_warehouse", "last_units", "limited", "low_stock", "in_stock")
LIFECYCLES = ("last_time_buy", "supply_constrained", "new", "active")
END_OF_LIFE = ("end of life", "eol", "obsolete", "not recommended for new designs", "nrnd", "last time buy")
#: In the order of their notes.
FLAGS = (
    Flag("ONLY_FOR_SPECIAL_ORDER", "By special order only.", status="special_order"),
    Flag("CANNOT_BE_ORDERED", "Not for sale here.", status="special_order"),
    Flag("EXTERNAL_WAREHOUSE", "Comes from another warehouse, and later.", status="external_warehouse"),
    Flag("AVAILABLE_WHILE_STOCKS_LAST", "No new stock will come.", status="last_units", lifecycle="last_time_buy"),
    Flag("HARDLY_AVAILABLE", "Scarce on the market.", lifecycle="supply_constrained"),
    Flag("MOQ_VALID_WHILE_STOCKS_LAST", "The smallest order may change with the next stock."),
    Flag("DANGEROUS", "Restricted shipping: dangerous goods."),
    Flag("OVERSIZED", "Restricted shipping: oversized.", unless="DANGEROUS"),
    Flag("NEW", "New in the catalogue.", lifecycle="new", always=False),
    Flag("PROMOTED", "Promoted.", always=False),
)
LOW_STOCK = 10
SHIPS_NOW = "Ships now."


def _stated(text: Column) -> Column:
    """Without outer blanks; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def ends(text: Column) -> Column:
    return F.coalesce(F.lower(_stated(text)).isin(*END_OF_LIFE), F.lit(False))


def _has(flags: Column, flag: str) -> Column:
    return F.coalesce(F.array_contains(flags, flag), F.lit(False))


def lifecycle(flags: Column, text: Column, declared: tuple[Flag, ...] = FLAGS) -> Column:
    """The first by precedence of what flags and text say; active if they say nothing. Null flags are none."""
    said = [F.when(_has(flags, f.flag), F.lit(LIFECYCLES.index(f.lifecycle))) for f in declared if f.lifecycle]
    said += [F.when(ends(text), F.lit(LIFECYCLES.index("last_time_buy"))), F.when(F.lower(_stated(text)).startswith("new"), F.lit(LIFECYCLES.index("new")))]
    return F.element_at(F.array(*map(F.lit, LIFECYCLES)), F.coalesce(F.array_min(F.array(*said)), F.lit(len(LIFECYCLES) - 1)) + 1)


def low_stock(stock: Column, quantity: Column, threshold: int = LOW_STOCK) -> Column:
    """Enough for the order, but below the threshold or twice the order."""
    asked = F.greatest(quantity, F.lit(1))
    return (stock >= asked) & ((stock < threshold) | (stock < 2 * asked))


def availability(stock: Column, quantity: Column, flags: Column, text: Column, most: Column, full: Column, *, threshold: int = LOW_STOCK, declared: tuple[Flag, ...] = FLAGS) -> Column:
    """status and note. ``most`` is the largest order that is taken (null or 0: any), ``full`` asks for notes that don't bear on
    the order as well. An offer without stock is out of stock whatever its flags say. Null flags are none."""
    short, low = stock < quantity, low_stock(stock, quantity, threshold)
    severity = [F.when(_has(flags, f.flag), F.lit(SEVERITY.index(f.status))) for f in declared if f.status]
    severity += [F.when(ends(text), F.lit(SEVERITY.index("last_units"))), F.when(short, F.lit(SEVERITY.index("limited"))), F.when(low & ~short, F.lit(SEVERITY.index("low_stock")))]
    worst = F.coalesce(F.array_min(F.array(*severity)), F.lit(len(SEVERITY) - 1))
    of = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    count, asked = stock.cast("string"), quantity.cast("string")
    notes = [
        F.when(short, of("Only ", count, " in stock, ", asked, " are asked for."))
        .when(low, F.when(quantity > 1, of("Only ", count, " in stock, less than twice the ", asked, " asked for.")).otherwise(of("Only ", count, " in stock.")))
        .when(worst == len(SEVERITY) - 1, F.lit(SHIPS_NOW))
    ]
    for f in declared:
        told = _has(flags, f.flag) & (F.lit(True) if f.always else full)
        notes.append(F.when(told & ~_has(flags, f.unless) if f.unless else told, F.lit(f.note)))
    notes.append(F.when(_stated(text).isNotNull() & (ends(text) | full), of("Status: ", _stated(text), ".")))
    notes.append(F.when((most > 0) & (full | (quantity > most)), of("At most ", most.cast("string"), " an order.")))
    none = F.struct(F.lit("out_of_stock").alias("status"), F.lit("Out of stock.").alias("note"))
    some = F.struct(F.element_at(F.array(*map(F.lit, SEVERITY)), worst + 1).alias("status"), F.concat_ws(" ", *notes).alias("note"))
    return F.when(stock <= 0, none).otherwise(some)


def stale(current: Column, stock: Column, confirmed: Column, now: Column) -> Column:
    """Of an offer whose stock couldn't be confirmed again: when it was, what it was, and the other notes. Nothing ships now for
    certain any more, so that note goes."""
    days = F.timestamp_diff("DAY", confirmed, now)
    when = F.concat(F.lit(" on "), F.date_format(confirmed, "yyyy-MM-dd"), F.lit(" ("), days.cast("string"), F.when(days == 1, " day").otherwise(" days"), F.lit(" ago)"))
    last = F.concat(F.lit("Last confirmed"), F.coalesce(when, F.lit("")), F.lit("; last known stock: "), stock.cast("string"), F.lit("."))
    rest = F.nullif(F.trim(F.regexp_replace(current.getField("note"), f"^{SHIPS_NOW.replace('.', '[.]')}", "")), F.lit(""))
    return F.struct(F.lit("stale").alias("status"), F.concat_ws(" ", last, rest).alias("note"))


# The given tables hold no flags, status texts or largest orders: they are made from numbers of the parts and suppliers.
_EVERY = (17, 19, 13, 11, 7, 6, 9, 5, 4, 3)
_FLAGS = "concat_ws('|', " + ", ".join(f"case when (pk * 3 + sk) % {n} = 1 then '{f.flag}' end" for f, n in zip(FLAGS, _EVERY)) + ")"
_TEXT = "case (pk + sk) % 12 when 0 then 'Obsolete' when 1 then ' New Product ' when 2 then 'NRND' when 3 then '' when 4 then 'Active' when 5 then 'End of Life' when 6 then ' ' end"
_STATED = f"select *, {_FLAGS} flags, {_TEXT} status_text, cast(1 + pk % 60 as bigint) wanted, case when sk % 3 = 0 then cast(sk % 50 as bigint) end most, pk % 2 = 0 in_full from offers"
NOW, DAYS = "1998-12-01 00:00:00", 1500


def stated(spark: SparkSession, d: str) -> DataFrame:
    rows = offers(spark, d).withColumns({"flags": F.expr(_FLAGS), "status_text": F.expr(_TEXT), "wanted": F.expr("cast(1 + pk % 60 as bigint)"), "most": F.expr("case when sk % 3 = 0 then cast(sk % 50 as bigint) end"), "in_full": F.expr("pk % 2 = 0")})
    return rows.withColumn("flags", F.split("flags", "[|]"))


_ENDS = f"lower(trim(coalesce(status_text, ''))) in ({', '.join(repr(t) for t in END_OF_LIFE)})"


def _any(values: dict[str, str]) -> str:
    return " ".join(f"when {condition} then '{value}'" for value, condition in values.items())


def _flagged(**by: str) -> str:
    (kind, value), = by.items()
    return "(" + " or ".join(f"list_contains(fs, '{f.flag}')" for f in FLAGS if getattr(f, kind) == value) + ")"


_LOW = f"(stock < {LOW_STOCK} or stock < 2 * wanted)"
_STATUS_SQL = "case when stock <= 0 then 'out_of_stock' " + _any({"special_order": _flagged(status="special_order"), "external_warehouse": _flagged(status="external_warehouse"), "last_units": f"({_flagged(status='last_units')} or {_ENDS})", "limited": "stock < wanted", "low_stock": _LOW}) + " else 'in_stock' end"
_NOTES = ", ".join(f"case when list_contains(fs, '{f.flag}')" + ("" if f.always else " and in_full") + (f" and not list_contains(fs, '{f.unless}')" if f.unless else "") + f" then '{f.note}' end" for f in FLAGS)
_OLD = f"date_sub('day', cast(fetched_at as timestamp), timestamp '{NOW}')"
_AVAILABLE_SQL = with_views(
    f"""
, s as ({_STATED}), f as (select *, string_split(flags, '|') fs from s),
a as (select *, {_STATUS_SQL} status from f),
n as (
  select *, concat_ws(' ', {_NOTES}, case when trim(status_text) <> '' and ({_ENDS} or in_full) then 'Status: ' || trim(status_text) || '.' end,
                      case when most > 0 and (in_full or wanted > most) then 'At most ' || most || ' an order.' end) others,
         case when stock < wanted then 'Only ' || stock || ' in stock, ' || wanted || ' are asked for.'
              when {_LOW} then 'Only ' || stock || ' in stock' || case when wanted > 1 then ', less than twice the ' || wanted || ' asked for.' else '.' end
              when status = 'in_stock' then '{SHIPS_NOW}' end head
  from a),
t as (select *, case when status = 'out_of_stock' then 'Out of stock.' else concat_ws(' ', head, nullif(others, '')) end note from n)
select source, part_number, case when {_OLD} > {DAYS} then 'stale' else status end status,
       case when {_OLD} > {DAYS} then concat_ws(' ', 'Last confirmed on ' || strftime(fetched_at, '%Y-%m-%d') || ' (' || {_OLD} || ' days ago); last known stock: ' || stock || '.',
                 case when status = 'in_stock' and head = '{SHIPS_NOW}' then nullif(others, '') else note end) else note end note
from t""",
    "offers",
)


@query("b34_declared_availability", _AVAILABLE_SQL)
def b34_declared(spark: SparkSession, d: str) -> DataFrame:
    """Every offer for an order of a quantity, stale ones as such."""
    rows = stated(spark, d).withColumn("current", availability(F.col("stock"), F.col("wanted"), F.col("flags"), F.col("status_text"), F.col("most"), F.col("in_full")))
    confirmed, now = F.col("fetched_at").cast("timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz")
    told = F.when(F.timestamp_diff("DAY", confirmed, now) > DAYS, stale(F.col("current"), F.col("stock"), confirmed, now)).otherwise(F.col("current"))
    return rows.select(*KEY, told.alias("told")).select(*KEY, "told.status", "told.note")


@query("b35_declared_lifecycle", with_views(f", s as ({_STATED}), f as (select *, string_split(flags, '|') fs from s) select source, part_number, case when {_flagged(lifecycle='last_time_buy')} or {_ENDS} then 'last_time_buy' when {_flagged(lifecycle='supply_constrained')} then 'supply_constrained' when {_flagged(lifecycle='new')} or lower(trim(status_text)) like 'new%' then 'new' else 'active' end lifecycle from f", "offers"))
def b35_declared(spark: SparkSession, d: str) -> DataFrame:
    return stated(spark, d).select(*KEY, lifecycle(F.col("flags"), F.col("status_text")).alias("lifecycle"))
