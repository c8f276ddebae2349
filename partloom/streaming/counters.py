"""Counts, limits and current states over a stream of events, with twins over the table at rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partloom.bindings import table
from partloom.registry import SQL, query
from partloom.sources.files import new_path

MINUTE, DAY = 60 * 1_000_000, 86_400 * 1_000_000
BUCKET, PER_SECOND, LATE = 30.0, 0.5, "10 minutes"
_TOLD = "user_id long, event_id long, allowed boolean, wait double"


def micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table of events as a stream of its files; a folder of files or one file."""
    return spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/events.parquet*")


def run_to_end(stream: DataFrame, mode: str, spark: SparkSession, each) -> None:
    stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, "stream")).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def in_window(length: int) -> Column:
    """Events of a key in the last length microseconds; one that is exactly as old is out."""
    return F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-(length - 1), 0))


_US = "(select *, epoch_us(ts) us from events)"


@query("k01_sliding_counts", f"select event_id, count(*) over (partition by user_id order by us range between {60 * 1_000_000 - 1} preceding and current row) last_minute, count(*) over (partition by user_id order by us range between {86_400 * 1_000_000 - 1} preceding and current row) last_day from {_US}")
def k01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("us", micros()).select("event_id", in_window(MINUTE).alias("last_minute"), in_window(DAY).alias("last_day"))


@query("k02_remaining", f"select user_id, max(n) used, greatest(0, 4 - max(n)) remaining from (select user_id, count(*) over (partition by user_id order by us range between {86_400 * 1_000_000 - 1} preceding and current row) n from {_US}) group by user_id")
def k02(spark: SparkSession, d: str) -> DataFrame:
    """The most that a user had in a day, and what is left of a limit of four."""
    rows = table(spark, d, "events").withColumn("us", micros()).select("user_id", in_window(DAY).alias("n"))
    return rows.groupBy("user_id").agg(F.max("n").alias("used")).select("user_id", "used", F.greatest(F.lit(0), 4 - F.col("used")).alias("remaining"))


@query("k03_throttled_until", "select user_id, case when max(ts + interval 1 hour) filter (where event_type = 'error') > timestamp '2024-01-15' then max(ts + interval 1 hour) filter (where event_type = 'error') end until from events group by user_id")
def k03(spark: SparkSession, d: str) -> DataFrame:
    return until(last_waits(table(spark, d, "events")))


def last_waits(rows: DataFrame) -> DataFrame:
    """An error throttles its user for an hour; the latest end counts."""
    return rows.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts").cast("timestamp_ntz") + F.expr("interval 1 hour"))).alias("t"))


def until(waits: DataFrame) -> DataFrame:
    return waits.select("user_id", F.when(F.col("t") > F.lit("2024-01-15").cast("timestamp_ntz"), F.col("t")).alias("until"))


def newest_events(rows: DataFrame, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


@query("k04_bounded_state", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) nth from events) where nth <= 20")
def k04(spark: SparkSession, d: str) -> DataFrame:
    return newest_events(table(spark, d, "events").select("user_id", "event_id", "ts"), 20).drop("ts")


@query("k05_tagged_counters", "select event_type, user_id % 3 shard, count(*) n from events group by 1, 2")
def k05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("shard")).agg(F.count("*").alias("n"))


@query("k05_tagged_counters_stream", "select event_type, user_id % 3 shard, count(*) n from events group by 1, 2")
def k05_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same counters, kept by a stream; each batch writes the whole table of counters anew."""
    path = new_path(spark, "counters")
    counted = event_stream(spark, d).groupBy("event_type", (F.col("user_id") % 3).alias("shard")).agg(F.count("*").alias("n"))
    run_to_end(counted, "complete", spark, lambda rows, n: rows.write.mode("overwrite").parquet(path))
    return spark.read.schema(counted.schema).parquet(path)


@query("k06_timers", "select event_type, count(*) n, round(sum(value), 4) total from events group by event_type")
def k06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("k07_gauges_with_zeros", "select d.on_day, k.event_type, coalesce(c.n, 0) n from (select distinct date_trunc('day', ts) as on_day from events) d cross join (select distinct event_type from events) k left join (select date_trunc('day', ts) as on_day, event_type, count(*) n from events group by 1, 2) c on c.on_day = d.on_day and c.event_type = k.event_type")
def k07(spark: SparkSession, d: str) -> DataFrame:
    return with_zeros(counts_by_day(table(spark, d, "events")))


def counts_by_day(rows: DataFrame) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return rows.groupBy(day.alias("on_day"), "event_type").agg(F.count("*").alias("n"))


def with_zeros(counts: DataFrame) -> DataFrame:
    """Snapshots by day; a group that has vanished reports 0. Days and types are few and fixed by the calendar and the
    vocabulary."""
    kinds = counts.agg(F.collect_set("event_type").alias("kinds"))
    every = counts.select("on_day").distinct().join(F.broadcast(kinds)).select("on_day", F.explode("kinds").alias("event_type"))
    return every.join(counts, ["on_day", "event_type"], "left").select("on_day", "event_type", F.coalesce("n", F.lit(0)).alias("n"))


def keep_generations(stream: DataFrame, spark: SparkSession, base: str, step: Callable[[DataFrame, DataFrame | None], dict[str, DataFrame]]) -> None:
    """Runs step on each batch and the state before it. What it returns by name is written as generation n of that name, and
    ``state`` is what the next batch gets. Batches are numbered one after the other, so after a restart the state is found by
    number, and a batch that is run again writes the same generation."""

    def each(rows: DataFrame, n: int) -> None:
        before = rows.sparkSession.read.parquet(f"{base}/state/generation={n - 1}") if n else None
        for name, out in step(rows, before).items():
            out.write.mode("overwrite").parquet(f"{base}/{name}/generation={n}")

    run_to_end(stream, "append", spark, each)


def newest(spark: SparkSession, base: str) -> DataFrame:
    """The state of the last generation."""
    every = spark.read.parquet(f"{base}/state")
    return every.where(F.col("generation") == every.agg(F.max("generation")).first()[0]).drop("generation")


def _with_state(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    return rows if before is None else rows.unionByName(before.select(*rows.columns))


def sliding_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    """user_id, event_id, last_minute and last_day of each event as it arrives. The state holds a user's events of the last
    day before the newest, so it doesn't grow with the length of the stream."""
    base = new_path(spark, "sliding")

    def step(rows: DataFrame, before: DataFrame | None) -> dict[str, DataFrame]:
        every = _with_state(rows.withColumn("now", F.lit(True)), None if before is None else before.withColumn("now", F.lit(False)))
        counts = every.select("user_id", "event_id", "now", in_window(MINUTE).alias("last_minute"), in_window(DAY).alias("last_day")).where("now").drop("now")
        last = every.drop("now").withColumn("last", F.max("us").over(Window.partitionBy("user_id")))
        return {"counts": counts, "state": last.where(F.col("us") > F.col("last") - DAY).drop("last")}

    keep_generations(event_stream(spark, d).select("user_id", "event_id", micros().alias("us")), spark, base, step)
    return spark.read.parquet(f"{base}/counts").drop("generation")


@query("k01_sliding_counts_stream", SQL["k01_sliding_counts"])
def k01_stream(spark: SparkSession, d: str) -> DataFrame:
    return sliding_counts_stream(spark, d).select("event_id", "last_minute", "last_day")


@query("k02_remaining_stream", SQL["k02_remaining"])
def k02_stream(spark: SparkSession, d: str) -> DataFrame:
    most = sliding_counts_stream(spark, d).groupBy("user_id").agg(F.max("last_day").alias("used"))
    return most.select("user_id", "used", F.greatest(F.lit(0), 4 - F.col("used")).alias("remaining"))


def _kept_complete(counted: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """A table that a stream keeps: each batch writes it anew as a generation of its own."""
    base = new_path(spark, name)
    run_to_end(counted, "complete", spark, lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/state/generation={n}"))
    return newest(spark, base)


@query("k03_throttled_until_stream", SQL["k03_throttled_until"])
def k03_stream(spark: SparkSession, d: str) -> DataFrame:
    """The state is a time for each user."""
    return until(_kept_complete(last_waits(event_stream(spark, d)), spark, "throttled"))


@query("k04_bounded_state_stream", SQL["k04_bounded_state"])
def k04_stream(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty events of each user; what is older leaves the state with the batch that brings newer ones."""
    base = new_path(spark, "bounded")
    keep_generations(event_stream(spark, d).select("user_id", "event_id", "ts"), spark, base, lambda rows, before: {"state": newest_events(_with_state(rows, before), 20)})
    return newest(spark, base).select("user_id", "event_id")


@query("k06_timers_stream", SQL["k06_timers"])
def k06_stream(spark: SparkSession, d: str) -> DataFrame:
    timed = event_stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _kept_complete(timed, spark, "timers").withColumn("total", F.round("total", 4))


@query("k07_gauges_with_zeros_stream", SQL["k07_gauges_with_zeros"])
def k07_stream(spark: SparkSession, d: str) -> DataFrame:
    return with_zeros(_kept_complete(counts_by_day(event_stream(spark, d)), spark, "gauges"))


@query("k08_upsert_stream", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) nth from events) where nth = 1")
def k08(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user: every batch is reduced to one row a key and merged with the state before it."""
    base = new_path(spark, "current")
    columns = ["user_id", "event_id", "value", "ts"]

    def step(rows: DataFrame, before: DataFrame | None) -> dict[str, DataFrame]:
        return {"state": _with_state(rows, before).groupBy("user_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("r")).select("r.*")}

    keep_generations(event_stream(spark, d).select(*columns), spark, base, step)
    return newest(spark, base).select("user_id", "event_id", "value")


def _settle(tokens: float, at: int, events: list[tuple[int, int]]) -> tuple[float, int, list[tuple[int, bool, float]]]:
    """A bucket that fills continuously: each event in its order takes a token or is told how long to wait."""
    told = []
    for us, event in events:
        tokens, at = min(BUCKET, tokens + max(0, us - at) / 1e6 * PER_SECOND), max(at, us)
        ok = tokens >= 1
        tokens -= ok
        told.append((event, bool(ok), 0.0 if ok else (1 - tokens) / PER_SECOND))
    return tokens, at, told


def _told(user: int, told: list[tuple[int, bool, float]]) -> pd.DataFrame:
    return pd.DataFrame([(user, *t) for t in told], columns=["user_id", "event_id", "allowed", "wait"]).astype({"user_id": "int64", "event_id": "int64", "allowed": "bool", "wait": "float64"})


def take_tokens(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events wait in the state until the watermark has passed them, so batches may bring them out of order; a timer calls for
    those whose key gets no more events. A bucket that is full again and has nothing waiting leaves the state by a timer too:
    the key's next event finds a new bucket, which is full as well."""
    tokens, at, us, ids = state.get if state.exists else (BUCKET, 0, [], [])
    waiting = list(zip(us, ids))
    if not state.hasTimedOut:
        for frame in frames:
            waiting += zip(frame["us"], frame["event_id"])
    passed = state.getCurrentWatermarkMs()
    waiting.sort()
    tokens, at, told = _settle(tokens, at, [e for e in waiting if e[0] <= passed * 1000])
    waiting = waiting[len(told) :]
    full = at // 1000 + int((BUCKET - tokens) / PER_SECOND * 1000) + 2
    if waiting or full > passed:
        state.update((float(tokens), int(at), [int(u) for u, _ in waiting], [int(e) for _, e in waiting]))
        state.setTimeoutTimestamp(-(-int(waiting[0][0]) // 1000) if waiting else full)
    elif state.exists:
        state.remove()
    if told:
        yield _told(key[0], told)


def settle_waiting(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([_told(r.user_id, _settle(r.tokens, r.at, list(zip(r.us, r.ids)))[2]) for r in frame.itertuples()])


def run_token_bucket(events: DataFrame, base: str, late: str = LATE) -> None:
    """Answers of a stream of events (user_id, event_id, ts) as a table below base; user_id, event_id and ts aren't null. Started
    again on the same base it goes on where it stopped. An event that comes more than ``late`` after newer ones of a batch
    before has no place in the order any more, and no answer."""
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    told = rows.groupBy("user_id").applyInPandasWithState(take_tokens, _TOLD, "tokens double, at long, us array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    told.writeStream.outputMode("append").option("checkpointLocation", f"{base}/stream").option("path", f"{base}/told").format("parquet").trigger(availableNow=True).start().awaitTermination()


def bucket_states(spark: SparkSession, base: str) -> DataFrame:
    """user_id, tokens, at, us and ids (what waits) of the keys that the stream holds."""
    return spark.read.format("statestore").load(f"{base}/stream").select("key.user_id", "value.groupState.*")


def token_answers(spark: SparkSession, base: str) -> DataFrame:
    """All answers as if the stream ended here: those written, and those of events that wait for the watermark still."""
    waiting = bucket_states(spark, base).where(F.size("us") > 0)
    rest = waiting.mapInPandas(lambda frames: map(settle_waiting, frames), _TOLD)
    return spark.read.schema(_TOLD).parquet(f"{base}/told").union(rest)


@query("k10_token_bucket")
def k10(spark: SparkSession, d: str) -> DataFrame:
    base = new_path(spark, "tokens")
    run_token_bucket(event_stream(spark, d), base)
    return token_answers(spark, base)
