"""Every query of the library against its SQL in DuckDB, at the smallest size."""

import datetime
import decimal
import math

import duckdb
import pytest

from partloom.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, decimal.Decimal):
        return repr(float(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return repr(x)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_token_bucket_never_allows_more_than_it_fills(spark, small):
    told = QUERIES["k10_token_bucket"](spark, small).join(spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts"), "event_id").where("allowed").toPandas()
    for _, rows in told.groupby("user_id"):
        at = rows.ts.sort_values().astype("int64").to_numpy() / 1e9
        for i in range(len(at)):
            for j in range(i, min(len(at), i + 60)):
                assert j - i + 1 <= 30 + 0.5 * (at[j] - at[i]) + 1e-6


def test_token_bucket_equals_the_loop(spark, small):
    from partloom.streaming.counters import BUCKET, PER_SECOND

    got = {r.event_id: (r.allowed, round(r.wait, 6)) for r in QUERIES["k10_token_bucket"](spark, small).collect()}
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) us").toPandas()
    assert len(got) == len(events)
    for _, own in events.sort_values(["us", "event_id"]).groupby("user_id"):
        tokens, before = BUCKET, None
        for event, us in zip(own.event_id, own.us):
            tokens = tokens if before is None else min(BUCKET, tokens + (us - before) / 1e6 * PER_SECOND)
            before = us
            ok = tokens >= 1
            tokens -= ok
            assert got[event] == (ok, round(0.0 if ok else (1 - tokens) / PER_SECOND, 6))


def test_token_bucket_over_batches_out_of_order_and_a_restart(spark, tmp_path):
    """Events come out of order within the time allowed, in five files; the stream stops after two of them and starts again."""
    import datetime
    import random

    from partloom.streaming import counters

    rng = random.Random(3)
    begin = datetime.datetime(2024, 1, 1)
    seconds = sorted(rng.choice([rng.uniform(0, 60), rng.uniform(300, 420), rng.uniform(0, 20_000)]) for _ in range(1200))
    made = [(rng.randrange(4) if s < 15_000 else 99, i, begin + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    arriving = sorted(made, key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 500)))  # later than newer ones by less than ten minutes
    schema = "user_id long, event_id long, ts timestamp_ntz"
    part = len(arriving) // 5
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for n in range(5):
        spark.createDataFrame(arriving[n * part : (n + 1) * part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
        if n in (1, 4):
            counters.run_token_bucket(stream, str(tmp_path / "base"))
    got = {r.event_id: (r.allowed, round(r.wait, 6)) for r in counters.token_answers(spark, str(tmp_path / "base")).collect()}
    want, state = {}, {}
    for user, event, ts in sorted(made, key=lambda r: (r[2], r[1])):
        tokens, at = state.get(user, (counters.BUCKET, ts))
        tokens = min(counters.BUCKET, tokens + (ts - at).total_seconds() * counters.PER_SECOND)
        want[event] = (tokens >= 1, 0.0 if tokens >= 1 else round((1 - tokens) / counters.PER_SECOND, 6))
        state[user] = (tokens - (tokens >= 1), ts)
    assert got == want and len({a for a, _ in want.values()}) == 2
    assert {r.user_id for r in counters.bucket_states(spark, str(tmp_path / "base")).collect()} == {99}  # the others' buckets are full again


def test_best_offers_equal_the_whole_order(spark):
    """Blocks with many offers of equal attributes, stock and price, and requests with fewer offers than places."""
    from partloom.operators.assessment import assessed, total_order
    from partloom.operators.checks import conflicts
    from partloom.operators.matching import candidate_join
    from partloom.plans.best_offers import best_offers
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    made = [(f"S{i % 3}", f"P{i}", "M", "m", "PROMO" if i < 500 else "ECONOMY", [None, 5.0, 6.0, 9.0][i % 4], [None, 10.0, 40.0][i % 3], [None, "red", "old"][i % 5 % 3], "bolt", [0, 1, 7, 7, 500, 10**6][i % 6], 1 + i % 2, 1, [1.0, 900.0, 905.5, 2000.0][i // 7 % 4], 1, "d", None, i, i % 90) for i in range(520)]
    shop = spark.createDataFrame(made, "source string, part_number string, manufacturer string, mpn string, family string, size_v double, rating_v double, colour string, kind string, stock long, moq int, order_multiple int, unit_price double, extractor_version int, description string, fetched_at timestamp_ntz, pk long, sk long")
    asked = spark.createDataFrame([(r, ["PROMO", "ECONOMY", "LARGE"][r % 3], 5.0 + r % 3, [None, 20.0][r % 2], [None, "red"][r // 2 % 2], "M", 1 + r, 1 + r % 7) for r in range(24)], "request_id long, family string, want_size double, min_rating double, want_colour string, maker string, quantity int, max_results int")
    own = Window.partitionBy("request_id")
    whole = assessed(candidate_join(asked, shop, 2.0)).withColumn("out", F.size(conflicts()) > 0).withColumn("left_out", F.count_if("out").over(own)).where("not out")
    whole = whole.withColumn("nth", F.row_number().over(own.orderBy(*total_order()))).where("nth <= max_results")
    columns = ("request_id", "nth", "source", "part_number", "tier", "final", "left_out")
    assert sorted(map(tuple, best_offers(asked, shop).select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))


def test_relaxation_equals_the_loop(spark):
    from partloom.operators.ranking import relaxation

    rows = [(r, (r * 7 + i * i) % 3, i % 4 == 0) for r in range(40) for i in range(r)]
    got = {r.request_id: r.step for r in relaxation(spark.createDataFrame(rows, "request_id int, step int, confirmed boolean"), 3, 10).collect()}
    for r in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == r]
        want = next((s for s in range(3) if sum(x[1] <= s for x in own) >= 10 and any(x[2] for x in own if x[1] <= s)), 2)
        assert got[r] == want


def test_upsert_twice_changes_nothing(spark, small):
    from partloom.bindings import offers
    from partloom.operators.state import new_state, old_state, upsert

    rows = offers(spark, small)
    once = upsert(old_state(rows), new_state(rows))
    assert upsert(once, new_state(rows)).exceptAll(once).count() == 0


@pytest.mark.parametrize("name", ["k01_sliding_counts", "k02_remaining", "k03_throttled_until", "k04_bounded_state", "k06_timers", "k07_gauges_with_zeros"])
def test_streams_of_several_batches_equal_the_table_at_rest(spark, small, tmp_path, name):
    """Events in order of time, in three files that the stream takes one by one."""
    rows = spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id").toPandas()
    (tmp_path / "events.parquet").mkdir()
    bounds = [0, len(rows) // 4, len(rows) // 2, len(rows)]
    for i in range(3):
        part = rows.iloc[bounds[i] : bounds[i + 1]].reset_index(drop=True)
        part.to_parquet(tmp_path / "events.parquet" / f"part-{i}.parquet", coerce_timestamps="us")
    of = lambda n: sorted(tuple(plain(x) for x in r) for r in QUERIES[n](spark, str(tmp_path)).collect())
    assert of(f"{name}_stream") == of(name)


@pytest.mark.parametrize("penalty", [1.0, 0.3, 0.05])
def test_stale_rows_go_where_the_loop_puts_them(spark, penalty):
    """Each stale row in turn goes before the first fresh row of its group that scores less, or the first of a later group."""
    from partloom.operators.ranking import stale_last

    lists = {r: [(r, i * 3 // 25, i, round(1 - (i // 2) * 0.04, 6), (i * i + r) % 3 == 0) for i in range(25)] for r in range(12)}
    rows = spark.createDataFrame([x for own in lists.values() for x in own], "request_id int, grp int, rank int, score double, stale boolean")
    got = {(x.request_id, x["rank"]): x.nth for x in stale_last(rows, penalty, "nth").collect()}
    for r, own in lists.items():
        out = [x for x in own if not x[4]]
        for x in (x for x in own if x[4]):
            left = round(x[3] - penalty, 6)
            at = next((i for i, o in enumerate(out) if o[1] > x[1] or (o[1] == x[1] and not o[4] and o[3] < left)), len(out))
            out.insert(at, x)
        assert [got[r, x[2]] for x in out] == list(range(1, len(out) + 1))


def test_transfers_keep_totals_and_move_nothing_twice(spark):
    from partloom.operators.aggregates import transfers

    series = [("a", "x", 10, 4, 0), ("a", "y", 7, 0, 2), ("a", "z", 3, 5, 0), ("b", "x", 9, 0, 0), ("b", "y", 9, 0, 0), ("b", "z", 9, 0, 0), ("c", "x", 4, 0, 0)]
    pools, names = {"a": 20, "b": 10}, "event_type string, tag string, target long, live long, moved long"
    run = lambda rows, left: transfers(spark.createDataFrame(rows, names), spark.createDataFrame(list(left.items()), "event_type string, pool long"), "event_type", "tag").collect()
    first = {(r.event_type, r.tag): r for r in run(series, pools)}
    assert {k: r.amount for k, r in first.items()} == {("a", "x"): 6, ("a", "y"): 5, ("a", "z"): 0, ("b", "x"): 4, ("b", "y"): 3, ("b", "z"): 3, ("c", "x"): 0}
    assert {k: r.pool_left for k, r in first.items()} == {("a", t): 9 for t in "xyz"} | {("b", t): 0 for t in "xyz"} | {("c", "x"): 0}
    again = [(n, t, target, live + first[n, t].amount, moved + first[n, t].amount) for n, t, target, live, moved in series]
    assert all(r.amount == 0 for r in run(again, {"a": 9, "b": 0}))
