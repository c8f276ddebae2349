"""Equal requests are judged once, and each of them gets what was found."""

import json

import pytest
from pyspark.sql import functions as F

from partloom import bindings
from partloom.catalogue import QUERIES


def test_alike_keeps_apart_what_differs(spark):
    rows = [(i, "PROMO", float(i % 2), None if i % 3 else 10.0, [None, "red"][i % 5 == 0], "M", 1, 5) for i in range(0, 400_000, 50)] + [(-100, "PROMO", 0.0, 10.0, "red", "M", 1, 5), (7, "PROMO", 0.0, None, None, None, 1, 5)]
    asked = spark.createDataFrame(rows, "request_id long, family string, want_size double, min_rating double, want_colour string, maker string, quantity int, max_results int")
    heads, members = bindings.alike(asked)
    assert heads.columns == asked.columns
    head = {r.request_id: tuple(r)[1:] for r in heads.collect()}
    given = [(r.request_id, i) for r in members.collect() for i in r.ids]
    own = {r[0]: r[1:] for r in rows}
    assert sorted(i for _, i in given) == sorted(own)  # every request once
    assert all(head[h] == own[i] and h <= i and abs(h) % bindings.REPEATS == abs(i) % bindings.REPEATS for h, i in given)
    assert len(head) == len({(v, i % 100) for i, v in own.items()})
    assert members.agg(F.max(F.size("ids"))).first()[0] <= bindings.ID_RANGE // 50


@pytest.fixture(scope="module")
def repeated(spark, small, tmp_path_factory):
    """The smallest tables with 40 times the customers: of each 300, all agree in everything but their number."""
    folder = tmp_path_factory.mktemp("repeated")
    for name in ("lineitem", "part", "orders"):
        (folder / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    spark.range(6000).select(F.col("id").alias("c_custkey")).write.parquet(str(folder / "customer.parquet"))
    return str(folder)


def joined_rows(df):
    """Rows that a join puts out or a window sorts, of the whole plan as it ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
            continue
        if ("Join" in name or name in ("Sort", "Window")) and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return max(out, default=0)


@pytest.mark.parametrize("name", ["e07_below_spec_nearest", "e15_unconfirmed_everywhere", "e20_response_accounting", "d07_hits_in_order", "d10_compare_runs", "d12_lists_complete_or_miss", "f01_page_with_total", "f08_top_k_per_source", "g07_merge_hits", "j13_cache_decision"])
def test_joins_grow_with_kinds_of_requests(spark, repeated, name):
    """6,000 requests of 300 kinds: no join may put out a row for each request and candidate."""
    pairs = QUERIES["d01_candidates"](spark, repeated).count()
    answers = QUERIES[name](spark, repeated)
    assert joined_rows(answers) < max(pairs / 4, 6000 * 5 + 1)


def test_answers_of_one_kind_follow_each_other(spark, repeated):
    """So the ids of equal requests repeat from row to row, and a written table compresses."""
    answers = QUERIES["h03_comparison_modes"](spark, repeated)
    kinds = [r[0] for r in answers.selectExpr("request_id % 300").collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert answers.rdd.getNumPartitions() == tasks  # as many as a shuffle has, few bytes or not
    assert 1 + sum(a != b for a, b in zip(kinds, kinds[1:])) <= len(set(kinds)) * tasks  # a kind is one run in a task
