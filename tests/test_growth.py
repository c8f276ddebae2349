"""Plans of which a task's memory or time grew with the tables."""

import hashlib

from pyspark.sql import functions as F

from partloom.catalogue import QUERIES
from partloom.functions import attributes, extraction
from partloom.operators import ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_brackets_are_dealt_and_read_once(spark, small):
    assert QUERIES["b30_price_brackets"](spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([("10-99:2.5,bad,1-9:3,10-:99,x:1",), (None,), ("",), ("5:1.2.3,7-:4, 2 :1",)], "raw string").select(extraction.price_brackets(F.col("raw")).alias("b"))
    assert plan(rows).count("regexp_extract") <= 2
    assert [r.b and [tuple(x) for x in r.b] for r in rows.collect()] == [[(1, 3.0), (10, 2.5)], None, [], [(7, 4.0)]]


def test_declared_attributes_need_no_shuffle(spark):
    rows = spark.range(9).selectExpr("id", "'S1' source", "'LARGE' family", "map('v', '1', 'value', '2') attributes")
    found = attributes.resolve_declared(rows, ["id"])
    assert "Exchange" not in plan(found) and "Sort" not in plan(found)
    assert {(r.attribute, r.value, r.name) for r in found.collect()} == {("voltage", "1", "v"), ("size", "2", "value")}


def test_average_rank_sorts_once(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, None), (1, 3.0), (2, 5.0), (1, float("nan")), (1, float("nan"))], "q long, v double")
    ranked = rows.select("q", "v", ranking.average_rank(F.col("v"), "q").alias("r"))
    assert plan(ranked).count("Sort [") == 1
    assert sorted(r.r for r in ranked.collect()) == [1.0, 1.0, 2.5, 2.5, 4.0, 5.5, 5.5]


def test_among_first_keeps_all_that_can_be_first(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, null, id % 3) g", "cast(id as string) k")
    own = {}
    for r in rows.collect():
        own.setdefault(r.g, []).append(hashlib.md5(r.k.encode()).hexdigest())
    kept = {}
    for r in ranking.among_first(rows, ["g"], F.md5("k"), 10).collect():
        kept.setdefault(r.g, []).append(hashlib.md5(r.k.encode()).hexdigest())
    for g, every in own.items():
        assert sorted(kept[g])[:10] == sorted(every)[:10] and len(kept[g]) < 100
    few = spark.range(5).selectExpr("1 g", "cast(null as string) k")
    assert ranking.among_first(few, ["g"], F.md5("k"), 10).count() == 5


def test_every_offer_asks_for_itself(spark, small):
    from partloom.bindings import offers

    rows = QUERIES["l16_self_recall"](spark, small)
    every = {r.family: r["count"] for r in offers(spark, small).where("stock > 0 and size_v is not null").groupBy("family").count().collect()}
    assert {r.family: (r.asked, r.found) for r in rows.collect()} == {f: (n, n) for f, n in every.items()}
    # the own key is a key of the join
    assert any("Join" in line and "own_part" in line and "want_size" in line for line in plan(rows).splitlines())


def test_correlations_are_dealt(spark, small):
    assert QUERIES["l03_spearman"](spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_first_of_a_key_is_dealt(spark, small):
    assert QUERIES["f10_keep_first"](spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_trigram_candidates_by_a_loop(spark, monkeypatch):
    """Separators at and off a chunk's end, short and long names, copies, and part numbers of more runs than are combined by three."""
    from partloom.operators import text_search

    parts = ["P1234-567", "P12-34567", "P-1234567", "P123-4567", "p1234567", "XP123456789", "P1", "", None, "AAAAAAA", "ABCABCABC-ABC", "".join(chr(65 + i * i % 26) + str(i) for i in range(60)), "P1234567-P12-345-678"]
    names = ["P1234567", "P12345", "p-12 34567", "P1234567", "AAAAAA", "ABCABCABC", "XP123456", "Z99999", "P1234", None, parts[-2][:40], parts[-2][31:38], "P12345678P12"]
    offered = spark.createDataFrame([(f"S{i % 2}", p) for i, p in enumerate(parts)], "source string, part_number string")
    asked = spark.createDataFrame(list(enumerate(names)), "request_id long, name string")

    def fits(name, part):
        code = "".join(c for c in name if c.isalnum()).upper()
        return len(code) >= 6 and any(all(code[i : i + 3] in part.upper() for i in range(p, len(code) - 2, 3)) for p in range(3))

    want = sorted((r, p) for r, name in enumerate(names) if name for p in parts if p and len(p) > 2 and fits(name, p))
    for many, marks in ((32, 1 << 20), (0, 1 << 20), (32, 2)):
        monkeypatch.setattr(text_search, "MANY_RUNS", many)
        monkeypatch.setattr(text_search, "BLOCKS", marks)
        assert sorted((r.request_id, r.part_number) for r in text_search.trigram_candidates(asked, offered, "request_id").collect()) == want
    assert want


def test_trigram_candidates_shuffle_no_runs(spark, small):
    """An offer's runs stay where it is: what is shuffled are its key and hashes that names may ask for."""
    made = QUERIES["i12_trigram_candidates"](spark, small)._jdf.queryExecution()
    assert not [line for line in made.executedPlan().toString().splitlines() if "Exchange" in line and "runs" in line]
    assert not [line for line in made.optimizedPlan().toString().splitlines() if "Aggregate" in line and "runs" in line]


def test_least_steps_meet_documents_by_the_last_term(spark, small):
    """No pairs of document and query are dealt or gathered: only texts are shuffled, and what is counted for a query."""
    for name in ("i09_drop_least_informative", "i10_fallback_mode"):
        dealt = [line for line in plan(QUERIES[name](spark, small)).splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and not [line for line in dealt if "qid" in line and "doc_id" in line], name
        assert not [line for line in dealt if "(term" in line and "doc_id" in line], name


def test_scores_need_only_texts_dealt(spark, small):
    for name in ("i04_bm25", "i05_ranked_page"):
        dealt = [line for line in plan(QUERIES[name](spark, small)).splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and not [line for line in dealt if "(qid" in line and "doc_id" in line.split("hashpartitioning(")[1].split(")")[0]], name
        assert not [line for line in plan(QUERIES[name](spark, small)).splitlines() if "SortMergeJoin" in line], name


def test_text_search_by_a_loop(spark, monkeypatch):
    """Rows of one id, rows without id or text, queries of one term, and blocks of a few terms."""
    import math
    import re

    from partloom.operators import text_search

    docs = [(1, "red gear, widget!", 17), (2, "Gear gear bolt", 14), (2, "ring red", 8), (None, "gear ring", 9), (3, None, 0), (4, "", 0), (5, "widget bolt ring gear red", 25), (5, "x", None), (6, "--", 2)]
    asked = ["gear widget red", "ring", "bolt nothing", "red red gear a", "", "?", "widget ring bolt gear zz"]
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    merged = {}
    for i, t, _ in docs:
        merged.setdefault(i, []).extend(words(t or ""))
    lengths = [len(words(t)) for _, t, _ in docs if t is not None]
    mean, scores, steps = sum(lengths) / len(lengths), {}, {}
    for q, text in enumerate(asked):
        own = list(dict.fromkeys(words(text)))
        order = sorted(own, key=lambda w: (len(w), w))
        for i, held in merged.items():
            if len(own) >= 2 and (step := max((n for n, w in enumerate(order, 1) if w not in held), default=0)) <= len(own) - 2:
                steps[q, i] = step
            for w in own if i is not None else ():
                df = sum(w in h for h in merged.values())
                for j, t, _ in docs:
                    if w in held and j == i and t is not None:
                        tf = held.count(w)
                        scores[q, i] = scores.get((q, i), 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words(t)) / mean))
    rows = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    terms = text_search.query_terms(spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"), "item_id")
    held = text_search.by_id(rows).select("doc_id", F.array_distinct(F.flatten("words")).alias("held"))
    for block in (200_000, 3):
        monkeypatch.setattr(text_search, "TERM_BLOCK", block)
        got = text_search.in_blocks(terms, lambda t: text_search.bm25(rows, t, "n_chars")).collect()
        assert {(r.qid, r.doc_id): r.score for r in got} == {k: round(v, 6) for k, v in scores.items()} and len(got) == len(scores)
        assert all(sorted(str(x.n_chars) for x in r.n_chars) == sorted(str(n) for i, _, n in docs if i == r.doc_id) for r in got)
        assert {(r.qid, r.doc_id): r.step for r in text_search.in_blocks(terms, lambda t: text_search.least_steps(held, t)).collect()} == steps
    assert {(r.term) for r in text_search.held_terms(rows, terms).collect()} == {w for t in asked for w in words(t)} & {w for h in merged.values() for w in h}
