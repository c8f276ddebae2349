"""Relaxation by kind, one step after the other on every text, as a person would try it."""

import re

import pytest

from partloom.bindings import offers
from partloom.operators import search_modes as modes

COLUMNS = "request_id long, text string"


def terms_of(text):
    words, out, i = text.lower().split(), [], 0
    known = {p: (kind, cls, col) for p, kind, cls, col, _ in modes.VOCABULARY}
    while i < len(words):
        for n in (3, 2, 1):
            phrase = " ".join(words[i : i + n])
            if i + n <= len(words) and phrase in known:
                kind, cls, _ = known[phrase]
                out.append((phrase, kind, [(c, p) for p, _, x, c, _ in modes.VOCABULARY if x == cls]))
                i += n
                break
        else:
            w = words[i]
            kind = "VALUE" if re.fullmatch(r"\d+(\.\d+)?uf", w) else "RATING" if re.fullmatch(r">=\d+(\.\d+)?v", w) else "KEYWORD"
            out.append((w, kind, [("description", w)]))
            i += 1
    return out


def holds(term, row):
    text, kind, phrases = term
    if kind == "RATING":
        return any(float(x) >= float(text[2:-1]) for x in re.findall(r"\b(\d+(?:\.\d+)?)V\b", row.description))
    return any(f" {p} " in f" {row[c].lower()} " for c, p in phrases)


def search(text, rows):
    """mode, dropped, total, out_of_stock."""
    terms = terms_of(text)
    match = lambda ts: [r for r in rows if all(holds(t, r) for t in ts)]
    live = lambda ts: sum(r.stock > 0 for r in match(ts))
    parametric = [t for t in terms if t[1] != "KEYWORD"]
    if n := live(terms):
        return "ALL", [], n, 0
    out = len(match(terms))
    said = lambda left: ("PARAMETRIC" if left == parametric else "RELAXED", [t[0] for t in sorted(terms, key=lambda t: (modes.DROP_ORDER.index(t[1]), -terms.index(t))) if t not in left], live(left), out)
    dead = [t for t in terms if t[1] != "RATING" and not match([t])]
    alive = [t for t in terms if t not in dead] if len(dead) < len(terms) else terms
    for ladder in (alive, [t for t in alive if t[1] != "RATING"]):
        left = list(ladder)
        while left:
            if left != terms and live(left):
                return said(left)
            if sum(t[1] != "RATING" for t in left) <= modes.KEPT:
                break
            left.remove(max(left, key=lambda t: (-modes.DROP_ORDER.index(t[1]), left.index(t))))
    if parametric and len(parametric) < len(terms) and live(parametric):
        return "PARAMETRIC", [], live(parametric), out
    matchable = [t for t in terms if t[1] != "RATING"]
    if len(matchable) > 1 or len(matchable) < len(terms):
        n = sum(r.stock > 0 and any(holds(t, r) for t in matchable) for r in rows)
        if n:
            return "ANY", [], n, out
    return None, [], 0, out


def found(df):
    return {r.request_id: (r["mode"], r.dropped.split(",") if r.dropped else [], r.total, r.out_of_stock) for r in df.collect()}


def test_every_request(spark, small):
    rows = offers(spark, small).select("kind", "description", "stock").collect()
    asked = modes.searches(spark, small).collect()
    got, want = found(modes.i09_by_kind(spark, small)), {r.request_id: search(r.text, rows) for r in asked}
    assert got == want
    assert {m for m, *_ in want.values()} >= {"ALL", "RELAXED", "PARAMETRIC", "ANY"}


@pytest.mark.parametrize("text", ["cold plate plate hot plate", "hot cold plate", "red red ring ring", "old bolt little gizmo", "", "  Hot   PLATE  ", "12uF >=25V", "x" * 5000, "3.5uf 12uf"])
def test_phrases_that_overlap(spark, text):
    rows = spark.createDataFrame([(1, text)], COLUMNS)
    got = sorted((r.nth, r.term, r.kind) for r in modes.parsed(rows, "request_id", "text", modes.vocabulary_of(spark)).collect())
    assert [t[1:] for t in got] == [t[:2] for t in terms_of(text)]


def test_odd_requests(spark):
    made = [("plate", "hot plate 12uF 25V Brand#3", 1, 0), ("plate", "cold plate 12uF 40V Brand#3", 2, 5), ("gear", "cold gear 7uF 10V Brand#9", 3, 9), ("widget", "little widget 7uF Brand#4", 4, 2), (None, None, 5, 1), ("ring", "", 6, 1)]
    shop = spark.createDataFrame(made, "kind string, description string, pk long, stock long")
    texts = ["hot plate", "hot plate 12uF >=30V", "cog 7uF Brand#9", "gizmo small", "unheard", "unheard other", ">=20V", "anvil gear", "Brand#3 Brand#9 gear", "gear gear", "cog gear 99uF unheard >=50V", "Brand#3 Brand#9 Brand#4", "hot cold plate >=60V Brand#3"]
    asked = spark.createDataFrame(list(enumerate(texts)), COLUMNS)
    rows = [r for r in shop.collect() if r.kind is not None]
    terms = modes.parsed(asked, "request_id", "text", modes.vocabulary_of(spark))
    got = found(modes.relaxed(terms, modes.search_texts(shop.where("kind is not null")), "request_id"))
    for i, text in enumerate(texts):
        if len({t[0] for t in terms_of(text)}) == len(terms_of(text)) and any(t[1] != "RATING" for t in terms_of(text)):
            assert got[i] == search(text, rows), text
    assert modes.relaxed(terms.limit(0), modes.search_texts(shop), "request_id").count() == 0
    assert {m for m, *_ in found(modes.relaxed(terms, modes.search_texts(shop.limit(0)), "request_id")).values()} == {None}


def test_steps_without_a_thing_that_no_text_names(spark):
    """A value, a package or a thing that no text holds goes first, also where it is the rarest of the last terms."""
    made = [("gear", "red gear 12uF 25V Brand#3", 1, 4), ("gear", "cold gear 7uF 40V Brand#9", 2, 5), ("plate", "hot plate 7uF 10V Brand#3", 3, 0), ("plate", "old plate little 12uF 30V Brand#9", 4, 6), ("bolt", "cold bolt 3uF 5V", 5, 1)]
    shop = spark.createDataFrame(made, "kind string, description string, pk long, stock long")
    texts = ["red gear 99uF", "red gear Brand#3 99uF >=20V", "ring cold 7uF Brand#9", "widget 12uF old", "little gear 12uF", "cold bolt 3uF >=90V", "hot ring 99uF", "plate small 7uF", "red gear 99uF", "Brand#9 ring"]
    asked, rows = spark.createDataFrame(list(enumerate(texts)), COLUMNS), shop.collect()
    got = found(modes.relaxed(modes.parsed(asked, "request_id", "text", modes.vocabulary_of(spark)), modes.search_texts(shop), "request_id"))
    assert got == {i: search(text, rows) for i, text in enumerate(texts)}


def test_equal_texts_are_looked_for_once(spark, small, tmp_path):
    """6,000 requests of some thousand texts: no join may put out texts for each request."""
    from pyspark.sql import functions as F

    from partloom.catalogue import QUERIES
    from test_alike import joined_rows

    for table in ("lineitem", "part"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{small}/{table}.parquet")
    spark.range(6000).select(F.col("id").alias("c_custkey"), F.lit("AUTO").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    assert joined_rows(QUERIES["i02_synonyms_by_column"](spark, str(tmp_path))) < 20_000


def test_prefix_join_holds_requests_and_not_offers(spark):
    """Half of all offers begin with one prefix; a merge join holds the rows of its right side, so these are the requests."""
    from pyspark.sql import functions as F

    from partloom.operators.matching import prefix_join

    offered = spark.range(2000).select(F.lit("S").alias("source"), F.concat(F.lit("P-"), "id").alias("part_number"), F.concat(F.lit("Brand-"), (F.col("id") % 2 + 1), F.lit("-"), "id").alias("mpn"))
    asked = spark.createDataFrame([(1, "brand 1"), (2, "Brand-1"), (3, "Brand-2-1"), (4, "P-19"), (5, "zzzzz")], "request_id long, prefix string")
    joined = prefix_join(asked, offered, 3)
    want = {(r, f"P-{i}") for i in range(2000) for r, p in ((1, "BRAND1"), (2, "BRAND1"), (3, "BRAND21"), (4, "P19")) if f"BRAND{i % 2 + 1}{i}".startswith(p) or f"P{i}".startswith(p)}
    got = [(r.request_id, r.part_number) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    join = next(line for line in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert join and plan.index("part_number") < plan.index("request_id", plan.index("Join Inner"))
    assert plan.count("Join Inner") == 1


@pytest.mark.parametrize("name", ["i02_all_terms", "i03_any_term", "i04_bm25", "i09_drop_least_informative", "h11_keyword_overlap"])
def test_a_merge_join_holds_queries_and_not_documents(spark, small, name):
    """Of a join of documents with queries, the right side (which a merge join holds by key) reads no documents' words."""
    from partloom.catalogue import QUERIES

    joins, todo = [], [QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        kids = [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName() == "Join" and "Inner" in p.toString().splitlines()[0]:
            joins.append([k.toString() for k in kids])
        todo += kids
    # counts by term have a row for each
    held = [(left, right) for left, right in joins if "item_id" in right and "Generate" in right and not right.startswith("Aggregate [term#")]
    assert held and all("doc_id" in left and "doc_id" not in right for left, right in held)
