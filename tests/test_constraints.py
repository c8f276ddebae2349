"""Declared constraints: a kind, a role or a tolerance is a row, and changing the row changes what is found."""

import pytest

from partloom.operators import constraints as c

ASKED = "request_id long, family string, want double, text string"
OFFERED = "source string, part_number string, have double, says string"


def judge(spark, kind, want, text, have, says, alike=(), **more):
    """The one offer's result for the one request under one kind."""
    kinds = (c.Kind("it", kind, "text" if text is not None or says is not None else "num", more.pop("role", "NEVER"), 0.3, "text" if text is not None or says is not None else "want", "says" if text is not None or says is not None else "have", **more),)
    original = c.ALIKE
    asked = spark.createDataFrame([(1, "F", want, text)], ASKED)
    offered = spark.createDataFrame([("S", "P", have, says)], OFFERED)
    try:
        c.declarations.__defaults__ = (c.KINDS, alike or original)
        rows = c.with_wants(asked, kinds).join(c.with_facts(offered, kinds))
        r = c.declared_check(rows).collect()
    finally:
        c.declarations.__defaults__ = (c.KINDS, original)
    return (r[0].excluded_by, r[0].mismatches, r[0].unverified, r[0].grade)


MET, MISSED, OPEN = (None, "", "", 1.0), ("it", "it", "", 0.0), (None, "", "it", None)


@pytest.mark.parametrize("mode, want, have, tolerance, result", [
    ("EQUAL", 5.0, 5.0, 0.0, MET), ("EQUAL", 5.0, 5.1, 0.0, MISSED), ("EQUAL", 5.0, None, 0.0, OPEN), ("AT_LEAST", 5.0, 4.9, 0.02, MET), ("AT_LEAST", 5.0, 4.9, 0.01, MISSED), ("AT_MOST", 5.0, 5.05, 0.01, MET),
    ("AT_MOST", 5.0, 5.1, 0.01, MISSED), ("WITHIN", 100.0, 101.0, 0.01, MET), ("WITHIN", 100.0, 101.1, 0.01, MISSED), ("WITHIN", 0.0, 0.0, 0.5, MET), ("WITHIN", 0.0, 0.001, 0.5, MISSED), ("WITHIN", -10.0, -10.5, 0.05, MET),
])
def test_numbers(spark, mode, want, have, tolerance, result):
    assert judge(spark, mode, want, None, have, None, tolerance=tolerance) == result


@pytest.mark.parametrize("mode, text, says, more, result", [
    ("EQUAL", "a", "A", {}, MISSED), ("EQUAL_IGNORE_CASE", "a", "A", {}, MET), ("FEATURE", "x", "|x|y|", {}, MET), ("FEATURE", "z", "|x|y|", {}, (None, "", "", 0.0)), ("FEATURE", "z", "|x|", {"penalized": True}, MISSED),
    ("FEATURE", "z", None, {}, OPEN), ("FEATURE", "z", None, {"penalized": True}, MISSED), ("COMPATIBLE", "a", "a", {}, MET), ("COMPATIBLE", "a", "b", {}, (None, "", "", 0.5)), ("COMPATIBLE", "a", "c", {}, MISSED), ("COMPATIBLE", "a", None, {}, OPEN),
    ("EQUAL", "a", "b", {"role": "SOFT"}, (None, "it", "", 0.0)), ("EQUAL", "a", "b", {"role": "PREFERENCE"}, (None, "", "", None)), ("EQUAL", "a", "b", {"role": "BELOW_SPEC"}, MISSED),
])
def test_texts_and_roles(spark, mode, text, says, more, result):
    assert judge(spark, mode, None, text, None, says, alike=(("it", "a", "b", 0.5),), **more) == result


def test_roles_of_families(spark):
    kinds = (c.Kind("a", "EQUAL", "num", "NEVER", 1, "want", "have"), c.Kind("b", "EQUAL", "num", "LADDER", 1, "want", "have"))
    families = spark.createDataFrame([("own",), ("set",), ("both",), ("none",)], "family string")
    got = {(r.family, r.kind): r.role for r in c.roles(families, kinds, own=(("own", "a", "SOFT"), ("both", "b", "NEVER")), hard={"set": ("b",), "both": ()}).collect()}
    assert got == {("own", "a"): "SOFT", ("own", "b"): "LADDER", ("set", "a"): "SOFT", ("set", "b"): "NEVER", ("both", "a"): "SOFT", ("both", "b"): "LADDER", ("none", "a"): "NEVER", ("none", "b"): "LADDER"}


def test_members_of_a_group_share_its_weight(spark):
    kinds = tuple(c.Kind(k, "AT_LEAST", "num", "SOFT", 0.3, w, "have", group="g") for k, w in (("a", "want"), ("b", "want * 10"), ("c", "cast(null as double)")))
    rows = c.with_wants(spark.createDataFrame([(1, "F", 1.0, None)], ASKED), kinds).collect()
    assert [(w.kind, round(w.share, 6)) for w in rows[0].wants] == [("a", 0.15), ("b", 0.15)]


def test_offers_meet_classes_and_not_requests(spark, small, tmp_path):
    """3,000 requests of a few hundred kinds: candidates are made for classes, and what is judged is a row for equal grades."""
    from pyspark.sql import functions as F

    from partloom.bindings import requests
    from partloom.catalogue import QUERIES

    for table in ("lineitem", "part"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{small}/{table}.parquet")
    spark.range(3000).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    d = str(tmp_path)
    graded, picks, members = c.declared(spark, d)
    pairs = QUERIES["d01_candidates"](spark, d).count()
    assert graded.count() < pairs / 10 and picks.count() < 3000
    assert members.agg(F.sum(F.size("ids"))).first()[0] == requests(spark, d).count()
    own = c.graded_alike(graded, picks)
    assert own.select("request_id", "of", "grades").distinct().count() == own.count()
    assert own.join(members, "request_id").agg(F.sum(F.col("n") * F.size("ids"))).first()[0] == pairs
