import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import EDGE, LONG, clashing, rows


def test_phrases_cut_the_text():
    from partloom.llm import phrases

    rng = random.Random(1)
    for text in ["", "a", "aaaaaaaaaa", "abababababab", LONG, *("".join(rng.choice("abé𝄞 ") for _ in range(rng.randint(0, 200))) for _ in range(300))]:
        found = phrases.parse(text)
        assert len(found) == len(set(found)) and text.startswith("".join(found)) and set(found) == brute.phrases(text)
        hashes = phrases.hashes(text, np.array([len(p) for p in found], dtype=np.int64))
        assert len(set(hashes.tolist())) == len(found)


def test_likeness_is_exact_for_few_phrases_and_near_for_many():
    from partloom.llm import phrases

    rng = random.Random(2)
    for n in (0, 3, 40, 200):
        a, b = ("".join(rng.choice("abcde") for _ in range(n)) for _ in range(2))
        x, y = brute.phrases(a), brute.phrases(b)
        assert phrases.likeness(phrases.fingerprint(a), phrases.fingerprint(b)) == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0, abs=0 if len(x | y) <= phrases.MINIMA else 0.2)
    assert phrases.likeness(phrases.fingerprint(""), phrases.fingerprint("x")) == 0.0
    assert (phrases.read(phrases.written(phrases.fingerprint(LONG))) == phrases.fingerprint(LONG)).all()


@pytest.mark.parametrize("ranges", [1, 40])
def test_edited_texts(spark, edge_docs, monkeypatch, ranges):
    from partloom.llm import phrases

    monkeypatch.setattr(phrases, "RANGES", ranges)
    monkeypatch.setattr(phrases, "SAMPLED", 50)
    found = phrases.compare_with_next(edge_docs, row=F.col("n_chars")).collect()
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in found}
    docs = brute.descending([(r.doc_id, r.text or "") for r in edge_docs.orderBy("n_chars").collect()])
    assert len(found) == len(docs)
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        of = lambda t: phrases.written(phrases.fingerprint(t))
        assert r.fingerprint == of(text) and r.edited_fingerprint == of(edited)
        assert r.near_next == phrases.likeness(phrases.fingerprint(text), phrases.fingerprint(following))
        a, b = brute.phrases(text), brute.phrases(edited)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) <= 0.2


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Null, empty and long texts, repeated ids, a hundred rows of one id; n_chars orders rows."""
    rng = random.Random(3)
    many = [(50, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60)))) for _ in range(100)]
    made = [(i, t, n) for n, (i, t) in enumerate([*EDGE, (None, "no id"), (None, "no id either"), (-(1 << 63), "least"), *many])]
    return clashing(spark.createDataFrame(made, "doc_id long, text string, n_chars long").withColumns({"range": F.lit(1), "ahead": F.lit(2), "groups": F.lit(3), "passed": F.lit(4)}))


def test_phrases_of_few_documents(spark, edge_docs):
    from partloom.llm import phrases

    assert phrases.compare_with_next(edge_docs.limit(0)).count() == 0
    one = phrases.compare_with_next(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest(), 1.0)]
    assert {r.doc_id: r.fingerprint for r in phrases.fingerprints(edge_docs.where("doc_id < 4")).collect()}.keys() >= {1, 2, 3}


def test_op11_phrases(spark, small):
    from partloom.llm import phrases

    got = {r.doc_id: r for r in phrases.op11_phrases(spark, small).collect()}
    docs = brute.descending([(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()])
    assert len(got) == len(docs)
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, following)):
            a, b = brute.phrases(text), brute.phrases(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) <= 0.22  # five standard errors


def _clusters(vectors, n, rounds, width):
    kept = [(i, [int(np.floor(256 * x)) if abs(x) < 2**40 else 256 * int(x) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = [v for _, v in sorted(kept, key=mark)[:n]]
    away = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in kept:
            own[away(v)[1]].append(v)
        at = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, at)]
    return sorted(((i, away(v)[1], d if (d := away(v)[0]) < 1 << 63 else None) for i, v in kept), key=repr), at


def test_clusters_of_odd_vectors(spark):
    from partloom.llm import centroids

    rng = random.Random(4)
    vectors = [(i, [rng.choice([-0.5, 0.25, 0.126, 1e-9]) * rng.randint(-3, 3) for _ in range(4)]) for i in range(300)] + [(5, [0.25] * 4)] * 40
    vectors += [(400, None), (401, [None, 1.0, 1.0, 1.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (404, [1.0] * 3), (405, []), (None, [0.5] * 4), (None, [-0.5] * 4)]
    for more in ([], [(600, [1e30, -1e30, 3e20, 0.1]), (601, [1e30, -1e30, 3e20, 0.7]), (602, [2.0**62, 5.0, -(2.0**55), 1.0])]):
        df = clashing(spark.createDataFrame(vectors + more, "vec_id long, embedding array<double>")).withColumns({"v": F.lit(1), "mark": F.lit(2), "cluster": F.lit(3)})
        found, at = centroids.cluster(df, n=12, rounds=3, components=4)
        want, want_at = _clusters(vectors + more, 12, 3, 4)
        assert at == want_at and rows(found, "vec_id", "cluster", "distance") == want
    assert centroids.cluster(df.limit(0))[0].count() == 0
    few, at = centroids.cluster(spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>"), n=12, components=4)
    assert few.count() == len(at) == 3 and few.where("distance > 0").count() == 0


def test_op12_centroids(spark, small, monkeypatch):
    from partloom.llm import centroids

    got = centroids.op12_centroids(spark, small).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, at = _clusters(vectors, 40, 5, 64)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for _, _, d in want)
    monkeypatch.setattr(centroids, "BLOCK", 7)
    assert rows(centroids.op12_centroids(spark, small), "vec_id", "cluster", "distance") == want


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _turns(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " ", "usher"]), rng.choice(["a.", "b!", "c?\n", "d", "", "e f.", " \t", "é."]) + rng.choice(["", f"{rng.randrange(9)}."])) for _ in range(n)]


def test_cheapest_edits():
    from partloom.llm import repair

    rng = random.Random(5)
    for _ in range(800):
        turns = [(1, i, *t) for i, t in enumerate(_turns(rng, rng.randint(0, 10)))]
        part, seen = repair._Part(1), set()
        for _, turn, role, text in turns:
            part.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        whole = next(repair._whole(part, False))
        assert [tuple(whole[k] for k in NAMES)] == brute.repair(turns, [1])


@pytest.mark.parametrize("tasks", ["2", "37"])
def test_conversations_over_many_tasks(spark, tasks):
    from partloom.llm import repair

    rng = random.Random(6)
    made = []
    for conv in [*range(30), None]:
        made += [(conv, rng.choice([i, i, i + 1, None]), *t) for i, t in enumerate(_turns(rng, 150 if conv == 7 else rng.randint(1, 9)))]
    made += [(99, 1, None, None), (99, 1, None, None), (99, 2, "user", None), (98, 5, "user", "x" * 200_000 + "."), (97, None, "assistant", "q.")]
    df = clashing(spark.createDataFrame([(i, *t) for i, t in enumerate(made)], "place long, conv_id long, turn long, role string, text string")).withColumns({"mark": F.lit(5), "piece": F.lit(6), "at": F.lit(7)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        turns = repair.damaged(df, F.col("place"))
        found, repaired = repair.repair(turns, order=F.col("order"), present=F.col("present"), repaired=True)
        got, lines = sorted(map(tuple, found.select(*NAMES).collect()), key=repr), repaired.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    left, ids = brute.damage(made)
    assert got == sorted(brute.repair(left, ids), key=repr)
    for row in found.collect():
        own = sorted((r for r in lines if r.conv_id == row.conv_id), key=lambda r: r["at"])
        assert "".join(r.edit for r in own) == row.audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == row.repaired_sha256
    assert repair.repair(turns.limit(0), order=F.col("order"))[0].count() == 0


def test_op13_repair(spark, small):
    from partloom.llm import repair

    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(repair.op13_repair(spark, small), *NAMES) == sorted(brute.repair(*brute.damage(turns)), key=repr)
