import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "One two three four five six seven eight nine ten eleven."), (5, "One two three four five six seven eight nine ten eleven."), (6, LONG), (7, "é ü one TWO"), (8, "one"), (8, "one")]
#: Columns with names that operators use themselves.
CLASH = ("row", "node", "fp", "key", "n", "size", "taken", "part", "host", "path", "toxic", "low", "words", "target", "doc", "group")


def clashing(df):
    return df.withColumns({c: F.lit(0) for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def edge(spark):
    return clashing(spark.createDataFrame([*EDGE, (None, "no id")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") < 5, "a"), "n_chars": F.length("text").cast("long")}))


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_decontamination(spark, small, edge, empty):
    from partloom.llm import decontam

    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(*("doc_id", "text") if t == "documents" else ("item_id", "text")).collect()]
    assert rows(decontam.op1_decontamination(spark, small), *names) == sorted(brute.contaminated(read("documents"), read("benchmark")), key=repr)
    items = [(1, "two three four five six seven eight nine ten eleven"), (2, "ONE"), (3, None), (4, ""), (None, "one two"), (10, "w0 w1 w2"), (5, "one"), (2, "three four")]
    got, _ = decontam.decontaminate(edge, clashing(spark.createDataFrame(items, "item_id long, text string")))
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()]
    want = brute.contaminated([*EDGE, (None, "no id")], items)
    assert sorted((a, b, c, len(i)) for a, b, c, i in got if a) == sorted(w[:4] for w in want if w[0])
    assert decontam.decontaminate(empty, spark.createDataFrame(items, "item_id long, text string"))[0].count() == 0
    assert decontam.decontaminate(edge, spark.createDataFrame([], "item_id long, text string"))[0].where("n_hit > 0").count() == 0
    assert rows(decontam.drop_contaminated(edge, spark.createDataFrame([(2, "ONE")], "item_id long, text string")), "doc_id") == sorted([(1,), (2,), (3,), (6,), (None,)], key=repr)


def test_decontamination_in_blocks(spark, small, monkeypatch):
    from partloom.llm import decontam

    whole = rows(decontam.op1_decontamination(spark, small), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 2000)
    assert rows(decontam.op1_decontamination(spark, small), "doc_id", "n_hit", "items_sha256") == whole


def test_warc(spark, tmp_path):
    from partloom.llm import warc

    pages = [(1, "http://a/ b", "x"), (2, "u", None), (3, None, ""), (4, "u", "x"), (5, "u", "y" * 300_000), (6, "u", "é"), (7, "u", "x"), (None, "u", "x"), (None, "u", "only"), (6, "u", "é")]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    archives = warc.write_warc(df)
    found = warc.read_warc(archives).collect()
    assert len(found) == len(pages) and all(r.digest_ok for r in found)
    by = {(warc.page_of(r.record_id), r.payload_digest): (r.record_type, warc.page_of(r.refers_to), r.payload_bytes) for r in found}
    sha = lambda x: brute.sha1_base32((x or "").encode())
    assert by[1, sha("x")] == ("revisit", 7, 1) and by[7, sha("x")] == ("response", None, 1) and by[None, sha("x")] == ("revisit", 7, 1)
    assert by[2, sha("")] == ("revisit", 3, 0) and by[3, sha("")] == ("response", None, 0) and by[None, sha("only")] == ("response", None, 4)
    assert by[6, sha("é")] == ("response", None, 2)
    for split in (7, 100, 5000):  # ranges that begin anywhere find every record once
        assert sorted(r.record_id for r in warc.read_warc(archives, split_bytes=split).collect()) == sorted(r.record_id for r in found)
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0
    good = [warc.member(i, "u", bytes([i]) * 5000, None, False) for i in range(3)]
    path = tmp_path / "broken.warc.gz"
    path.write_bytes(good[0] + good[1][:-9] + b"\x1f\x8b\x08 no member" + good[2])
    assert [warc.page_of(h["warc-record-id"]) for _, h, _ in warc.records(str(path), 0, 10**9)] == [0, 2]


def test_warc_with_long_headers(spark):
    from partloom.llm import warc

    url = "http://a/" + "x" * (1 << 20)
    pages = spark.createDataFrame([(1, url, "x"), (2, "u", "y")], "page_id long, url string, html string")
    assert {r.target_uri for r in warc.read_warc(warc.write_warc(pages)).collect()} == {url, "u"}


def test_licenses(spark):
    from partloom.llm import license as scan

    filler = " ".join(f"w{i}" for i in range(100))
    files = [(1, "a/b/c", False, f"{filler}\nReleased under the MIT License.\n{filler}"), (2, "a/b/c", False, "nothing"), (3, "a/b", False, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."), (4, "x", False, None), (5, None, False, ""), (6, "a", None, "copyright of none"), (7, "a/b", True, "All rights reserved.")]
    templates = spark.createDataFrame(list(scan.TEMPLATES), "license string, text string")
    df = spark.createDataFrame(files, "doc_id long, directory string, is_license boolean, text string")
    got = {r.doc_id: (r.license, r.origin, r.from_directory) for r in scan.scan_licenses(clashing(df), templates).collect()}
    assert got[1] == ("MIT", "header", None) and got[2] == ("Apache-2.0", "directory", "a/b") and got[3][0] == "Apache-2.0" and got[7][0] == "Proprietary"
    assert got[4] == got[5] == got[6] == (None, None, None)
    assert scan.scan_licenses(df.limit(0), templates).count() == 0
    assert [r.license for r in scan.scan_licenses(df, templates.limit(0)).collect()] == [None] * 7
    same = [(1, "d", False, f"Released under the MIT License. {filler}"), (1, "d", False, "plain"), (None, "d", False, f"x\nLicensed under the Apache License,\nVersion 2.0. {filler}"), (None, "d", False, LONG)]
    got = scan.scan_licenses(spark.createDataFrame(same, df.schema), templates.union(templates)).collect()
    assert sorted((str(r.doc_id), str(r.license)) for r in got) == [("1", "MIT"), ("1", "None"), ("None", "Apache-2.0"), ("None", "None")]


def licence_files():
    """Whole bodies and notices as they stand in files: wrapped, commented, with carriage returns, holders and years, words
    changed, between much else."""
    from partloom.llm import license as scan

    rng = random.Random(7)
    noise = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "vi", "du", "pe", "xo")]
    other = lambda n: " ".join(rng.choice(noise) for _ in range(n))
    made = []
    for n, (name, text) in enumerate(scan.TEMPLATES):
        words = text.split()
        for mark, end, every in (("// ", "\n", 9), (" * ", "\r\n", 4), ("", "\n", 1000)):
            lines = [mark + " ".join(words[i : i + every]) for i in range(0, len(words), every)]
            made.append((n, name, f"{other(60)}{end}Copyright 2020 Jane Doe{end}" + end.join(lines) + f"{end}{other(200)}"))
        if len(words) > 40:
            changed = [w if rng.random() > 0.05 else other(1) for w in words]
            made.append((n, name, f"{other(30)}\n" + " ".join(changed)))
            made.append((n, name, " ".join(words[3:])))
    return made + [(-1, None, other(300)) for _ in range(60)] + [(-1, None, f"{other(20)} the license of the software is version 2.0 of the public work {other(20)}")]


def test_licenses_of_whole_bodies_against_a_loop(spark):
    from collections import Counter
    from math import log, sqrt

    from partloom.llm import license as scan

    made = licence_files()
    df = spark.createDataFrame([(i, f"d{i}", False, text) for i, (_, _, text) in enumerate(made)], "doc_id long, directory string, is_license boolean, text string")
    templates = spark.createDataFrame(list(scan.TEMPLATES), "license string, text string")
    got = {r.doc_id: (r.license, r.score) for r in scan.scan_licenses(df, templates).collect()}
    assert [got[i][0] for i in range(len(made))] == [name for _, name, _ in made]
    # every run of a template's length, wherever it lies: none reaches the threshold in a file without a licence, and none by
    # far more than the one that was found
    split = lambda t: re.findall(scan.WORD, t.lower())
    texts = [split(t) for _, _, t in made]
    held = Counter(w for t in texts for w in set(t))
    weigh = lambda words: {w: c * (log((1 + len(texts)) / (1 + held[w])) + 1) for w, c in Counter(words).items()}
    length = lambda v: sqrt(sum(x * x for x in v.values()))
    models = [(name, weigh(split(t)), len(split(t))) for name, t in scan.TEMPLATES]
    for i in [*range(0, len(made) - 61, 7), *range(len(made) - 3, len(made))]:
        best = 0.0
        for name, model, size in models:
            for start in range(max(len(texts[i]) - size, 0) + 1):
                v = weigh(texts[i][start : start + size])
                if v and name != scan.WEAK:
                    best = max(best, sum(x * model.get(w, 0) for w, x in v.items()) / length(v) / length(model))
        if made[i][1] is None:
            assert best < scan.LEAST
        elif made[i][1] != scan.WEAK:
            assert best >= got[i][1] - 1e-4 and best - got[i][1] < 0.05


def test_a_long_licence_file_gives_its_licence(spark):
    from partloom.llm import license as scan

    body = next(t for name, t in scan.BODIES if name == "MIT")
    files = [(1, "p", False, body), (2, "p/q/r", False, "code"), (3, "z", False, "Released under the MIT License. " + "word " * 200), (4, "z", False, "code"), (5, "s", False, "x " * 50 + "SPDX-License-Identifier: GPL-3.0-or-later")]
    templates = spark.createDataFrame(list(scan.TEMPLATES), "license string, text string")
    got = {r.doc_id: (r.license, r.origin, r.from_directory) for r in scan.scan_licenses(spark.createDataFrame(files, "doc_id long, directory string, is_license boolean, text string"), templates).collect()}
    assert got == {1: ("MIT", "header", None), 2: ("MIT", "directory", "p"), 3: ("MIT", "header", None), 4: (None, None, None), 5: ("GPL-3.0", "header", None)}


def test_url_filter(spark):
    from partloom.llm import urlfilter

    pages = [(1, "http://A.net/es/1", '<link rel="canonical" href="http://b.org/x#f">'), (2, "http://b.org/x", None), (3, "http://c.org/y", '<meta http-equiv="refresh" content="0; url=http://b.org/x">'), (4, None, ""), (5, "nourl", "x"), (6, "http://www.example.com/en/q?x#y", "<link href=/z rel=canonical>"), (7, "http://d.org", ""), (7, "http://d.org", ""), (8, "http://example.com/en/", "")]
    rules = spark.createDataFrame([*urlfilter.RULES, (None, "/", "block")], "host string, path string, action string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"verdict": F.lit(1), "node": F.lit(2), "action": F.lit(3)})
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, rules).collect()}
    assert got == {1: ("a.net", "/es/1", "net/es/", "block"), 2: ("b.org", "/x", None, "block"), 3: ("c.org", "/y", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("www.example.com", "/en/q", "www.example.com/en/", "allow"), 7: ("d.org", "", None, "allow"), 8: ("example.com", "/en/", "example.com/en/", "block")}
    more = spark.createDataFrame([("http://d.org", "http://e.org"), ("http://e.org/", "http://x.net/fr/1"), ("http://e.org", "http://www.example.com/en/1")], "a string, b string")
    assert {r.page_id: r.verdict for r in urlfilter.judge_urls(df, rules, more).collect()}[7] == "allow"
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0


def test_urls_without_hosts_and_very_long_ones(spark):
    from partloom.llm import urlfilter

    far = "http://net/es/" + "x" * 200_000
    pages = [(i, u, None) for i, u in enumerate([None, "", "plain", "http://", "http:///es/x", "http://?q", far])] + [(7, "http://q.org/p", "y" * 500_000 + f'<link rel="canonical" href="{far}">')]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(list(urlfilter.RULES), "host string, path string, action string")).collect()}
    assert got == {**{i: ("", None, "allow") for i in range(6)}, 6: ("net", "net/es/", "block"), 7: ("q.org", None, "block")}


def test_relative_targets(spark):
    from urllib.parse import urljoin

    from partloom.llm import urlfilter

    bases = ["http://a.net/es/sub/p?q=1", "http://a.net", "http://a.net/es/"]
    targets = ["article.html", "./x", "../x", "../../../x", "..", ".", "x/../y/./z", "?id=1", "#top", "x?u=a/../b", "/r/../s", "//b.org/x", "http://c.org/y"]
    made = [(i, b, f'<link rel="canonical" href="{t}">') for i, (b, t) in enumerate((b, t) for b in bases for t in targets)]
    got = rows(urlfilter.page_links(spark.createDataFrame(made, "page_id long, url string, html string")), "a", "b")
    node = lambda u: u.partition("#")[0] if u.count("/") > 2 else u.partition("#")[0] + "/"
    assert got == sorted([(node(b), node(urljoin(b if b.count("/") > 2 else b + "/", t))) for b in bases for t in targets], key=repr)
    none = spark.createDataFrame([(1, "http://a.net/x", '<link rel="canonical" href="mailto:a@b">')], "page_id long, url string, html string")
    assert rows(urlfilter.page_links(none), "b") == [(None,)]


@pytest.mark.parametrize("block", [512, 3])
def test_top_k(spark, monkeypatch, block):
    from partloom.llm import topk

    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = random.Random(1)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(700)] + [(900, None), (1000, [None] * 8), (1100, [float("nan")] * 8), (1200, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (1300, []), (1400, [0.5] * 3), (100, [0.25] * 8), (100, [0.25] * 8), (1500, [0.25] * 8)]
    for more in ([], [(2000, [1e300, 1.0]), (2001, [-1e300, 2.0]), (2002, [1e18, 2.0]), (2100, [3e15, -1e18]), (2003, [1e10, 1e10]), (2004, [1e10, 1e10])]):
        df = clashing(spark.createDataFrame(vectors + more, "vec_id long, embedding array<double>"))
        whole = lambda x: int(np.floor(1024 * x)) if abs(x) < 2**40 else 1024 * int(x)
        kept = [(i, n, [whole(x) for x in v]) for n, (i, v) in enumerate(vectors + more) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
        want = []
        for i, n, q in kept:
            if i % 100 == 0:
                scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, m, v in kept if m != n)[:10]
                want += [(i, r + 1, j, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, j) in enumerate(scored)]
        assert rows(topk.top_k(df, "vec_id % 100 = 0"), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(df.limit(0), "vec_id % 100 = 0").count() == 0


def test_simhash(spark, small, edge, empty):
    from partloom.llm import simhash

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    fps = [brute.simhash(t) for _, t in docs]
    want = [(i, f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, brute.components(fps))]
    assert rows(simhash.op6_simhash(spark, small), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] == 4 and got[8] == 8
    assert simhash.near_duplicates(empty).count() == 0
    assert rows(simhash.drop_near_copies(edge), "doc_id") == sorted([(1,), (4,), (6,), (7,), (8,), (None,)], key=repr)
    assert simhash.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("back, hot", [(7, 256), (2, 60)])
def test_links_in_large_groups(spark, monkeypatch, back, hot):
    from partloom.llm import simhash

    monkeypatch.setattr(simhash, "BACK", back)
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = random.Random(2)
    fps = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(200):
            x = base
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [struct.unpack("<q", struct.pack("<Q", x))[0] for x in fps]
    got = {r.node: r.component for r in simhash.link_fingerprints(spark.createDataFrame([(x, [x]) for x in signed], "node long, fp array<long>")).collect()}
    want = brute.components(fps)
    pairs = {(w, got[x]) for w, x in zip(want, signed)}
    assert len(pairs) == len(set(want)) == len({c for _, c in pairs})


@pytest.mark.parametrize("back", [7, 2])
def test_links_of_eight_segments(spark, monkeypatch, back):
    from partloom.llm import simhash

    monkeypatch.setattr(simhash, "BACK", back)
    rng, fps = random.Random(4), []
    for _ in range(4):
        base = [[rng.getrandbits(24) for _ in range(2)] for _ in range(4)]
        for _ in range(90):
            fps.append([sum((v ^ sum(1 << b for b in rng.sample(range(24), rng.choice([0, 1, 2, 2, 3, 3, 4, 4])))) << 24 * j for j, v in enumerate(pair)) for pair in base])
    low = (1 << 24) - 1
    near = lambda a, b: any(((x ^ y) >> 24 * j & low).bit_count() <= 1 for x, y in zip(a, b) for j in range(2))
    want = brute.joined(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if near(fps[i], fps[j])])
    marked = spark.createDataFrame([(i, f, i) for i, f in enumerate(fps)], "node long, fp array<long>, mark long")
    got = {r.node: r.component for r in simhash.link_fingerprints(marked, simhash.COPIES, None, lambda a, b: (a >= 0) & (b >= 0)).collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_near_copies_of_distinct_texts(spark):
    """Recall over pairs of distinct texts of 0.8 or more, found by comparing all."""
    from partloom.llm import simhash

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(5)
    for _ in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(10, 290), 6):
            other[at] = f"x{rng.randrange(3000)}"
        texts += [" ".join(words), " ".join(other)]
    texts = sorted({" ".join((t or "").lower().split()) for t in texts})
    pairs = brute.near_copies(texts)
    assert len(pairs) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.row: r.group for r in simhash.copy_groups(docs.withColumn("row", F.col("doc_id")), row_col="row").collect()}
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.98 * len(pairs)
    linked, of = brute.joined(len(texts), pairs), {}
    assert all(linked[of.setdefault(group[i], i)] == linked[i] for i in sorted(group))


def test_tool_calls(spark):
    from partloom.llm import toolcalls

    calls = [(1, 0, 0, "a", "reply", '{"opening":"x","length":5,"after":{"$ref":"b"}}'), (1, 2, 0, "b", "reply", '{"opening":"x","length":1e1}'), (1, 3, 0, "b", "nope", "{}"), (2, 0, 0, "x", "reply", '{"length":1,"opening":"","after":{"$ref":"y"}}'), (2, 1, 0, "y", "reply", '{"length":0,"opening":3,"q":1,"after":{"$ref":"x"}}'), (3, 0, 0, None, "reply", "{bad"), (4, 0, 0, "z", None, None)]
    results = [(1, 1, "a", 'r\n"é'), (1, 4, "b", "r2"), (1, 1, "zz", "orphan"), (2, 0, "y", "early"), (3, 1, None, "none")]
    c = clashing(spark.createDataFrame(calls, "conv_id long, turn long, nth int, call_id string, name string, arguments string"))
    r = clashing(spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"))
    got = {(x.conv_id, x.call_id, x.use, x.status): x for x in toolcalls.link_calls(c, r, toolcalls.TOOLS).collect()}
    assert got[1, "a", 1, "linked"].record == '{"arguments":{"after":{"$ref":"b"},"length":5,"opening":"x"},"id":"a","name":"reply","result":"r\\n\\"é"}'
    assert (got[1, "a", 1, "linked"].place, got[1, "a", 1, "linked"].depth) == (2, 1) and got[1, "b", 1, "linked"].place == 2
    assert got[1, "b", 2, "unanswered"].errors == ["$: unknown tool"] and (1, "zz", 1, "orphan") in got
    assert got[2, "x", 1, "unanswered"].cyclic and got[2, "y", 1, "early"].errors == ["$.length: under minimum", "$.opening: no string", "$.q: unknown"]
    assert got[3, None, 1, "unanswered"].errors == ["$: no JSON"] and (3, None, 1, "orphan") in got
    assert toolcalls.link_calls(c.limit(0), r.limit(0), toolcalls.TOOLS).count() == 0


def _calls(spark, graphs):
    """graphs: for each conversation, (turn, call, references) rows."""
    import json

    made = [(c, turn, i, name, "lines", json.dumps({"lines": [], "after": [{"$ref": r} for r in refs]})) for c, g in graphs.items() for i, (turn, name, refs) in enumerate(g)]
    return spark.createDataFrame(made, "conv_id long, turn long, nth int, call_id string, name string, arguments string")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12])
def test_a_cycle_alone(spark, n):
    from partloom.llm import toolcalls

    calls = _calls(spark, {1: [(i, f"c{i}", [f"c{(i + 1) % n}"]) for i in range(n)]})
    got = toolcalls.link_calls(calls, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), {}).collect()
    assert len(got) == n and all(r.cyclic and r.depth == 0 and r.place == n - 1 for r in got)


def test_places_of_any_graph(spark):
    from partloom.llm import toolcalls

    rng, graphs = random.Random(8), {}
    for c in range(60):
        n = rng.randint(1, 9)
        graphs[c] = [(rng.choice([i, max(0, i - 1)]), f"c{i}", rng.sample([f"c{j}" for j in range(n + 1) if j != i or rng.random() < 0.1], k=rng.choice([0, 0, 1, 1, min(2, n)]))) for i in range(n)]
    graphs[60] = [(i, f"c{i}", [f"c{i + 1}"]) for i in range(20)]  # one long way
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id): (r.place, r.depth, r.cyclic) for r in toolcalls.link_calls(_calls(spark, graphs), none, {}).collect()}
    for c, g in graphs.items():
        assert {k[1]: v for k, v in got.items() if k[0] == c} == brute.places(g), g


def test_op7_tool_calls(spark, small):
    import json

    from partloom.llm import toolcalls

    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want, said = [], {(c, t): (role, text) for c, t, role, text in turns}
    assert len(said) == len(turns)
    text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for (c, t), (role, what) in said.items():
        if role == "assistant":
            answer = said.get((c, t + 1), (None, None))
            content = answer[1] if answer[0] == "user" else None
            arguments = {"lines": what.split("\n")} if "\n" in what else {"opening": what, "length": len(brute.RUN.findall(what))}
            arguments |= {"after": {"$ref": f"c{t - 2}"}} if t > 2 else {}
            want.append((c, t, "linked" if answer[0] == "user" else "unanswered", text({"arguments": arguments, "id": f"c{t}", "name": "lines" if "\n" in what else "reply", "result": content})))
        elif role == "user" and t > 0:
            if said.get((c, t - 1), (None,))[0] != "assistant":
                want.append((c, None, "orphan", None))
        else:
            want.append((c, t, "turn", text({"content": what, "role": role})))
    got = [(r.conv_id, r.turn, r.status, r.record) for r in toolcalls.op7_tool_calls(spark, small).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_schemas_and_numbers():
    from partloom.llm import toolcalls

    assert toolcalls.faults(None, {"type": ["string", "null"]}) == [] and toolcalls.faults(1, {"type": ["string", "null"]}) == ["$: no string or null"]
    assert toolcalls.faults(True, {"enum": [1]}) == ["$: not in enum"] and toolcalls.faults(1.0, {"enum": [1]}) == [] and toolcalls.faults("x", {"minLength": 5}) == []
    toolcalls.canonical(toolcalls._strict('"\\ud800"')).encode()
    for bad in ("1e400", "NaN", '{"a":1,"a":2}'):
        with pytest.raises(ValueError):
            toolcalls._strict(bad)


def test_conversation_calls_hold_whole_texts(spark):
    import json

    from partloom.llm import toolcalls

    text = "a single line of more than twenty characters " * 30
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    calls, _ = toolcalls.conversation_calls(turns)
    assert json.loads(calls.first().arguments)["opening"] == text
    first = spark.createDataFrame([(1, 0, "system", 's"'), (2, 0, "user", None), (2, 1, "assistant", "a"), (2, 2, "user", "b"), (3, 0, None, "c")], turns.schema)
    assert rows(toolcalls.other_turns(first), "conv_id", "turn", "record") == [(1, 0, '{"content":"s\\"","role":"system"}'), (2, 0, '{"content":null,"role":"user"}'), (3, 0, '{"content":"c","role":null}')]


def test_mixing(spark, small, edge, empty):
    from partloom.llm import mixing

    got = mixing.op8_mixing(spark, small).toPandas()
    sources = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").toPandas()
    joined = got.merge(sources, on="doc_id")
    assert (joined["size"] == [len(brute.RUN.findall(t or "")) for t in joined.text]).all()
    assert (got.taken <= 2 * got["size"]).all() and got.taken.sum() == int(got["size"].sum() * 1.5)
    sums = joined.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"))
    assert (sums.said == sums["size"]).all() and ((sums.taken - sums.target).abs() <= len(sums) + 1).all()
    left, weight, full = 1.5 * sums["size"].sum(), dict(zip(sorted(sums.index), [3, 1, 2] * 10)), {}
    while over := [s for s in weight if s not in full and (left - sum(full.values())) * weight[s] / sum(w for t, w in weight.items() if t not in full) > 2 * sums["size"][s]]:
        full |= {s: 2 * sums["size"][s] for s in over}
    rate = (left - sum(full.values())) / sum(w for t, w in weight.items() if t not in full)
    assert np.allclose(sums.target, [full.get(s, rate * weight[s]) for s in sums.index])
    assert rows(mixing.op8_mixing(spark, small), "doc_id", "taken") == sorted(map(tuple, got[["doc_id", "taken"]].to_numpy().tolist()), key=repr)
    mixed = mixing.mix_documents(edge)
    total = sum(len(brute.RUN.findall(t or "")) for _, t in [*EDGE, (None, "no id")])
    assert mixed.columns == edge.columns and sum(len(brute.RUN.findall(r.text)) for r in mixed.collect()) == int(1.5 * total)
    assert mixing.mix_documents(empty).count() == 0


def test_quality(spark, small, edge, empty):
    from partloom.llm import quality

    good = [(i, f"this is a calm text about number {i} and weather in town {i % 7}.", 1, 0) for i in range(300)]
    toxic = [(i, f"this is a calm text about number {i} you utter scumbag in town.", 1, 1) for i in range(300, 400)]
    junk = [(i, "BUY!! " * 20 + f"{i}", 0, 0) for i in range(400, 500)]
    made = spark.createDataFrame([*good, *toxic, *junk], "doc_id long, text string, quality int, toxic int")
    docs = made.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"))
    labels = made.where("doc_id % 2 = 0").select("doc_id", "quality", "toxic").union(spark.createDataFrame([(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int"))
    judged = quality.classify(docs, labels, keep=[F.col("doc_id")], host=F.col("source"), path=F.col("lang")).toPandas().set_index("doc_id").sort_index()
    assert judged.loc[:299].keep.all() and not judged.loc[300:].keep.any() and (judged.loc[300:399].p_toxic > 0.5).all()
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == set(range(300))
    assert quality.keep_good(edge, labels).count() > 0 and quality.keep_good(edge, labels).columns == edge.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == 500 and quality.keep_good(empty, labels).count() == 0


def test_quality_with_labels_of_one_class(spark):
    from partloom.llm import quality

    docs = spark.createDataFrame([(i, f"some words {i}", "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", F.lit(0).alias("quality"), F.lit(1).alias("toxic"))
    assert quality.keep_good(docs, labels).count() == 50 and quality.keep_good(docs, labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)})).count() == 50


def test_site_rates(spark):
    from partloom.llm import quality

    rng = random.Random(7)
    sites = [(h, p, n := rng.randint(1, 40), n * rng.betavariate(1 + (h or 0), 4)) for h in (None, 1, 2, 3) for p in (None, "a", "b", "c")]
    got = quality.site_rates(spark.createDataFrame(sites, "host long, path string, n long, low double"), "low").collect()
    want = brute.site_shifts(sites)
    assert len(got) == len(want) and all(abs(r.low_shift - want[r.host, r.path]) < 1e-9 for r in got)


def test_op9_quality(spark, small):
    from partloom.llm import quality

    got = quality.op9_quality(spark, small).toPandas()
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    joined = got.merge(labels, on="doc_id")
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count() and ((got.p_toxic <= 0.5) & (got.p_low <= 0.5) == got.keep).all()
    bad = (joined.toxic == 1) | (joined.quality == 0)
    assert (joined.keep != bad).mean() > 0.9


def test_tokens(spark, small, edge, empty):
    from partloom.llm import sstable

    tokenizer = Tokenizer.from_file(BPE)
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    start, want = 0, []
    for i, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert rows(sstable.op10_token_shards(spark, small), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    manifest = sstable.write_tokens(edge, BPE, block_bytes=64)
    back = sorted((r.start, r.doc_id, tokenizer.decode(r.ids[:-1], skip_special_tokens=False)) for r in sstable.read_tokens(manifest, split_bytes=500).collect())
    assert [(i, t) for _, i, t in back] == [(None, "no id"), *((i, t or "") for i, t in EDGE)]
    asked = spark.createDataFrame([(4,), (8,), (99,), (-5,), (None,)], "doc_id long")
    assert sorted((r.doc_id, len(r.ids)) for r in sstable.lookup(manifest, asked).collect()) == sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in EDGE if i in (4, 8))
    assert sstable.read_tokens(sstable.write_tokens(empty, BPE)).count() == 0


def test_pieces_give_the_same_ids():
    from partloom.llm.sstable import PieceEncoder

    tokenizer, encoder, rng = Tokenizer.from_file(BPE), PieceEncoder(BPE, room=200), random.Random(3)
    alphabet = [" ", "\n", "a", "B", "é", "1", ".", "'s", "\t", "  ", "\r\n", "<|endoftext|>", "\x1c", "!", "\xa0", "ß,", "中", " "]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text) == encoder.pack(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_components(spark):
    from partloom.llm.components import connected_components

    chain = [(str(i).zfill(3), str(i + 1).zfill(3)) for i in range(200)] + [("x", "y"), ("y", "x"), ("q", "q"), (None, "z")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {**{str(i).zfill(3): "000" for i in range(1, 201)}, "y": "x"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
