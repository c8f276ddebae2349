"""Quality classifier: text evidence of each document, shrunk towards what its site is like.

Evidence: a logistic regression on words, their first four and five bytes, and bins of how a text is written (capitals,
symbols, repetition and so on). It is fitted on at most ``FIT_ROWS`` labelled rows, taken in order of a hash of their id.
Of all features those take part that are in ``LEAST_ROWS`` rows and differ between the classes by ``LEAST_RATIO`` in log
odds.

Sites: documents are grouped by host and, below it, by path. The rate of bad documents of a host is the mean of a beta
distribution whose prior is the rate over all documents, that of a path has its host's rate for prior. How strong the
priors are is estimated from how much the groups' rates differ (method of moments), so sparse sites stay near their
parents. A document's log odds are its evidence plus what its path's rate adds to the rate over all.

All sums over documents are grouped aggregates with partial sums; only the fit rows' features, bounded by ``FIT_ROWS``, the
model and a few totals go through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.shared import bounded, field, numbered, stored, without

FIT_ROWS, LEAST_ROWS, LEAST_RATIO, PENALTY = 20_000, 3, 2.0, 1.0
HEADS = ("toxic", "low")
_LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_UPPER, _DIGITS, _SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#$%&*@^~=<>{}[]\\_+"
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _without(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def style(text: bytes, words: list[bytes], kinds: int) -> list[str]:
    """Bins of how a text is written."""
    n, letters = max(1, len(words)), max(1, _without(text, _LETTERS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = {
        "upper": _without(text, _UPPER) / letters,
        "symbol": min(1.0, _without(text, _SYMBOLS) / n),
        "digit": _without(text, _DIGITS) / max(1, len(text)),
        "bar": min(1.0, text.count(b"|") / n),
        "bang": min(1.0, text.count(b"!") / n),
        "again": sum(map(bytes.__eq__, words, words[1:])) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    size = int(math.log2(n))
    return [*(f"{k}={math.ceil(10 * v)}" for k, v in share.items()), f"kinds={size},{int(10 * kinds / n)}", f"length={min(20, letters // n)}"]


def features(text: bytes | None) -> tuple[set[bytes], list[str]]:
    """Distinct words and style bins."""
    raw = text or b""
    words = raw.translate(_SPLIT).split()
    kinds = set(words)
    return kinds, style(raw, words, len(kinds))


def _all_features(kinds: set[bytes], bins: list[str]) -> set[str]:
    return {f"w:{w.decode('latin-1')}" for w in kinds} | {f"{k}:{w[:k].decode('latin-1')}" for w in kinds for k in (4, 5) if len(w) > k} | set(bins)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> tuple[dict[str, tuple[float, float]], tuple[float, float]]:
    """Weights of features for both heads, and both intercepts.

    Labels with a null id or class don't count; of several labels of an id the worst counts. Without labels the model is
    empty and nothing is rejected.
    """
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), (1 - F.min("quality")).alias("low"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # its bound is what lets it be sent to all tasks
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stored(rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("low").cast("int").alias("low")), "fit-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, low in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for f in {*_all_features(*features(text.as_py())), ""}:
                    c = seen.setdefault(f, [0, 0, 0])
                    c[0] += 1
                    c[1] += toxic
                    c[2] += low
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(3))], ["feature", "n", "toxic", "low"])

    counts = stored(rows.mapInArrow(count, "feature string, n long, toxic long, low long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "low"))), "features")
    if (total := counts.where("feature = ''").first()) is None:
        return {}, (-math.inf, -math.inf)

    def ratio(head: str) -> Column:
        bad, good = F.col(head), F.col("n") - F.col(head)
        return F.abs(F.log((bad + 0.5) / (total[head] + 1.0)) - F.log((good + 0.5) / (total["n"] - total[head] + 1.0)))

    strength = F.greatest(*map(ratio, HEADS))
    strong = counts.where((F.col("feature") != "") & (F.col("n") >= LEAST_ROWS) & ((strength >= LEAST_RATIO) | F.col("feature").contains("=")))
    names = sorted(r.feature for r in strong.select("feature").collect())
    at = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(at.value[f] for f in _all_features(*features(x.as_py())) if f in at.value) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], ["found", "toxic", "low"])

    seen = rows.mapInArrow(encode, "found array<int>, toxic int, low int").toArrow().combine_chunks()
    found = seen["found"].combine_chunks()
    sizes, columns = np.diff(found.offsets.to_numpy()), found.flatten().to_numpy()
    fitted = [logistic(sizes, columns, seen[h].to_numpy().astype(float), len(names)) for h in HEADS]
    return {f: (float(fitted[0][0][i]), float(fitted[1][0][i])) for i, f in enumerate(names)}, (fitted[0][1], fitted[1][1])


def logistic(sizes: np.ndarray, columns: np.ndarray, y: np.ndarray, n: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on binary features with an L2 penalty, by gradient steps with
    momentum and a scale for each weight. sizes: features of each row; columns: which."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    w = np.zeros(n + 1)
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    weight = np.where(y > 0, (len(y) - y.sum()) / max(1.0, y.sum()), 1.0)  # both classes count alike
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=w[columns], minlength=len(sizes)) + w[n]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        miss *= weight
        g = np.append(np.bincount(columns, weights=miss[owner], minlength=n), miss.sum())
        g[:n] += PENALTY * w[:n]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:n], float(w[n])


def evidence(docs: DataFrame, model: dict[str, tuple[float, float]], base: tuple[float, float], *, keep: list[Column], text_col: str) -> DataFrame:
    """The columns keep, and each head's log odds from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model, {k: {f[2:].encode("latin-1"): v for f, v in model.items() if f.startswith(f"{k}:")} for k in ("w", "4", "5")}, base))
    picked = docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    n = len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, by, base = sent.value
        words, four, five = by["w"], by["4"], by["5"]
        for batch in batches:
            toxic, low = [], []
            for text in batch.column(n):
                kinds, bins = features(text.as_py())
                found = [words[w] for w in kinds & words.keys()] + [four[p] for p in {w[:4] for w in kinds if len(w) > 4} & four.keys()] + [five[p] for p in {w[:5] for w in kinds if len(w) > 5} & five.keys()] + [model[b] for b in bins if b in model]
                toxic.append(base[0] + sum(x for x, _ in found))
                low.append(base[1] + sum(x for _, x in found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(toxic, pa.float64()), pa.array(low, pa.float64())], names)

    names = [*picked.columns[:n], *HEADS]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n])
    return picked.mapInArrow(score, f"{kinds}, toxic double, low double")


def _rate(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: str, n: str, parent: str) -> float:
    """How many documents a prior is worth: the larger, the less the groups' rates differ beyond chance."""
    row = groups.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * (F.col(rate) - F.col(parent)) ** 2).alias("between"), F.sum(F.col(parent) * (1 - F.col(parent))).alias("chance"), F.sum(F.col(n) * F.col(parent) * (1 - F.col(parent))).alias("whole")
    ).first()
    if not row.whole or row.between <= row.chance:
        return 1e6  # no more than chance: all sites are alike
    return max(1.0, (row.whole - row.between) / (row.between - row.chance)) if row.whole > row.between else 1.0


def site_rates(paths: DataFrame, head: str) -> DataFrame:
    """paths (host, path, n, and a head's sum of probabilities) to host, path and shift: what a path's rate adds to the log
    odds over all documents."""
    paths = paths.select("host", "path", "n", F.col(head).alias("bad"))
    n, bad = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    overall = (bad + 0.5) / (n + 1.0)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("bad").alias("bad_host")).withColumn("parent", F.lit(overall)).withColumn("raw", F.col("bad_host") / F.col("n_host"))
    s = _strength(hosts, "raw", "n_host", "parent")
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("bad_host") + s * overall) / (F.col("n_host") + s)).alias("rate_host"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).select("host", "path", "n", "bad", "rate_host", (F.col("bad") / F.col("n")).alias("raw"))
    s = _strength(joined, "raw", "n", "rate_host")
    rate = (F.col("bad") + s * F.col("rate_host")) / (F.col("n") + s)
    return joined.select("host", "path", (_logit(rate) - _logit(F.lit(overall))).alias(f"{head}_shift"))


def classify(docs: DataFrame, labels: DataFrame, *, keep: list[Column], host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The columns keep, host, path, the probabilities p_toxic and p_low (low quality), and keep: neither is over a half.

    Whole texts count, however long. Null and empty texts have no features but their style's. Documents without a host or
    path share the null site. Repeated rows are judged alike. Labels of one class only, or none, give no feature weight
    that tells classes apart; without labels nothing is rejected. An empty table gives no rows.
    """
    model, base = fit(docs, labels, id_col=id_col, text_col=text_col, fit_rows=fit_rows)
    scored = stored(evidence(docs, model, base, keep=[*keep, host.cast("string").alias("host"), path.cast("string").alias("path")], text_col=text_col), "scored")
    columns = scored.columns[: len(keep)]
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(_rate(F.col(h))).alias(h) for h in HEADS)), "paths")
    sites = paths.select("host", "path")
    for head in HEADS:
        own = site_rates(paths, head).select(F.col("host").alias("_host"), F.col("path").alias("_path"), f"{head}_shift")
        sites = sites.join(own, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left").drop("_host", "_path")
    sites = stored(sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *(f"{h}_shift" for h in HEADS)), "sites")
    judged = scored.join(bounded(sites), F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    judged = judged.select(*columns, "host", "path", *(_rate(F.col(h) + F.coalesce(f"{h}_shift", F.lit(0.0))).alias(f"p_{h}") for h in HEADS))
    return judged.withColumn("keep", (F.col("p_toxic") <= 0.5) & (F.col("p_low") <= 0.5))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", row: Column | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps. row: see ``numbered``."""
    rows = numbered(docs, row)
    flat = rows.select("row", field(id_col).alias("doc_id"), field(text_col).alias("text"), field(host_col).alias("host"), field(path_col).alias("path"))
    judged = classify(flat, labels, keep=[F.col("row")], host=F.col("host"), path=F.col("path"))
    return without(rows, judged.where(~F.col("keep"))).select("doc.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source and its path the source's part in its language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = classify(docs, labels, keep=[F.col("doc_id")], host=F.col("source"), path=F.col("lang"))
    return judged.select("doc_id", "host", "path", F.round("p_toxic", 6).alias("p_toxic"), F.round("p_low", 6).alias("p_low"), "keep")
