"""Quality classifier: document evidence within hierarchical empirical-Bayes priors of its site.

A logistic regression over a dozen style measures and the words of its sample gives every document a probability of being
good, p. Sums of p over all documents, grouped by host and path, give each site a rate; rates of
sparse paths are shrunk towards their host's and those of sparse hosts towards the global one. How strongly is taken
from the data: the precision of the Beta prior on either level follows from the variance between sites that sampling
alone does not explain (method of moments). The document's own p is taken out of its site's sums, then the site's shrunk
rate replaces the global rate as the prior of the document.

A document is *good* if it has quality 1 and is not toxic. The regression is fitted in one task on a bounded sample,
``SAMPLE`` labelled documents of either class at most; sums and rates are over all documents.

Defined cases: a null or blank text has p = 0 and is rejected; null hosts and paths are the site ``""``; contradicting
labels of one document count as bad; of the rows that repeat a labelled doc_id the one with the least text digest is
learned from; without labels of both classes p is the share of good labels (1 without labels) for
every text with a word; a posterior that ties with the threshold is kept; rows that repeat are judged each, texts of any
length whole; empty tables are allowed; other columns are kept apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import joined_small, save, utf8

#: Labelled documents of either class in the sample, documents of it that a word must be in for the regression to see it.
SAMPLE, LEAST_DOCS = 3000, 8
#: The odds below which a document is rejected, sites sent to all tasks at most (more are joined by a shuffle).
THRESHOLD, MOST_SITES = 0.5, 200_000
_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
N_STYLE = 11


def style(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Measures of form, each of about 0 to 1. ``words`` are not empty."""
    n, chars = len(words), max(1, sum(map(len, words)))
    less = lambda drop: (len(text) - len(text.translate(None, drop))) / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [less(_SYMBOLS), less(_CAPITALS), less(_DIGITS), text.count(b"!") / n, text.count(b"|") / n, text.count(b".") / n, min(chars / n, 20) / 20, distinct / n, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / n, np.log1p(n) / 10]


def parts(text: bytes) -> tuple[list[float], set[bytes]] | None:
    words = text.lower().split()
    if not words:
        return None
    seen = {w.strip(b".,;:!?*$%&#|\"'()") for w in words}
    return style(text, words, len(set(words))), seen - {b""}


class _Sparse:
    """A 0/1 matrix by the places of its ones."""

    def __init__(self, sets: list[list[int]], width: int):
        self.row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        self.col = np.fromiter((i for x in sets for i in x), np.int64, len(self.row))
        self.shape = len(sets), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], self.shape[1])


def fit_regression(form: np.ndarray, words: _Sparse, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights over ``[form, words, 1]`` by Newton's method with a ridge penalty on all but the bias; each step is solved
    by conjugate gradients, so that any number of words may take part."""
    k, v = form.shape[1], words.shape[1]
    penalty = np.append(np.full(k + v, ridge), 1e-6)
    times = lambda w: form @ w[:k] + words.times(w[k:-1]) + w[-1]
    back = lambda r: np.concatenate([form.T @ r, words.transposed(r), [r.sum()]])
    w = np.zeros(k + v + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4)
        step, r = np.zeros_like(w), back(y - p) - penalty * w
        scale = 1 / (np.concatenate([(form * form * s[:, None]).sum(axis=0), words.transposed(s), [s.sum()]]) + penalty)
        d = scale * r
        rho, least = r @ d, 1e-12 * (r @ r)
        for _ in range(200):
            if r @ r <= least:
                break
            a = back(s * times(d)) + penalty * d
            alpha = rho / (d @ a)
            step += alpha * d
            r = r - alpha * a
            z = scale * r
            rho, before = r @ z, rho
            d = z + rho / before * d
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _learn(found: list[tuple[int, list[float], set[bytes]]], prior: float) -> tuple[list[bytes], np.ndarray]:
    """All words of ``LEAST_DOCS`` documents and more, and weights over ``[style, words, 1]``, the bias moved to the given share of good documents."""
    y = np.array([k for k, _, _ in found], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    df = Counter(w for _, _, words in found for w in words)
    vocabulary = sorted(w for w, n in df.items() if n >= LEAST_DOCS)
    at = {w: i for i, w in enumerate(vocabulary)}
    form = np.array([s for _, s, _ in found])
    lex = _Sparse([sorted(at[w] for w in words & at.keys()) for _, _, words in found], len(at))
    mean, sd = form.mean(axis=0), form.std(axis=0) + 1e-6
    w = fit_regression((form - mean) / sd, lex, y)
    w[-1] += np.log(prior / (1 - prior)) - np.log(n1 / n0) - (w[:N_STYLE] * mean / sd).sum()
    w[:N_STYLE] /= sd
    return vocabulary, w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The document classifier: ``words`` and ``weights``, or only the ``share`` of good labels."""
    marks = labels.select("doc_id", ((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good")).where("doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    marks = marks.withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    counts = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return {"words": None, "share": 1.0 if not bad else 0.0}
    picked = marks.where("good = 1").orderBy("h").limit(sample).unionByName(marks.where("good = 0").orderBy("h").limit(sample))
    labelled = docs.select("doc_id", utf8("text").alias("t")).join(F.broadcast(picked), "doc_id")
    # one row of each labelled document, however often it repeats
    texts = labelled.groupBy("doc_id").agg(F.min_by(F.struct("good", "t", "h"), F.md5("t")).alias("x")).select("x.*").repartition(1)
    prior = good / (good + bad)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((h, k, x) for b in batches for k, t, h in zip(b["good"], b["t"], b["h"], strict=True) if (x := parts(t)))
        found = [(int(k), s, words) for _, k, (s, words) in rows]
        if len({k for k, _, _ in found}) == 2:
            words, w = _learn(found, prior)
            yield pd.DataFrame({"words": [b" ".join(words)], "weights": [w.astype("<f8").tobytes()]})

    got = texts.mapInPandas(learn, "words binary, weights binary").first()
    if got is None:
        return {"words": None, "share": prior}
    return {"words": bytes(got["words"]).split(), "weights": np.frombuffer(got["weights"], "<f8")}


class Evidence:
    """The fitted classifier, ready for texts."""

    def __init__(self, model: dict):
        self.model = model
        if model["words"] is not None:
            w = model["weights"]
            self.form, self.bias = w[:N_STYLE], w[-1]
            self.lexical = dict(zip(model["words"], w[N_STYLE:-1].tolist(), strict=True))

    def logit(self, text: bytes) -> float:
        x = parts(text)
        if x is None:
            return -30.0
        if self.model["words"] is None:
            return float(np.clip(np.log(max(self.model["share"], 1e-9) / max(1 - self.model["share"], 1e-9)), -30, 30))
        v = self.bias + float(np.dot(self.form, x[0])) + sum(map(self.lexical.__getitem__, x[1] & self.lexical.keys()))
        return max(-30.0, min(30.0, v))


def with_evidence(rows: DataFrame, model: dict, text: str = "__t", out: str = "__x") -> DataFrame:
    """``rows`` without the binary column ``text`` and with the logit of p in ``out``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != text]
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(sent.value)
        for b in batches:
            yield b[keep].assign(**{out: [evidence.logit(t) for t in b[text]]})

    return rows.mapInPandas(run, schema)


def _p(x: str = "__x") -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(x)))


def sites(scored: DataFrame) -> DataFrame:
    """A row per ``host, path`` with the sums of its documents and host, the global rate and both precisions. ``scored``
    has ``host, path, __x``, a row per document; only grouped sums of it are used."""
    paths = save(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(_p()).alias("y")), "site-paths")
    hosts = save(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("y").alias("hy"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("y") * F.col("y") / F.col("n")).alias("yyn")), "site-hosts")
    total = hosts.agg(F.sum("hn").alias("N"), F.sum("hy").alias("Y"), F.count(F.lit(1)).alias("H"), F.sum(F.col("hn") * F.col("hn")).alias("NN"), F.sum(F.col("hy") * F.col("hy") / F.col("hn")).alias("YYN"),
                      F.sum(F.col("yyn") - F.col("hy") * F.col("hy") / F.col("hn")).alias("within"), F.sum(F.col("k") - 1).alias("within_df"), F.sum(F.col("hn") - F.col("nn") / F.col("hn")).alias("within_n"))
    m = "least(greatest(Y / N, 1e-6d), 1 - 1e-6d)"
    # between-site variance: what the squares of site means exceed the sampling variance by, per effective size
    between = f"greatest((YYN - Y * Y / N - (H - 1) * {m} * (1 - {m})) / greatest(N - NN / N, 1e-9d), 1e-6d)"
    inside = f"greatest((within - within_df * {m} * (1 - {m})) / greatest(within_n, 1e-9d), 1e-6d)"
    precision = lambda var: F.expr(f"least(greatest({m} * (1 - {m}) / ({var}) - 1, 2d), 1e6d)")
    total = total.select(F.expr(m).alias("rate"), precision(between).alias("k_host"), precision(inside).alias("k_path"))
    return save(paths.join(hosts.select("host", "hn", "hy"), "host").crossJoin(F.broadcast(total)), "sites")


def posterior() -> Column:
    """The logit of the document's posterior, its own p taken out of its site's sums."""
    logit = lambda q: F.log(q / (F.lit(1.0) - q))
    inside = lambda q: F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6))
    p = _p()
    host = (F.col("hy") - p + F.col("k_host") * F.col("rate")) / (F.col("hn") - 1 + F.col("k_host"))
    path = (F.col("y") - p + F.col("k_path") * host) / (F.col("n") - 1 + F.col("k_path"))
    return F.col("__x") + logit(inside(path)) - logit(inside(F.col("rate")))


def _site_columns(host: str, path: str) -> list[Column]:
    return [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")]


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, host, path, evidence, site_rate, score, kept``: the document's own p, its site's shrunk rate, the
    posterior probability of being good and whether that reaches ``threshold``."""
    rows = docs.select("doc_id", *_site_columns(host_col, path_col), utf8("text").alias("__t"))
    scored = save(with_evidence(rows, fit(docs, labels)), "site-scores")
    found = joined_small(scored, sites(scored), ["host", "path"], "inner", MOST_SITES).withColumn("__z", posterior())
    rate = F.lit(1.0) / (1 + F.exp(-(F.col("__z") - F.col("__x") + F.log(F.col("rate") / (1 - F.col("rate"))))))
    words = F.col("__x") > -30
    score = F.when(words, _p("__z")).otherwise(0.0)
    return found.select("doc_id", "host", "path", F.when(words, _p()).otherwise(0.0).alias("evidence"), rate.alias("site_rate"), score.alias("score"), (score >= threshold).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``. They are written once beside their evidence, so that
    texts are scored once, and never shuffled while sites are few enough to be sent to all tasks."""
    model, names = fit(docs, labels), docs.columns
    inner = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)]
    rows = save(with_evidence(docs.select(*inner, *_site_columns(host_col, path_col), utf8("text").alias("__t")), model), "site-evidence")
    found = joined_small(rows, sites(rows.select("host", "path", "__x")), ["host", "path"], "inner", MOST_SITES).where((F.col("__x") > -30) & (_p_of(posterior()) >= threshold))
    return found.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])


def _p_of(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
