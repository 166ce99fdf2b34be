"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are code-point n-grams of 1 to 3 characters of the lower-cased text, hashed to ``DIMS`` buckets. Document
frequencies are counted over every training document. The regression is trained by follow-the-regularised-leader
(FTRL-proximal, per-coordinate rates) with L1 and L2 penalties on a bounded sample, ``PER_LANG`` documents a language at
most, in one task; a second bounded sample that training does not see sets the temperature that divides the logits.
Rows alike in id, text and language are sampled by their number, their share of the sample rounded by a hash, and all
go to one of the two. Every language that occurs is learned: sample and coefficients stand in temporary files where they
are large.
Every document is predicted from its whole text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null language is never learned; where
no language can be learned every text is ``und`` with score 0; equal logits go to the first language in order; rows that
repeat are predicted each; texts of any length are read whole, stretch by stretch; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import frame, joined_small, save

DIMS = 1 << 15
#: Documents of a language in the training sample and in the calibration sample at most.
PER_LANG, PER_LANG_CALIBRATION = 1500, 500
#: Rows of a table that is broadcast at most; elements of an array that is held in memory at most.
MOST_SENT, MOST_HELD = 200_000, 1 << 25
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-4, 3
_MULT = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def term_counts(text: str, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's character n-grams, ascending, and how often each occurs. N-grams that begin in a stretch of
    ``step`` code points are hashed together, so that a long text takes no more room than its own and a stretch's."""
    low, counts = f" {text.lower()} ", np.zeros(DIMS, np.int64)
    for a in range(0, len(low), step):
        c = np.frombuffer(low[a : a + step + 2].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        h = c * _MULT[0]
        grams = [h[:step]]
        for n in (1, 2):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULT[1] + c[n:] * _MULT[2]
            grams.append(h[:step])
        h = np.concatenate(grams)
        h = (h ^ (h >> np.uint32(16))) * _MULT[1]
        counts += np.bincount(h >> np.uint32(32 - 15), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = term_counts(text)
    v = (1 + np.log(n)) * idf[at]
    return at, v / max(float(np.sqrt(v @ v)), 1e-12)


class _Rows(Sequence):
    """Sparse rows in a temporary file; ``take`` gives some of them."""

    def __init__(self):
        self.file, self.ends, self.mine = tempfile.TemporaryFile(), [0], range(0)

    def add(self, at: np.ndarray, v: np.ndarray) -> None:
        self.file.write(at.astype(np.int32).tobytes() + v.astype(np.float32).tobytes())
        self.ends.append(self.ends[-1] + 2 * len(at))
        self.mine = range(len(self.ends) - 1)

    def take(self, mine: list[int]) -> _Rows:
        out = _Rows.__new__(_Rows)
        out.file, out.ends, out.mine = self.file, self.ends, mine
        return out

    def __len__(self) -> int:
        return len(self.mine)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.ends[self.mine[i]], self.ends[self.mine[i] + 1]
        self.file.seek(4 * a)
        data = self.file.read(4 * (z - a))
        return np.frombuffer(data, np.int32, (z - a) // 2), np.frombuffer(data, np.float32, offset=2 * (z - a))


def _zeros(rows: int, cols: int) -> np.ndarray:
    """Zeros in memory, or in a temporary file that goes with them."""
    if rows * cols <= MOST_HELD:
        return np.zeros((rows, cols))
    return np.memmap(tempfile.TemporaryFile(), np.float64, "w+", shape=(rows, cols))


def train_ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray]], target: list[int], classes: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights ``classes x (DIMS + 1)``, the last the bias, which the L1 penalty spares."""
    z, n = _zeros(DIMS + 1, classes), _zeros(DIMS + 1, classes)

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        out = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        out[np.abs(zz) <= l1] = 0
        return out

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = np.append(rows[i][0], DIMS), np.append(rows[i][1], 1.0)
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = softmax((v @ w)[None])[0]
            p[target[i]] -= 1
            g = v[:, None] * p
            more = nn + g * g
            z[at] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / alpha * w
            n[at] = more
    step = max(1, MOST_HELD // (8 * classes))
    return np.concatenate([weights(np.array(z[a : a + step]), n[a : a + step]).astype(np.float32) for a in range(0, DIMS + 1, step)]).T


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden sections of its logarithm."""
    if not len(target):
        return 1.0

    def loss(t: float) -> float:
        total, step = 0.0, max(1, MOST_HELD // (8 * logits.shape[1]))
        for a in range(0, len(target), step):
            y = target[a : a + step]
            total -= float(np.log(np.maximum(softmax(logits[a : a + step] / np.exp(t))[np.arange(len(y)), y], 1e-300)).sum())
        return total / len(target)

    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each bucket occurs: one vector a task, summed by bucket blocks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for text in b["t"]:
                df[term_counts(text)[0]] += 1
                docs += 1
        if docs:
            parts = df.reshape(64, -1)
            yield frame([(k, docs if k == 0 else 0, p.tolist()) for k, p in enumerate(parts)], ["k", "docs", "df"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame([(int(pdf["k"].iloc[0]), int(pdf["docs"].sum()), np.sum(np.stack(pdf["df"].to_list()), axis=0).tolist())], ["k", "docs", "df"])

    schema = "k int, docs long, df array<long>"
    rows = train.select("t").mapInPandas(count, schema).groupBy("k").applyInPandas(total, schema).collect()
    df = np.zeros((64, DIMS // 64), np.int64)
    for r in rows:
        df[r["k"]] = r["df"]
    return df.ravel(), sum(r["docs"] for r in rows)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``t, l, h``: text, language and hash of the rows that are not held out and have both."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)).alias("h"))


def choose(train: DataFrame, want: int) -> tuple[dict[str, int], DataFrame]:
    """Rows of every language, and of about 1.1 times ``want`` of each ``t, l, h`` and how many rows are alike, ``m``."""
    copies = save(train.groupBy("l", "h").agg(F.count(F.lit(1)).alias("n")), "lang-copies")
    found = save(copies.groupBy("l").agg(F.sum("n").alias("n")), "lang-counts")
    share = found.select("l", F.least(F.lit(1.0), F.lit(1.1 * want) / F.col("n")).alias("share"))
    chance = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    many = F.least("n", F.ceil(F.col("n") * F.col("share") - chance))
    wanted = save(joined_small(copies, share, "l", "inner", MOST_SENT).select("l", "h", many.alias("m")).where("m > 0"), "lang-wanted")
    rows = joined_small(train, wanted, ["l", "h"], "inner", MOST_SENT)
    return {r["l"]: r["n"] for r in found.collect()}, rows.groupBy("l", "h").agg(F.first("t").alias("t"), F.first("m").alias("m"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, per_lang_calibration: int = PER_LANG_CALIBRATION) -> dict:
    """The model: ``langs, idf, weights, temperature``. Only rows that are not held out and have a language count."""
    train = training_rows(docs, id_col, text_col, lang_col)
    want = per_lang + per_lang_calibration
    counts, chosen = choose(train, want)
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "idf": np.zeros(DIMS, np.float32), "weights": np.zeros((0, DIMS + 1), np.float32), "temperature": 1.0}
    df, n = _document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = chosen.repartition(1)
    sent = docs.sparkSession.sparkContext.broadcast((langs, counts, idf))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, counts, idf = sent.value
        number, found, spool = {lang: k for k, lang in enumerate(langs)}, [], _Rows()
        for b in batches:
            for t, lang, h, m in zip(b["t"], b["l"], b["h"], b["m"], strict=True):
                if has_letter(t):
                    found.append((h, number[lang], len(spool), m))
                    spool.add(*tfidf(t, idf))
        found.sort(key=lambda x: (x[0] % (1 << 30), x[0]))
        tested, trained, rows, target, held = [0] * len(langs), [0] * len(langs), [], [], []
        for _, k, x, m in found:
            part = max(1, min(per_lang_calibration, (1 + min(want, counts[langs[k]])) // 4)) if per_lang_calibration else 0
            if tested[k] + m <= part:
                held += [(k, x)] * m
                tested[k] += m
            else:
                m = min(m, per_lang - trained[k])
                rows += [x] * m
                target += [k] * m
                trained[k] += m
        if not rows:
            rows, target = [x for _, x in held], [k for k, _ in held]
        w = train_ftrl(spool.take(rows), target, len(langs))
        logits, by_bucket = _zeros(len(held), len(langs)), np.ascontiguousarray(w.T)
        for i, (at, v) in enumerate(spool.take([x for _, x in held])):
            logits[i] = v @ by_bucket[at] + by_bucket[DIMS]
        temperature = fit_temperature(logits, np.array([k for k, _ in held], int))
        for k in range(len(langs)):
            at = np.flatnonzero(w[k])
            yield frame([(k, at.astype("<u2").tobytes(), w[k][at].astype("<f4").tobytes(), temperature)], ["k", "at", "w", "t"])

    got = save(sample.select("t", "l", "h", "m").mapInPandas(learn, "k int, at binary, w binary, t double"), "lang-weights").collect()
    weights = np.zeros((len(langs), DIMS + 1), np.float32)
    for r in got:
        weights[r["k"], np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["w"], "<f4")
    return {"langs": langs, "idf": idf.astype(np.float32), "weights": weights, "temperature": got[0]["t"]}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, lang_pred, score``. The model, ``DIMS`` weights a language, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        langs, idf, w = m["langs"], m["idf"], np.ascontiguousarray(m["weights"].T)
        for b in batches:
            logits, letters = np.zeros((len(b), max(1, len(langs)))), np.zeros(len(b), bool)
            for i, text in enumerate(b["t"]):
                if langs and has_letter(text):
                    at, v = tfidf(text, idf)
                    logits[i], letters[i] = v @ w[at] + w[DIMS], True
            p = softmax(logits / m["temperature"])
            best = p.argmax(axis=1)
            yield pd.DataFrame({"id": b["id"], "held_out": b["held_out"], "lang_pred": [langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], "score": np.where(letters, p[np.arange(len(b)), best], 0.0)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), held_out(id_col).alias("held_out"))
    return rows.mapInPandas(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
