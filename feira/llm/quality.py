"""Quality classifier: positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import held_out, prepare, table
from feira.llm.sampling import learnable, sample
from feira.session import write_and_read

MOST_ROWS = 10_000  # trusted positives, and as many unlabelled documents, that a model is fitted on
CUT = 0.7
HIDDEN = 24
LETTERS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\n\x0b\f\r",
    "line": b"\n",
    "stop": b".,;:",
    "call": b"!?",
    "quote": b"\"'()-",
    "mark": b"#$%&*+/<=>@[\\]^_`{|}~",
    "high": bytes(range(128, 256)),
}
FEATURES = len(LETTERS) + 9


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, and how words, neighbours and lines repeat; all between 0 and about 1.

    Null counts as empty. Whole texts are read; the numbers don't depend on language or source.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [counts[list(codes)].sum() / max(len(raw), 1) for codes in LETTERS.values()]
    tokens = raw.split()
    n = max(len(tokens), 1)
    distinct = set(tokens)
    repeats = sum(map(bytes.__eq__, tokens, tokens[1:]))
    shouted = sum(map(bytes.isupper, tokens))
    marked = sum(not (t[-1:].isalnum() or t[-1] > 127 or t[-1] in b".,") for t in tokens)
    lines = raw.split(b"\n")
    pairs = set(zip(tokens, tokens[1:], strict=False))
    return np.array(
        [
            *shares,
            np.log1p(len(tokens)) / 10,
            len(distinct) / n,
            # Vocabulary against what a text of this length would have, if it grew with the root.
            min(2.0, len(distinct) / n**0.5 / 10),
            repeats / n,
            shouted / n,
            marked / n,
            len(pairs) / n,
            len(set(lines)) / len(lines),
            sum(map(len, tokens)) / n / 20,
        ]
    )


@dataclass(frozen=True)
class Net:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ w1 + b1, 0) @ w2 + b2

    @property
    def fitted(self) -> bool:
        return any(w.any() for w in self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int = 5, steps: int = 1500) -> Net:
    """Fit a net by Adam. With a prior, on the non-negative unbiased risk; without, positive against unlabelled.

    The unbiased risk is prior * E_p[l(g)] + E_u[l(-g)] - prior * E_p[l(-g)] with the logistic loss l. Its
    last two terms estimate the risk on negatives and can't be below 0: where a batch's estimate is, the
    step goes the other way on them, which undoes the overfit.
    """
    rng = np.random.default_rng(seed)
    both = np.vstack([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    d = pos.shape[1]
    w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        p = zp[rng.integers(0, len(zp), 256)]
        u = zu[rng.integers(0, len(zu), 256)]
        x = np.vstack([p, u])
        a = x @ w[0] + w[1]
        h = np.maximum(a, 0)
        s = _sigmoid(h @ w[2] + w[3])
        sp, su = s[:256], s[256:]
        if prior is None:
            g = np.concatenate([sp - 1, su]) / 256
        else:
            negative = -np.log1p(-su + 1e-9).mean() + prior * np.log1p(-sp + 1e-9).mean()
            if negative >= 0:
                g = np.concatenate([prior * (sp - 1) - prior * sp, su]) / 256
            else:
                g = np.concatenate([prior * sp, -su]) / 256
        back = np.outer(g, w[2]) * (a > 0)
        grads = [x.T @ back, back.sum(axis=0), h.T @ g, g.sum(keepdims=True)]
        rate = 0.01 * (1 - 0.9 * step / steps)
        for i, grad in enumerate(grads):
            grad = grad + 1e-4 * w[i]
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Net(mean, scale, tuple(w))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled.

    Nets are trained to tell one half of the positives from one half of the unlabelled; on the other halves,
    for each score c, the share of unlabelled over c is compared with that of positives over c. Where
    no negatives score that high, the ratio is the prior; elsewhere it is larger. So the least ratio is
    taken, each with an allowance for small counts, and the mean over both ways to halve.
    """
    found = []
    for i in (0, 1):
        net = train(pos[i::2], unl[i::2], None) if len(pos) > 1 and len(unl) > 1 else None
        if net is None:
            return 0.5
        sp, su = np.sort(net.logit(pos[1 - i :: 2])), np.sort(net.logit(unl[1 - i :: 2]))
        cuts = sp[: max(1, len(sp) * 9 // 10)]
        over_p = 1 - np.searchsorted(sp, cuts) / len(sp)
        over_u = 1 - np.searchsorted(su, cuts) / len(su)
        slack = 0.3 * (len(sp) ** -0.5 + len(su) ** -0.5)
        best = np.argmin((over_u + slack) / over_p)
        found.append(over_u[best] / over_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def _feature_column():
    @F.pandas_udf("array<double>")
    def compute(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(x) for x in batch])

    return compute


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Net:
    """Fit on at most ``most_rows`` trusted positives (quality 1) and as many unlabelled documents.

    Both are chosen by a fixed shuffle of the ids, never from the held-out quarter; documents of the labels
    table are taken as unlabelled only where there are no others, and a label 0 is never used. Only their features, of fixed length,
    reach the driver. Without positives or unlabelled documents every text scores alike, 0.5, and the net is not ``fitted``.
    """
    known = learnable(labels, "quality")
    trusted = sample(known.filter("label = 1").select("doc_id"), most_rows)
    ids = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    web = ids.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    web = sample(web if web.head(1) else ids, most_rows)
    chosen = trusted.withColumn("pos", F.lit(True)).union(web.withColumn("pos", F.lit(False)))
    chosen = write_and_read(chosen, "quality-sample")
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    rows = sample(texts, 2 * most_rows).select("pos", _feature_column()("text").alias("x")).toPandas()
    x = {flag: np.array(list(rows.x[rows.pos == flag])) for flag in (True, False)}
    if not len(x[True]) or not len(x[False]):
        return Net(np.zeros(FEATURES), np.ones(FEATURES), (np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.zeros(1)))
    return train(x[True], x[False], estimate_prior(x[True], x[False]))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with ``score``, 0 to 1, higher for better texts; null text counts as empty."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([features(t) for t in batch]).reshape(-1, FEATURES)
            yield pd.Series(net.score(x))

    return docs.drop("score").withColumn("score", scored("text"))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 where the score is ``cut`` or more).

    Null and empty texts are scored like any other. Repeated rows score alike; a null id counts as held out.
    Other columns are passed on, result columns replace columns of their names.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    out = score(docs, fit(docs, labels)).withColumn("held_out", held_out(F.col("doc_id")))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, folder, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
