"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy."""

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

MOST_ROWS = 3_000  # labelled rows of either class that the model is fitted on, one window of each
CUT = 0.3
WINDOW = 256  # words
BUCKETS = 1 << 20
SIZES = (3, 4, 5, 6)
DIMENSION = 8
STEPS = 300
PADDING = 100  # zero vectors averaged in, so that a few words don't settle a score
RATE = 0.05
DECAY = 1e-5
LEAST_BAGS = 4  # bags that an n-gram must be in to get a vector; others weigh nothing
_KEEP = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256)).lower()


def cleaned(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Words as bytes, one blank around and between them, and the window of each word.

    Words are lower-cased runs of letters and digits in UTF-8. A window is WINDOW words in a row; a short rest joins
    the window before it. A word counts once in a window, so a repeated one doesn't outweigh the others.
    """
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()
    starts = list(range(0, max(len(words) - WINDOW // 2, 1), WINDOW))
    sets = [dict.fromkeys(words[i : j]) for i, j in zip(starts, [*starts[1:], len(words)], strict=True)]
    data = b" " + b" ".join(w for part in sets for w in part) + b" "
    return np.frombuffer(data, np.uint8), np.repeat(np.arange(len(sets)), [len(part) for part in sets])


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every character n-gram inside a word; the blanks around a word belong to it.

    A word's n-grams are shared with its misspellings, so an unseen spelling still meets known vectors.
    """
    blank = data == 32
    word = np.cumsum(blank) - 1
    buckets, owners = [], []
    value = np.zeros(len(data), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        value = value[: len(data) - n + 1] * np.uint32(16777619) + data[n - 1 :] + np.uint32(1)
        if n not in SIZES:
            continue
        last = len(data) - n + 1
        # Within one word: as many blanks before the first inner byte as before the last inner byte.
        inside = word[1 : last + 1] == word[n - 2 : n - 2 + last]
        inside &= ~blank[1 : last + 1]
        h = (value[inside] ^ (value[inside] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        buckets.append(((h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32))
        owners.append(word[1 : last + 1][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """Embedding and softmax folded into one number per bucket, as both are linear."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of the most toxic window of the text."""
        data, window = cleaned(text)
        buckets, owners = subwords(data)
        if not len(buckets):
            return float(1 / (1 + np.exp(-self.bias)))
        at = window[owners]
        logits = np.bincount(at, weights=self.weight[buckets]) / (np.bincount(at) + PADDING) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logits.max(), -30, 30))))


def train(bags: list[np.ndarray], toxic: np.ndarray, share: float, seed: int = 3) -> Model:
    """Fit embeddings and softmax weights together, by Adam on the cross-entropy.

    A bag's vector is the mean of its n-grams' embeddings. A fifth of the bags is kept back, and the weights
    are those of the step with the least loss on them. ``share`` is the share of toxic rows among all
    labelled ones; the bias is moved from the sample's odds to these.
    """
    rng = np.random.default_rng(seed)
    sizes = np.array([len(b) + PADDING for b in bags], np.float32)
    # Counted twice instead of kept: all bags at once are much larger than what is learnt from them.
    seen = np.zeros(BUCKETS, np.int64)
    for b in bags:
        seen[np.unique(b)] += 1
    active = np.flatnonzero(seen >= min(LEAST_BAGS, max(1, len(bags) // 50)))
    place = np.full(BUCKETS, -1, np.int32)
    place[active] = np.arange(len(active), dtype=np.int32)
    rows = []
    for b, n in zip(bags, sizes, strict=True):
        u, c = np.unique(b, return_counts=True)
        known = place[u] >= 0
        rows.append((place[u[known]], (c[known].astype(np.int32) / n).astype(np.float32)))
    # N-grams that are everywhere get small steps, rare ones large steps.
    usual = np.zeros(len(active), np.float32)
    for index, value in rows:
        usual[index] += value / len(rows)
    scale = 1 / np.sqrt(usual + 1e-6)
    for index, value in rows:
        value *= scale[index]
    order = rng.permutation(len(rows))
    kept_back, learnt = order[: len(order) // 5], order[len(order) // 5 :]
    params = [
        rng.normal(0, 0.02, (len(active), DIMENSION)).astype(np.float32),
        rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    ]
    m, v = [np.zeros_like(p) for p in params], [np.float32(0) for _ in params]

    def means(chosen):
        index = np.concatenate([rows[i][0] for i in chosen])
        value = np.concatenate([rows[i][1] for i in chosen])
        owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
        mean = np.stack([np.bincount(owner, params[0][index, j] * value, len(chosen)) for j in range(DIMENSION)], 1)
        return index, value, owner, mean

    def shares(mean):
        z = mean @ params[1] + params[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    best, best_loss, best_step = [p.copy() for p in params], np.inf, 0
    for step in range(1, STEPS + 1):
        chosen = rng.choice(learnt, min(128, len(learnt)), replace=False)
        index, value, owner, mean = means(chosen)
        p = shares(mean)
        p[np.arange(len(chosen)), toxic[chosen]] -= 1
        p /= len(chosen)
        back = p @ params[1].T
        vectors = np.empty((len(active), DIMENSION))
        for j in range(DIMENSION):
            vectors[:, j] = np.bincount(index, back[owner, j] * value, len(active)) + DECAY * params[0][:, j]
        grads = [vectors, mean.T @ p, p.sum(axis=0)]
        rate = RATE * (1 - 0.9 * step / STEPS)
        for i, g in enumerate(grads):
            # One step size for all n-grams: a step size of its own for each would learn rare ones by heart.
            m[i] += 0.1 * (g.astype(np.float32) - m[i])
            v[i] += np.float32(0.01) * (np.float32(np.square(g, out=g).mean()) - v[i])
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / np.float32(1 - 0.99**step)) + np.float32(1e-9))
        if step % 20 == 0 or step == STEPS:
            del index, value, owner, vectors, grads, g
            # As many at a time as are learnt from: their vectors take much more room than their means.
            parts = [means(kept_back[i : i + 128])[-1] for i in range(0, len(kept_back), 128)]
            q = shares(np.concatenate(parts)) if parts else np.full((1, 2), 0.5)
            truth = toxic[kept_back] if len(kept_back) else np.zeros(1, int)
            loss = -np.log(q[np.arange(len(truth)), truth] + 1e-9).mean()
            if loss < best_loss:
                best, best_loss, best_step = [p.copy() for p in params], loss, step
            elif step >= best_step + 80:
                break
    e, w, b = best
    weight = np.zeros(BUCKETS, np.float32)
    weight[active] = (e @ (w[:, 1] - w[:, 0])) * scale
    odds = np.log(share / (1 - share)) - np.log(toxic.mean() / (1 - toxic.mean()))
    return Model(weight, float(b[1] - b[0] + odds))


def _bag(doc_id: int, text: str | None) -> np.ndarray:
    """The n-grams of one window of the text, chosen by its id."""
    data, window = cleaned(text)
    buckets, owners = subwords(data)
    at = window[owners] if len(owners) else owners
    return buckets[at == doc_id * 2654435761 % (int(at.max()) + 1)] if len(at) else buckets


def _bag_column():
    @F.pandas_udf("binary")
    def compute(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, texts in rows:
            yield pd.Series([_bag(int(i), t).tobytes() for i, t in zip(ids, texts, strict=True)])

    return compute


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fit on at most ``most_rows`` labelled rows of either class, chosen by a fixed shuffle of the ids.

    Never from the held-out quarter. One window of each row's text, of about WINDOW words, reaches the driver as
    bucket numbers, so what it holds doesn't grow with the corpus or the texts. Where a class has no row,
    every text scores the other class's share.
    """
    known = learnable(labels, "toxic")
    counts = dict(known.groupBy("label").count().collect())
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    chosen = [sample(known.filter(F.col("label") == c), most_rows) for c in (0, 1)]
    chosen = write_and_read(chosen[0].union(chosen[1]), "toxicity-sample")
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    rows = sample(texts, 2 * most_rows).select("doc_id", "label", _bag_column()("doc_id", "text").alias("bag"))
    rows = rows.toPandas().sort_values("doc_id", kind="stable")
    bags = [np.frombuffer(b, np.int32) for b in rows.bag]
    kept = [i for i, b in enumerate(bags) if len(b)]
    toxic = rows.label.to_numpy(np.int64)[kept]
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    return train([bags[i] for i in kept], toxic, share)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 where the score is ``cut`` or more).

    The score is that of the text's most toxic window, so a long text doesn't hide a short passage. Texts
    without letters or digits, null included, score the bias alone. Repeated rows score alike; a null id
    counts as held out. Other columns are passed on, result columns replace columns of their names.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.value.score(t) for t in batch], dtype="float64")

    out = docs.withColumn("score", scored("text")).withColumn("held_out", held_out(F.col("doc_id")))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, folder, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
