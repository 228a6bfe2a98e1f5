"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded by shares of byte
classes, hashed byte pairs and word-shape figures, standardised over the training
passages. Gated attention, softmax(w (tanh(V h) * sigmoid(U h))), weighs passages; the
weighted mean of the encodings, with the weighted squares, is scored by a logistic layer. All
weights are learnt together from document labels by Adam.

The fit takes a bounded sample of labelled documents: up to SAMPLE of them (by hash of
doc_id, so the choice does not depend on order), each with up to MOST passages, spread evenly over its text. Every
document is scored over all its passages; passages stream through the attention in
blocks with a running softmax, so a very long text needs no more memory.

Null and empty texts are one passage without words. Without labels of both kinds, the score
is the share of label 1 (0.5 without any). A document whose labels disagree, or whose label is null or neither 0 nor 1, is not learnt from. Rows of one
doc_id with different texts each count with its label. At most 2 * SAMPLE rows are fitted, in the order of a hash, so that a repeated
doc_id cannot fill the driver. Repeated rows get equal scores. Columns to keep may have any name but score. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune
from .words import SPACED, words

PASSAGE, SAMPLE, MOST = 64, 4000, 104
PAIRS, HIDDEN, EPOCHS, RATE, DECAY = 64, 16, 30, 0.01, 1e-4
#: Byte classes: lower, upper, digit, white space, non-ASCII, and each ASCII mark.
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS = np.full(256, 5 + len(_marks), np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[9, 10, 11, 12, 13, 32]], CLASS[128:] = 0, 1, 2, 3, 4
CLASS[_marks] = 5 + np.arange(len(_marks))
CLASSES = 6 + len(_marks)
WIDTH = CLASSES + PAIRS + 4


def encode(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of a batch, and the first passage of each value."""
    w = words(text, SPACED)
    n_pass = np.maximum(1, -(-w.counts // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n_pass)))
    word_pass = np.repeat(first[:-1], w.counts) + (np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)) // PASSAGE
    total = int(first[-1])
    # A byte belongs to the passage of the last word that began at or before it.
    begins = np.concatenate((w.offsets[:-1], w.start))
    label = np.concatenate((first[:-1], word_pass))
    order = np.argsort(begins, kind="stable")
    begins, label = begins[order], label[order]
    owner = np.repeat(label, np.diff(np.concatenate((begins, [len(w.data)]))))
    out = np.zeros((total, WIDTH))
    kind = CLASS[w.data]
    size = np.maximum(np.bincount(owner, minlength=total), 1)[:, None]
    out[:, :CLASSES] = np.bincount(owner * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / size
    if len(w.data) > 1:
        pair = (w.data[:-1].astype(np.int64) * 31 + w.data[1:] * 17) % PAIRS
        within = np.ones(len(pair), bool)
        within[w.offsets[1:-1] - 1] = False  # the line feed that ends a text does not pair with the next one
        out[:, CLASSES : CLASSES + PAIRS] = np.bincount((owner[:-1] * PAIRS + pair)[within], minlength=total * PAIRS).reshape(total, PAIRS) / size
    n = np.maximum(np.bincount(word_pass, minlength=total), 1)
    long = (w.end - w.start).astype(float)
    mean = np.bincount(word_pass, long, total) / n
    out[:, -4] = mean
    out[:, -3] = np.sqrt(np.maximum(np.bincount(word_pass, long**2, total) / n - mean**2, 0))
    out[:, -2] = np.bincount(word_pass, long <= 2, total) / n
    out[:, -1] = np.log1p(np.bincount(word_pass, minlength=total))
    return out, first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated-attention pooling over standardised encodings h; weights in one dictionary."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.prior, self.trained = mean, scale, prior, False
        self.p = {"V": rng.normal(0, 0.1, (HIDDEN, WIDTH)), "U": rng.normal(0, 0.1, (HIDDEN, WIDTH)), "w": rng.normal(0, 0.1, HIDDEN), "c": np.zeros(2 * WIDTH), "b": np.zeros(1)}

    def inputs(self, encoded: np.ndarray) -> np.ndarray:
        return np.clip((encoded - self.mean) / self.scale, -6, 6)

    def _attend(self, h):
        t, s = np.tanh(h @ self.p["V"].T), _sigmoid(h @ self.p["U"].T)
        return t, s, (t * s) @ self.p["w"]

    def scores(self, encoded: np.ndarray, first: np.ndarray, block: int = 4096) -> np.ndarray:
        """Scores of all bags; passages are taken in blocks, with a running maximum for the softmax."""
        n = len(first) - 1
        if not self.trained:
            return np.full(n, self.prior)
        top, mass, pooled = np.full(n, -np.inf), np.zeros(n), np.zeros((n, 2 * WIDTH))
        bag = np.repeat(np.arange(n), np.diff(first))
        for at in range(0, len(encoded), block):
            h, own = self.inputs(encoded[at : at + block]), bag[at : at + block]
            _, _, a = self._attend(h)
            new = top.copy()
            np.maximum.at(new, own, a)
            touched = np.unique(own)
            shrink = np.exp(top[touched] - new[touched])
            mass[touched] *= shrink
            pooled[touched] *= shrink[:, None]
            e = np.exp(a - new[own])
            z = np.concatenate((h, h * h / 6), axis=1) * e[:, None]
            starts = np.searchsorted(own, touched)
            mass[touched] += np.add.reduceat(e, starts)
            pooled[touched] += np.add.reduceat(z, starts, axis=0)
            top = new
        return _sigmoid(pooled / mass[:, None] @ self.p["c"] + self.p["b"][0])

    def loss(self, h: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of bags of inputs h (bag i from first[i]), with decay on the last layer, and its gradient."""
        p, n = self.p, len(labels)
        own = np.repeat(np.arange(n), np.diff(first))
        t, s, a = self._attend(h)
        e = np.exp(a - np.maximum.reduceat(a, first[:-1])[own])
        att = e / np.add.reduceat(e, first[:-1])[own]
        q = np.concatenate((h, h * h / 6), axis=1)
        z = np.add.reduceat(q * att[:, None], first[:-1], axis=0)
        logit = z @ p["c"] + p["b"][0]
        d = (_sigmoid(logit) - labels) * weight / n
        dz = d[:, None] * p["c"]
        datt = (q * dz[own]).sum(axis=1)
        da = att * (datt - np.add.reduceat(att * datt, first[:-1])[own])
        grad = {"c": z.T @ d + DECAY * p["c"], "b": np.array([d.sum()]), "w": (t * s).T @ da, "V": (da[:, None] * p["w"] * s * (1 - t * t)).T @ h, "U": (da[:, None] * p["w"] * t * s * (1 - s)).T @ h}
        value = ((np.logaddexp(0, logit) - labels * logit) * weight).sum() / n + DECAY / 2 * (p["c"] ** 2).sum()
        return float(value), grad

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> None:
        """Adam over single bags in batches of 32, classes weighted to count alike."""
        rng, p = np.random.default_rng(seed), self.p
        bags = [self.inputs(b) for b in bags]
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 32)):
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in part])))
                _, grad = self.loss(np.concatenate([bags[i] for i in part]), first, labels[part], weight[part])
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.trained = True


def _encoded(batches):
    for batch in batches:
        h, first = encode(batch.column(0))
        parts = [h[a + np.arange(min(b - a, MOST)) * (b - a) // min(b - a, MOST)].astype(np.float32).tobytes() for a, b in zip(first, first[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), *batch.columns[1:]], ["bag", "label", "place"])


def _score(held):
    def run(batches):
        for batch in batches:
            score = held.value.scores(*encode(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel:
    """Fit on labels (doc_id, label 0 or 1), of which at most about `sample` documents are taken."""
    known = labels.where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("label").alias("other")).where("label = other").drop("other")
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about `sample` rows, whatever the input: fit to be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("place"))
    rows = texts.mapInArrow(_encoded, "bag binary, label int, place long").orderBy("place", "bag").select("bag", "label").limit(2 * sample).toPandas()
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for x in rows["bag"]]
    y = rows["label"].to_numpy(float)
    stacked = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    model = AttentionModel(stacked.mean(axis=0), stacked.std(axis=0) + 1e-3, float(y.mean()) if len(y) else 0.5)
    if len(y) and 0 < y.mean() < 1:
        model.fit(bags, y)
    return model


def score(docs: DataFrame, model: AttentionModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep and score, 0 to 1, of each document."""
    tune(docs.sparkSession)
    src = docs.select(*keep, "text")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return src.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)
