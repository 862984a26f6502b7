"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` words). Every passage of every text is encoded as
a vector: shares of byte classes and of single ASCII bytes, word-length and repetition figures. A
hidden layer h = tanh(W x) and gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))) are learned
from document labels alone; the document's vector is the attention-weighted sum of its passages' h, and
a logistic unit scores it.

Fitting uses at most ``per_class`` labelled training documents of each class (in the order of a hash of
their id), of each at most ``passages`` passages, evenly spaced, and runs on the driver over those
vectors; scoring reads every whole text.

Defined results: null and empty texts are one passage of zeros and get that passage's score. Rows that
repeat an id each get a row; other columns are not read. Without labels of both classes the score is
the share of label 1 among those there are (1 without any), so that nothing is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import TextBlock, column, fold, labelled_sample, map_texts

PASSAGE = 64
_CLASS = np.zeros(256, dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b >= 0x80 else 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit() else _b - 28 if 32 <= _b < 48 else _b - 38 if 58 <= _b < 65 else _b - 64 if 91 <= _b < 97 else _b - 90 if 123 <= _b < 127 else 37
N_CLASS = 38
DENSE = 8
WIDTH = N_CLASS + DENSE


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages, WIDTH) vectors and the passage count of each text (at least 1)."""
    block = TextBlock(texts)
    per = np.maximum(1, -(-block.n_words // PASSAGE))
    first = np.concatenate(([0], np.cumsum(per)))
    total = int(first[-1])
    x = np.zeros((total, WIDTH), dtype=np.float32)
    if not len(block.word_start):
        return x, per
    order = np.arange(len(block.word_start)) - block.first_word[block.word_doc]
    passage = first[block.word_doc] + order // PASSAGE
    n = np.bincount(passage, minlength=total).astype(np.float32)
    size = (block.word_end - block.word_start).astype(np.float64)
    seen = np.flatnonzero(~block.ws)
    owner = np.repeat(passage, block.word_end - block.word_start)
    counts = np.bincount(owner * N_CLASS + _CLASS[block.buf[seen]], minlength=total * N_CLASS).reshape(total, N_CLASS)
    chars = np.maximum(counts.sum(axis=1), 1)
    x[:, :N_CLASS] = np.sqrt(counts / chars[:, None])  # square roots: rare marks still show
    some = np.maximum(n, 1)
    h = block.hashes(block.word_start, block.word_end)
    h ^= passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # distinct words of a passage: by sorted (passage, word) hashes, counted back to passages
    idx = np.argsort(h)
    s = h[idx]
    fresh = np.concatenate(([True], s[1:] != s[:-1]))
    distinct = np.bincount(passage[idx[fresh]], minlength=total)
    same = lambda k: np.bincount(passage[k:][h[k:] == h[:-k]], minlength=total)
    last = block.buf[block.word_end - 1]
    lone = (block.word_end - block.word_start == 1) & (_CLASS[last] > 3)
    d = N_CLASS
    x[:, d] = n / PASSAGE
    x[:, d + 1] = 1 - distinct / some
    x[:, d + 2] = same(1) / some
    x[:, d + 3] = same(2) / some
    x[:, d + 4] = np.bincount(passage, weights=size, minlength=total) / some / 10
    x[:, d + 5] = np.bincount(passage, weights=_CLASS[last] > 3, minlength=total) / some
    x[:, d + 6] = np.bincount(passage, weights=lone, minlength=total) / some
    x[:, d + 7] = np.bincount(passage, weights=(_CLASS[block.buf[block.word_start]] == 2), minlength=total) / some
    return x, per


@dataclass
class GatedAttention:
    """Parameters p: W (hidden, WIDTH), b, V, U (gate, hidden), w (gate), c (hidden), d."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float = 0.5

    def forward(self, x: np.ndarray, per: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        start = np.concatenate(([0], np.cumsum(per)[:-1]))
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"].T + p["b"])
        v, u = np.tanh(h @ p["V"].T), 1 / (1 + np.exp(-(h @ p["U"].T)))
        e = (v * u) @ p["w"]
        top = np.maximum.reduceat(e, start)
        a = np.exp(e - np.repeat(top, per))
        a /= np.repeat(np.add.reduceat(a, start), per)
        z = np.add.reduceat(h * a[:, None], start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": y, "start": start}

    def scores(self, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each document and attention of each passage."""
        if not self.p:
            return np.full(len(per), self.prior), np.repeat(1 / per, per)
        f = self.forward(x, per)
        return f["y"].astype(np.float64), f["a"]

    def gradients(self, f: dict, per: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, rep = self.p, lambda t: np.repeat(t, per, axis=0)
        dy = ((f["y"] - label) * weight / weight.sum())[:, None]
        dz = dy * p["c"]
        zi = rep(dz)
        de = f["a"] * ((zi * f["h"]).sum(axis=1) - rep((dz * f["z"]).sum(axis=1)))
        dg = de[:, None] * p["w"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = zi * f["a"][:, None] + dv @ p["V"] + du @ p["U"]
        dx = dh * (1 - f["h"] ** 2)
        return {"W": dx.T @ f["x"], "b": dx.sum(axis=0), "V": dv.T @ f["h"], "U": du.T @ f["h"], "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dy[:, 0], "d": dy.sum()}


def fit(x: np.ndarray, per: np.ndarray, label: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 60, batch: int = 256, decay: float = 1e-3) -> GatedAttention:
    """Adam over mini-batches of documents; the order is a fixed shuffle, so a fit repeats."""
    rng = np.random.default_rng(1)
    model = GatedAttention(x.mean(axis=0), x.std(axis=0) + 0.02, {})
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
    model.p = {"W": init(hidden, x.shape[1]), "b": np.zeros(hidden, np.float32), "V": init(gate, hidden), "U": init(gate, hidden), "w": init(gate), "c": init(hidden), "d": np.float32(0)}
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    first = np.concatenate(([0], np.cumsum(per)))
    step = 0
    for _ in range(rounds):
        deal = rng.permutation(len(per))
        for k in range(0, len(per), batch):
            docs = deal[k : k + batch]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
            f = model.forward(x[rows], per[docs])
            g = model.gradients(f, per[docs], label[docs], weight[docs])
            step += 1
            for q, v in g.items():
                v = v + decay * model.p[q]
                m[q] = 0.9 * m[q] + 0.1 * v
                s[q] = 0.999 * s[q] + 0.001 * v * v
                model.p[q] = (model.p[q] - 0.01 * (m[q] / (1 - 0.9**step)) / (np.sqrt(s[q] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 1500, passages: int = 256) -> GatedAttention:
    """``train``: the condition on doc_id that a labelled row of the training folds meets."""
    sample = labelled_sample(docs, labels, "quality", train, per_class)

    def vectors(part, texts):
        x, per = encode_passages(texts)
        ends = np.cumsum(per)
        spaced = lambda n: np.arange(n) if n <= passages else np.arange(passages) * n // passages
        data = [x[e - n + spaced(n)].astype("<f2").tobytes() for e, n in zip(ends.tolist(), per.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), column(part, "label"), pa.array(data, pa.binary())], ["doc_id", "label", "x"])

    got = map_texts(sample, vectors, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    totals = {r.quality: r["count"] for r in labels.filter(train & F.col("quality").isin(0, 1)).groupBy("quality").count().collect()}
    label = got["label"].to_numpy(dtype=np.float32)
    if not len(got) or label.min() == label.max():
        prior = totals.get(1, 0) / sum(totals.values()) if totals else 1.0
        return GatedAttention(np.zeros(WIDTH), np.ones(WIDTH), {}, prior)
    xs = [np.frombuffer(b, dtype="<f2").reshape(-1, WIDTH).astype(np.float32) for b in got["x"]]
    per = np.array([len(v) for v in xs])
    taken = {v: max(1, int((label == v).sum())) for v in (0, 1)}
    weight = np.where(label == 1, totals.get(1, 1) / taken[1], totals.get(0, 1) / taken[0])  # the classes' shares in all labels
    return fit(np.concatenate(xs), per, label, weight)


def score(docs: DataFrame, model: GatedAttention, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score, n_passages and top_passage (of most attention)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(part, texts):
        x, per = encode_passages(texts)
        y, a = sent.value.scores(x, per)
        first = np.cumsum(per) - per
        top = [int(a[s : s + n].argmax()) for s, n in zip(first.tolist(), per.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*[column(part, c) for c in keep], pa.array(y), pa.array(per, pa.int64()), pa.array(top, pa.int64())], [*keep, "score", "n_passages", "top_passage"])

    return map_texts(docs.select(*dict.fromkeys((*keep, "text"))), run, f"{fields}, score double, n_passages long, top_passage long")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return fold(doc_id, 5) == 0


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the labelled rows of the training folds, then score every row of ``docs``."""
    return score(docs, learn(docs, labels, ~held_out()), keep)
