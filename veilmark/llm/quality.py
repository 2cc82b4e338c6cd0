"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words. Each passage becomes a vector: shares of byte classes,
word lengths, repeated and neighbouring equal words, and a signed hash of its words. A small layer encodes it, gated
attention (tanh times sigmoid) weighs the passages, and a logistic unit scores the weighted sum. All weights are
learned together from document labels by Adam on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chosen, map_slices
from .words import U, words

PASSAGE = 128
HASHED = 16


def _classes() -> np.ndarray:
    """0 a-z, 1 A-Z, 2 digit, 3 space, 4 line feed, 5 full stop or comma, 6 other ASCII, 7 UTF-8 lead byte, 8 UTF-8 rest."""
    kind = np.full(256, 6, dtype=np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[9, 11, 12, 13, 32]], kind[10] = 3, 4
    kind[[44, 46]] = 5
    kind[192:], kind[128:192] = 7, 8
    return kind


_KIND = _classes()
KINDS = 9
WIDTH = KINDS + 7 + HASHED


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of WIDTH numbers for each passage of the texts, and the first passage of each text with the total at the end.

    A text without words has one passage of zeros.
    """
    hashes, at, data, first, last = words(column)
    count = np.maximum(1, -(-np.diff(at) // PASSAGE))
    of = np.concatenate([[0], np.cumsum(count)])
    total = int(of[-1])
    x = np.zeros((total, WIDTH), dtype=np.float64)
    if not len(hashes):
        return x, of
    text = np.repeat(np.arange(len(count)), np.diff(at))
    passage = of[text] + (np.arange(len(hashes)) - at[text]) // PASSAGE
    n = np.bincount(passage, minlength=total).astype(np.float64)
    some = np.maximum(n, 1)
    # a byte belongs to the passage of the last word that has begun
    owner = np.repeat(passage, np.diff(np.append(first, len(data))))
    kinds = np.bincount(owner * KINDS + _KIND[data[first[0] :]], minlength=total * KINDS).reshape(total, KINDS)
    size = np.maximum(kinds.sum(axis=1), 1)[:, None]
    x[:, :KINDS] = np.sqrt(kinds / size)
    length = (last - first).astype(np.float64)
    mean = np.bincount(passage, weights=length, minlength=total) / some
    x[:, KINDS] = mean / 10
    x[:, KINDS + 1] = np.sqrt(np.maximum(0, np.bincount(passage, weights=length * length, minlength=total) / some - mean * mean)) / 10
    order = np.lexsort((hashes, passage))
    again = (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    x[:, KINDS + 2] = np.bincount(passage[order][1:][again], minlength=total) / some
    near = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    x[:, KINDS + 3] = np.bincount(passage[1:][near], minlength=total) / some
    tail = _KIND[data[last - 1]]
    x[:, KINDS + 4] = np.bincount(passage[tail == 6], minlength=total) / some
    x[:, KINDS + 5] = np.bincount(passage[tail == 1], minlength=total) / some
    x[:, KINDS + 6] = np.log1p(n) / 5
    bag = (hashes >> U(32)) % U(HASHED)
    sign = np.where(hashes & U(1), 1.0, -1.0)
    x[:, KINDS + 7 :] = np.bincount(passage * HASHED + bag.astype(np.int64), weights=sign, minlength=total * HASHED).reshape(total, HASHED) / some[:, None]
    return x, of


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
    h = np.maximum(0, x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (v * u) @ p["w"]
    bag = np.repeat(np.arange(len(of) - 1), np.diff(of))
    a = np.exp(e - np.maximum.reduceat(e, of[:-1])[bag])
    a /= np.add.reduceat(a, of[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, of[:-1], axis=0)
    return {"h": h, "v": v, "u": u, "a": a, "bag": bag, "z": z, "y": _sigmoid(z @ p["c"] + p["d"][0])}


def _gradient(p: dict[str, np.ndarray], x: np.ndarray, of: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(p, x, of)
    dy = weight * (f["y"] - target) / max(1e-12, weight.sum())
    dz = dy[:, None] * p["c"][None, :]
    up = dz[f["bag"]]
    da = (up * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, of[:-1])[f["bag"]])
    dvu = de[:, None] * p["w"][None, :]
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    dh = (f["a"][:, None] * up + dv @ p["V"].T + du @ p["U"].T) * (f["h"] > 0)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": ((f["v"] * f["u"]).T @ de), "c": f["z"].T @ dy, "d": np.array([dy.sum()])}


def train(bags: list[np.ndarray], target: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on mini-batches of whole bags; the same rows give the same model."""
    everything = np.concatenate(bags)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    r = np.random.default_rng(seed)
    p = {"W": r.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": r.normal(0, gate**-0.5, gate), "c": r.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            of = np.concatenate([[0], np.cumsum([len(bags[j]) for j in part])])
            x = np.clip((np.concatenate([bags[j] for j in part]) - mean) / scale, -8, 8)
            t += 1
            for k, g in _gradient(p, x, of, target[part], weight[part]).items():
                g = g + decay * p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - rate * 0.5 ** (epoch / 15) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p)


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[str], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000, seed: int = 7) -> Model | None:
    """Learns from labelled rows whose id column satisfies `learn`: at most about `sample`, half of each label where there are enough,
    weighted back to the labels' shares. Rows whose label isn't 0 or 1 are left out; None if no label is left.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    own = own.where(learn("id"))
    total = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    picked = chosen(own, F.col("id"), "label", sample, seed)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")  # about `sample` rows

    def work(part: pa.RecordBatch) -> dict:
        x, of = passages(part.column(1))
        return {"id": part.column(0).cast(pa.string()), "label": part.column(2), "bag": pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(of[:-1], of[1:], strict=True)])}

    got = sorted(map(tuple, map_slices(known, "text", "id string, label int, bag binary", work).collect()), key=lambda r: (r[0], bytes(r[2])))
    if not got:
        return None
    bags = [np.frombuffer(r[2], "<f4").reshape(-1, WIDTH).astype(np.float64) for r in got]
    target = np.array([r[1] for r in got], dtype=np.float64)
    share = {k: total.get(k, 0) / max(1, int((target == k).sum())) for k in (0, 1)}
    weight = np.array([share[int(y)] for y in target])
    return train(bags, target, weight / weight.mean())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id and `score`, how likely label 1 is.

    A null or empty text is scored as one passage without words. Repeated rows each get their row, an empty table gives
    none, further columns are not read, and without a model every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def work(part: pa.RecordBatch) -> dict:
        m = shared.value
        x, of = passages(part.column(1))
        y = _forward(m.parts, np.clip((x - m.mean) / m.scale, -8, 8), of)["y"] if m else np.full(part.num_rows, 0.5)
        return {"id": part.column(0), "score": pa.array(y)}

    kind = docs.schema[id_col].dataType.simpleString()
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(inner, "text", f"id {kind}, score double", work).withColumnRenamed("id", id_col)
