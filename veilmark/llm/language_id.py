"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character 1-, 2- and 3-grams of the lower-cased text, where whatever is no letter reads as a space,
hashed to a fixed number of columns, weighted by term frequency times inverse document frequency, each row of unit
length. Document frequencies cover every learning row. The weights are learned from a bounded sample of labelled rows
by follow-the-regularised-leader with L1 and L2 penalties; a temperature fitted on sample rows that the weights have
not seen calibrates the probabilities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, chosen, in_small_batches, map_slices, slices, texts_of

UNKNOWN = "und"
COLUMNS = 1 << 15


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # COLUMNS + 1 rows, the last one the intercept
    idf: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each text its (columns, counts), and whether it has a letter."""
    low = [x.lower() for x in texts]
    # two spaces between texts keep every 3-gram within one text
    codes = np.frombuffer(("  ".join(low) + "    ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint32)
    one = codes * np.uint32(2654435761)
    two = one[:-2] * np.uint32(31) + codes[1:-1] * np.uint32(2246822519)
    three = two * np.uint32(31) + codes[2:] * np.uint32(3266489917)
    shift = np.uint32(32 - 15)
    mixed = [((x ^ (x >> np.uint32(15))) * np.uint32(2654435769)) >> shift for x in (one[:-2] + np.uint32(7), two + np.uint32(11), three + np.uint32(13))]
    use = [letter[:-2], letter[:-2] | letter[1:-1], letter[:-2] | letter[1:-1] | letter[2:]]
    out, some, at = [], np.zeros(len(texts), dtype=bool), 0
    for i, x in enumerate(low):
        span = slice(at, at + len(x))
        some[i] = bool(use[0][span].any())
        if some[i]:
            counts = sum(np.bincount(m[span][u[span]], minlength=COLUMNS) for m, u in zip(mixed, use, strict=True))
            nz = np.flatnonzero(counts)
            out.append((nz, counts[nz]))
        else:
            out.append((np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
        at += len(x) + 2
    return out, some


def rows(found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF rows of unit length, each with the intercept's column."""
    out = []
    for columns, counts in found:
        x = (1 + np.log(np.maximum(counts, 1))) * idf[columns]
        norm = float(np.sqrt(x @ x)) or 1.0
        out.append((np.append(columns, COLUMNS), np.append(x / norm, 1.0)))
    return out


class Sample(Sequence):
    """TF-IDF rows of packed columns and counts, made when asked for: the driver holds the packed bytes only."""

    def __init__(self, columns: pa.ChunkedArray, counts: pa.ChunkedArray, idf: np.ndarray, which: np.ndarray | None = None):
        self.columns, self.counts, self.idf = columns, counts, idf
        self.which = np.arange(len(columns)) if which is None else which

    def __len__(self) -> int:
        return len(self.which)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = int(self.which[i])
        columns, counts = (np.frombuffer(x[at].as_buffer(), "<i4") for x in (self.columns, self.counts))
        return rows([(columns.astype(np.int64), counts)], self.idf)[0]

    def take(self, which: np.ndarray) -> Sample:
        return Sample(self.columns, self.counts, self.idf, self.which[which])


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How many texts have each column, over all rows; each task sends at most one row a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COLUMNS + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, some = grams(texts_of(part.column(0)))
                total[COLUMNS] += int(some.sum())
                if some.any():
                    total[:COLUMNS] += np.bincount(np.concatenate([c for c, _ in found]), minlength=COLUMNS)
        nz = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(nz), pa.array(total[nz])], names=["column", "n"])

    sums = in_small_batches(df.select(F.col(text).cast("string").alias("text")), run, "column bigint, n bigint").groupBy("column").agg(F.sum("n").alias("n"))
    out = np.zeros(COLUMNS + 1, dtype=np.int64)
    got = sums.toArrow()  # COLUMNS + 1 rows at most
    out[got.column("column").to_numpy()] = got.column("n").to_numpy()
    return out[:COLUMNS], int(out[COLUMNS])


def follow_the_leader(data: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, kinds: int, rounds: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 11) -> np.ndarray:
    """FTRL-proximal for the multinomial loss: per-coordinate rates, soft threshold l1, ridge l2; no penalty on the intercept."""
    z = np.zeros((COLUMNS + 1, kinds))
    n = np.zeros((COLUMNS + 1, kinds))

    def at(columns: np.ndarray) -> np.ndarray:
        part, root = z[columns], np.sqrt(n[columns])
        edge = np.where(columns == COLUMNS, 0.0, l1)[:, None]
        ridge = np.where(columns == COLUMNS, 0.0, l2)[:, None]
        return np.where(np.abs(part) <= edge, 0.0, -(part - np.sign(part) * edge) / ((beta + root) / alpha + ridge))

    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(data)):
            columns, x = data[i]
            w = at(columns)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            old = n[columns]
            new = old + g * g
            z[columns] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[columns] = new
    return at(np.arange(COLUMNS + 1))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the weights have not seen."""
    if not len(labels):
        return 1.0
    best, least = 1.0, np.inf
    for t in np.exp(np.linspace(np.log(0.2), np.log(5.0), 60)):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))
        if loss < least:
            best, least = float(t), loss
    return best


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000, seed: int = 11) -> Model:
    """Learns from the rows where `learn` holds. Document frequencies cover all of them, the weights at most about
    `sample` labelled rows, spread evenly over the languages. Without labelled rows the model knows no language."""
    known = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df, n = document_frequencies(known, "text")
    idf = np.log((1 + n) / (1 + df)) + 1

    def work(part: pa.RecordBatch) -> dict:
        found, some = grams(texts_of(part.column(1)))
        packed = [(c.astype("<i4").tobytes(), k.astype("<i4").tobytes()) for c, k in found]
        key = [int.from_bytes(hashlib.blake2b(c + k, digest_size=8).digest(), "little", signed=True) for c, k in packed]
        return {"fold": part.column(0), "lang": part.column(2), "key": pa.array(key, pa.int64()), "columns": pa.array([c for c, _ in packed], pa.binary()), "counts": pa.array([k for _, k in packed], pa.binary()), "some": pa.array(some)}

    picked = chosen(known.where(F.col("text").isNotNull()), F.col("id"), "lang", sample, seed).select(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(6)).alias("fold"), "text", "lang")
    got = map_slices(picked, "text", "fold bigint, lang string, key bigint, columns binary, counts binary, some boolean", work).where("some").toArrow()
    got = got.sort_by([("lang", "ascending"), ("key", "ascending")])
    languages = sorted(set(got["lang"].to_pylist()))
    data = Sample(got["columns"], got["counts"], idf)
    labels = np.array([languages.index(x) for x in got["lang"].to_pylist()], dtype=np.int64)
    seen = got["fold"].to_numpy() != 0
    if not languages:
        return Model([], np.zeros((COLUMNS + 1, 0)), idf, 1.0)
    weights = follow_the_leader(data.take(np.flatnonzero(seen)), labels[seen], len(languages))
    rest = [x @ weights[c] for c, x in data.take(np.flatnonzero(~seen))]
    heat = temperature(np.array(rest).reshape(len(rest), len(languages)), labels[~seen])
    del got, data
    pa.default_memory_pool().release_unused()  # the sample's bytes go back to the system
    return Model(languages, weights, idf, heat)


def predict_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `lang_score`, the calibrated probability of that language.

    A null text, one without a letter, and any text under a model without languages is `und` with score 1. Repeated
    rows stay repeated, an empty table stays empty, equal probabilities go to the first language by name, and columns of
    the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # COLUMNS by the number of languages

    def work(column: pa.Array) -> dict:
        m = shared.value
        found, some = grams(texts_of(column))
        names, scores = [UNKNOWN] * len(found), np.ones(len(found))
        if m.languages:
            for i, (columns, x) in enumerate(rows(found, m.idf)):
                if some[i]:
                    s = (x @ m.weights[columns]) / m.temperature
                    p = np.exp(s - s.max())
                    p /= p.sum()
                    k = int(p.argmax())
                    names[i], scores[i] = m.languages[k], min(1.0, float(p[k]))
        return {"lang_pred": pa.array(names, pa.string()), "lang_score": pa.array(scores)}

    return add_columns(docs, text_col, "lang_pred string, lang_score double", work)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, `lang_pred` and `score`, as in predict_rows; further columns are not read."""
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return predict_rows(inner, model).select(F.col("id").alias(id_col), "lang_pred", F.col("lang_score").alias("score"))
