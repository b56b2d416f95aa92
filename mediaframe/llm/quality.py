"""A quality classifier learned from preference pairs (Bradley-Terry).

Each document has a latent score, linear in features of its bytes; a pair of a document labelled 1 and one labelled 0 is a
preference, and the weights minimise the logistic loss on the pairs' feature differences. A quantile of the training
scores then serves as threshold: the one that best separates the labels. Scores are reported as logistic values in
which that quantile stands at 0.3.

Only features are inputs: never labels, lang, source or doc_id. At most `max_train` labelled rows (those first in a hashed
order of ids) are used to fit; all rows are scored. Without rows of both labels every document gets the score 0.5.

Nulls: a null text counts as empty; null labels are not used; a null doc_id is scored and never used to fit. Of several
labels of an id the least counts, of several texts of an id the one of least hash is used to fit. Repeated rows are scored
each. Extra columns pass through (names that begin with `_qc_` are reserved). A text longer than a run is a run of its own,
so memory grows with the longest text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm import _text as T

_SIGNS = b"|%&$*#!?.,;:-_/\\()[]{}<>=+@'\""
N_FEATURES = 21 + len(_SIGNS)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each text; offsets as of text_buffer()."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    each = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n) / each

    starts, ends, before = T.word_bounds(data, offsets)
    words = np.diff(before)
    per = np.maximum(words, 1)
    wdoc = np.repeat(np.arange(n), words)
    count = lambda mask: np.bincount(wdoc[mask], minlength=n) / per
    h, _ = T.word_hashes(data, offsets)
    length = ends - starts
    letter = (data | 32 >= 97) & (data | 32 <= 122) | (data >= 128)
    upper = (data >= 65) & (data <= 90)
    cum = np.concatenate(([0], np.cumsum(letter)))
    letters = cum[ends] - cum[starts]
    cum = np.concatenate(([0], np.cumsum(upper)))
    uppers = cum[ends] - cum[starts]
    key = np.lexsort((h, wdoc))
    sh, sd = h[key], wdoc[key]
    new = np.ones(len(h), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    group = np.flatnonzero(new)
    times = np.diff(np.append(group, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, sd[group], times)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    cols = [
        np.log1p(size), np.log1p(words), np.minimum(np.bincount(wdoc, length, minlength=n) / per, 40), share(upper), share((data >= 48) & (data <= 57)),
        share(data >= 128), share(data == 10), share(data < 9), np.bincount(sd[group], minlength=n) / per, count(same), top / per, count(letters == 0),
        count(letters * 2 < length), count(letters < length - 1), count((uppers == letters) & (letters > 1)), count(uppers > 0), count(length == 1), count(length > 15),
        count(letters == length), np.bincount(sd[group], times.astype(float) ** 2, minlength=n) / per**2, (words == 0).astype(float),
    ]
    signs = np.full(256, -1)
    signs[list(_SIGNS)] = np.arange(len(_SIGNS))
    kind = signs[data]
    has = kind >= 0
    table = np.bincount(doc[has] * len(_SIGNS) + kind[has], minlength=n * len(_SIGNS)).reshape(n, -1) / each[:, None]
    out[:, : len(cols)] = np.stack(cols, 1)
    out[:, len(cols) :] = table
    out[:, 3:] = np.sqrt(out[:, 3:])
    return out


def _featured(column: pa.Array) -> np.ndarray:
    data, offsets = T.text_buffer(column)
    parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in T.runs(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


class PairModel:
    """Weights of the standardised features, their threshold, and score()."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n_pairs: int = 40_000, ridge: float = 1e-2, seed: int = 9) -> None:
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        self.w, self.at = np.zeros(N_FEATURES), None
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        z = self._z(x)
        r = np.random.default_rng(seed)
        diff = z[r.choice(good, n_pairs)] - z[r.choice(bad, n_pairs)]
        for _ in range(25):  # Newton steps on the mean logistic loss
            p = 1 / (1 + np.exp(np.clip(diff @ self.w, -30, 30)))
            grad = ridge * self.w - diff.T @ p / n_pairs
            hess = (diff.T * (p * (1 - p))) @ diff / n_pairs + ridge * np.eye(N_FEATURES)
            step = np.linalg.solve(hess, grad)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        raw = z @ self.w
        order = np.argsort(raw, kind="stable")
        low = y[order]
        gain = np.cumsum(low == 0) / len(bad) - np.cumsum(low == 1) / len(good)
        k = int(np.argmax(gain))
        self.quantile = (k + 1) / len(raw)
        self.at = float((raw[order[k]] + raw[order[min(k + 1, len(raw) - 1)]]) / 2)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.at is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.w - self.at + np.log(0.3 / 0.7), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> PairModel:
    """labels: doc_id and quality; rows whose crc32(doc_id as text) mod 5 is 0 are held out."""
    used = labels.where("quality in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select(F.col("doc_id").alias("_id"), "quality")
    used = used.groupBy("_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _featured(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1).cast(pa.int32()), *b.columns[2:]], ("x", "y", "id", "h"))

    rows = docs.select("doc_id", "text").join(F.broadcast(used), F.col("doc_id") == F.col("_id"))  # max_train rows of two numbers
    rows = rows.select("text", "quality", F.col("_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    got = rows.mapInArrow(run, "x array<double>, y int, id long, h long").groupBy("id").agg(F.min_by(F.struct("x", "y"), "h").alias("r")).select("r.x", "r.y", "id").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)[order] if len(got) else np.zeros((0, N_FEATURES))
    return PairModel(x, got["y"].to_numpy()[order])


def scored(docs: DataFrame, model: PairModel) -> DataFrame:
    """docs with a column _qc_score, 0 to 1, higher for documents likelier to be labelled 1; other columns pass through."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(_featured(b.column(at))))], [*b.schema.names, "_qc_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_qc_score", DoubleType())]))
