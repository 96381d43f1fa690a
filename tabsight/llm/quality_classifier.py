"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Texts are counted over hashed words and hashed word outlines (letters as ``a``
or ``A``, digits as ``0``, other characters themselves, runs taken once). A
truncated singular value decomposition of the weighted counts of a bounded
sample of labelled texts gives the latent space; the labelled vectors themselves
are the classifier. They are of fixed size (``LABELLED`` x ``LATENT`` numbers)
and go to every task, where the cosine of every document with every labelled
vector is computed in blocks. The ``NEIGHBOURS`` nearest vote with weight
``similarity ** POWER``.

Null, empty and wordless texts have the zero vector and score the labelled
share of 1. Without labelled rows every score is 0.5. Ties between neighbours
go to the smaller doc_id; repeated rows score alike. An empty table gives no
rows. Labels, language, source and doc_id never enter a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import LOWER, span_hashes, text_chunks, word_spans

#: Labelled rows fitted on (a bounded sample), hashed features, latent numbers,
#: voting neighbours, weight of similarity, share of features for outlines.
LABELLED, FEATURES, LATENT, NEIGHBOURS, POWER, OUTLINES = 2048, 4096, 48, 15, 8, 1024

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_LOWER = np.frombuffer(LOWER, np.uint8)


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and outline."""
    starts, ends, text = word_spans(data, offsets)
    words = span_hashes(_LOWER[data], starts, ends) % np.uint64(FEATURES - OUTLINES)
    outline = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = outline[1:] != outline[:-1]
    first[starts] = True
    place = np.concatenate([[0], np.cumsum(first)])
    outlines = span_hashes(outline[first], place[starts], place[ends]) % np.uint64(OUTLINES) + np.uint64(FEATURES - OUTLINES)
    return np.concatenate([text, text]), np.concatenate([words, outlines]).astype(np.int64)


def matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped counts per text, each half (words, outlines) of unit length."""
    n = len(offsets) - 1
    text, feature = counts(data, offsets)
    x = np.bincount(text * FEATURES + feature, minlength=n * FEATURES).reshape(n, FEATURES)
    x = np.log1p(x).astype(np.float32)
    for a, b in ((0, FEATURES - OUTLINES), (FEATURES - OUTLINES, FEATURES)):
        x[:, a:b] /= np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


class Model:
    def __init__(self, texts: list[str | None], labels: list[int]):
        self.labels = np.array(labels, np.float64)
        data = [(t or "").encode() for t in texts]
        rows = [matrix(np.frombuffer(b, np.uint8), np.array([0, len(b)])) for b in data]
        x = np.concatenate([*rows, np.zeros((0, FEATURES), np.float32)])
        self.weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        x = x * self.weight
        values, vectors = np.linalg.eigh((x @ x.T).astype(np.float64))
        keep = np.argsort(values)[::-1][:LATENT]
        keep = keep[values[keep] > 1e-6]
        self.basis = (x.T @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32)
        self.vectors = self.latent(x)

    def latent(self, weighted: np.ndarray) -> np.ndarray:
        z = weighted @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        sims = np.round((self.latent(x * self.weight) @ self.vectors.T).astype(np.float64), 5)
        k = min(NEIGHBOURS, len(self.labels))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k] if k < 2 else _nearest(sims, k)
        w = np.maximum(np.take_along_axis(sims, order, 1), 0) ** POWER
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[order]).sum(1) / np.maximum(total, 1e-300), self.labels.mean())


def _nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row; the first column wins a tie."""
    n = sims.shape[1]
    key = np.round(sims * 1e5).astype(np.int64) * n + (n - 1 - np.arange(n))
    return np.argpartition(-key, k - 1, axis=1)[:, :k]


def fit(docs: DataFrame, labels: DataFrame, train: Column, labelled: int = LABELLED) -> Model:
    """Model from at most ``labelled`` labelled rows, chosen by a hash of the id."""
    rows = labels.where(train & F.col("quality").isNotNull()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy("doc_id").collect()
    return Model([r["text"] for r in got], [r["quality"] for r in got])


def score(docs: DataFrame, labels: DataFrame, held_out: Column, cut: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels are
    learned only from rows where ``held_out`` (over doc_id) is false."""
    model = fit(docs, labels, ~held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch, "text", 1 << 19):
                out = [model.score(matrix(data[offsets[a] : offsets[min(a + 256, j - i)]], offsets[a : min(a + 256, j - i) + 1] - offsets[a])) for a in range(0, j - i, 256)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.concatenate(out))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
