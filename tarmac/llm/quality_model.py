"""Quality classifier: random-indexing word vectors under a small neural network.

Every word has a sparse ternary index vector, fixed by its hash. Its word vector is the sum of
the index vectors of its neighbours over the whole corpus, so it is learned by one counting
pass without a matrix or a vocabulary: words share ``BUCKETS`` rows by hash, which bounds the
model at any corpus size, and the sums are integers, so task order does not matter. A document
is pooled from its words' vectors: their mean, their deviation, and the mean cosine of
neighbours. A two-layer network in numpy is fitted on a bounded sample
of labelled documents, and one temperature, fitted on a part it has not seen, calibrates its
probabilities.

Defined cases: null and empty texts have the zero vector and get the score of that vector.
Null ids never match a label. A document with several labels counts with the largest. Without
labels every score is 0.5 and accepts. Repeated rows keep their rows. The inputs of a score
are the text only; other columns pass through unread, and ``score`` and ``predicted`` replace
columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import map_arrow, quoted, remainder

# Letters of any script, digits, or other signs; bytes over 0x7F count as letters.
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
INPUTS = 2 * DIM + 1
# Bound of the labelled sample the network is fitted on.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.02, 1e-4
CHUNK = 200_000


def bucket_ids(text: bytes | None) -> list[int]:
    return [crc32(t) & BUCKETS - 1 for t in TOKEN.findall(text)] if text else []


def index_vectors(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries per bucket; row ``BUCKETS`` is a gap of zeros."""
    rng = np.random.default_rng(seed)
    places = rng.integers(0, DIM, (BUCKETS + 1, NONZERO))
    signs = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    signs[BUCKETS] = 0
    return places, signs


def add_contexts(ids: list[int], sums: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the index vectors of all neighbours to the rows of ``ids``."""
    line = np.array(ids, np.int64)
    for gap in range(1, WINDOW + 1):
        for here, there in ((line[:-gap], line[gap:]), (line[gap:], line[:-gap])):
            for k in range(NONZERO):
                at = here * DIM + places[there, k]
                sums += np.bincount(at, signs[there, k], len(sums))


def word_vectors(docs: DataFrame, seed: int = 0) -> np.ndarray:
    """Word vectors from all texts: ``BUCKETS + 1`` rows, the last of zeros.

    Each task sends one row per bucket it met; the sums come to the driver as at most
    ``BUCKETS`` rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        places, signs = index_vectors(seed)
        sums, line = np.zeros((BUCKETS + 1) * DIM), []
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                line += bucket_ids(text.as_py())
                line += [BUCKETS] * WINDOW
                if len(line) > CHUNK:
                    add_contexts(line, sums, places, signs)
                    line = []
        add_contexts(line, sums, places, signs)
        table = sums.reshape(-1, DIM)[:BUCKETS].astype(np.int64)
        met = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(met), *[pa.array(table[met, k]) for k in range(DIM)]]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *parts])

    parts = [f"v{k}" for k in range(DIM)]
    schema = ", ".join(f"{c} long" for c in ["bucket", *parts])
    rows = (
        map_arrow(docs.select("text"), count, schema)
        .groupBy("bucket")
        .agg(*[F.sum(p).alias(p) for p in parts])
        .toArrow()
        .to_pandas()
    )
    contexts = np.zeros((BUCKETS + 1, DIM))
    contexts[rows["bucket"].to_numpy(np.int64)] = rows[parts].to_numpy(np.float64)
    length = np.linalg.norm(contexts, axis=1, keepdims=True)
    vectors = contexts / np.maximum(length, 1)
    # A word's own index vector keeps it apart from words in the same company.
    places, signs = index_vectors(seed)
    np.add.at(vectors, (np.arange(BUCKETS + 1)[:, None], places), signs / NONZERO**0.5)
    return vectors.astype(np.float32)


def pooled(text: bytes | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of a document's word vectors, and how alike neighbours are."""
    ids = bucket_ids(text)
    if not ids:
        return np.zeros(INPUTS, np.float32)
    rows = vectors[ids]
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    alike = (unit[1:] * unit[:-1]).sum(axis=1).mean() if len(ids) > 1 else 0.0
    return np.concatenate([rows.mean(axis=0), rows.std(axis=0), [alike]])


@dataclass
class Network:
    """Two layers over standardised inputs, with a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Full-batch Adam on four fifths of the rows; the fifth calibrates the temperature."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    rest_x, rest_y = x[~held], y[~held]
    scale = rest_x.std(axis=0)
    net = Network(
        rest_x.mean(axis=0),
        np.where(scale > 1e-9, scale, 1),
        rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN),
        0.0,
    )
    inputs = (rest_x - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    slow, fast = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(inputs @ weights[0] + weights[1])
        error = (_sigmoid(hidden @ weights[2] + weights[3]) - rest_y) / len(rest_y)
        back = np.outer(error, weights[2]) * (1 - hidden**2)
        slopes = [inputs.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
        for k, g in enumerate(slopes):
            g = g + DECAY * weights[k]
            slow[k] = 0.9 * slow[k] + 0.1 * g
            fast[k] = 0.999 * fast[k] + 0.001 * g * g
            rate = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            weights[k] = weights[k] - rate * slow[k] / (np.sqrt(fast[k]) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if held.any():
        logits, truth = net.logits(x[held]), y[held]
        options = np.geomspace(0.2, 10, 200)
        losses = [_log_loss(_sigmoid(logits / t), truth) for t in options]
        net.temperature = float(options[int(np.argmin(losses))])
    return net


def _log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def labelled_sample(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, bound: int
) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of at most ``bound`` documents, those of smallest id hash.

    ``labels`` has ``doc_id, label``. Only these documents' vectors reach the driver.
    """
    place = F.xxhash64("doc_id")
    chosen = (
        labels.where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").cast("double").alias("label"))
        .orderBy(place, "doc_id")
        .limit(bound)
    )

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            pools = pa.array([pooled(t, vectors).tolist() for t in texts], pa.list_(pa.float64()))
            kept = [batch.column("doc_id"), batch.column("label")]
            yield pa.RecordBatch.from_arrays([*kept, pools], names=["doc_id", "label", "x"])

    # The sample is bounded, so it is the side to broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    schema = found.select("doc_id", "label").schema.add("x", T.ArrayType(T.DoubleType()))
    rows = map_arrow(found, pool, schema).dropDuplicates(["doc_id"]).toArrow().to_pandas()
    rows = rows.sort_values("doc_id")
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), INPUTS)
    return x, rows["label"].to_numpy(np.float64)


def scored(
    docs: DataFrame,
    vectors: np.ndarray,
    net: Network | None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; ``keep`` names the other columns to return."""
    names = [c for c in keep or docs.columns if c.lower() not in ("score", "predicted")]
    kept = docs.select(*[quoted(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            x = np.array([pooled(t, vectors) for t in texts]).reshape(len(texts), INPUTS)
            p = net.probabilities(x) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(p), pa.array(p >= 0.5).cast("int32")],
                names=[*batch.schema.names[: len(names)], "score", "predicted"],
            )

    schema = kept.schema.add("score", "double").add("predicted", "integer")
    return map_arrow(docs.select(*map(quoted, dict.fromkeys([*names, "text"]))), run, schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    bound: int = SAMPLE,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with the calibrated probability of label 1 and the decision at one half.

    ``labels`` has ``doc_id, label``: what may be learned, nothing else.
    """
    vectors = word_vectors(docs)
    x, y = labelled_sample(docs, labels, vectors, bound)
    return scored(docs, vectors, fit_network(x, y) if len(y) else None, keep)


def training_labels(labels: DataFrame) -> DataFrame:
    """Quality labels of the documents that are not held out."""
    return labels.where(remainder(F.col("doc_id"), 3) != 1).select(
        "doc_id", F.col("quality").alias("label")
    )


def quality_model_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its part of the split, the score and the decision."""
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    return classify(rows, training_labels(labels), keep=["doc_id", "held_out"])
