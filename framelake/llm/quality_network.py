"""A quality score from a byte-level convolutional network, trained and run in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned filters
slide over ``width`` bytes; the largest response of each filter in a chunk is the chunk's pooled value. A text's features are the
mean and the maximum of its chunks' pooled values, and a logistic layer turns them into one probability.

Training reads a bounded sample of labelled rows (``Training.rows``, the smallest hashes of the id first, so the choice is the same on
every cluster); scoring reads every text whole, inside the tasks that read the table.

Defined results: a null or empty text is one chunk of padding and gets that chunk's probability; a null id is held out (its
remainder is not known) and is never learned from; repeated rows get equal scores; an empty table gives an empty table;
without two classes among the labels every score is the share of label 1 (0.5 without labels). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import common

PAD = 256  #: the symbol behind a text's end
#: Byte positions that one forward step works on.
STEP_POSITIONS = 1 << 16


@dataclass(frozen=True)
class Shape:
    """Sizes of the network."""

    chunk: int = 512  #: bytes of a chunk
    overlap: int = 16  #: bytes a chunk shares with the next one, at least the filter width
    width: int = 8  #: bytes a filter covers
    vector: int = 8  #: numbers per byte
    filters: int = 48
    stride: int = 2


@dataclass(frozen=True)
class Training:
    """How the network is fitted; ``rows`` bounds the labelled texts read, ``chunks`` those of one text in a step."""

    rows: int = 3600
    chunks: int = 6
    steps: int = 450  #: batches learned from, however many rows there are
    batch: int = 48
    rate: float = 5e-3
    seed: int = 11


def chunked(data: bytes, shape: Shape) -> np.ndarray:
    """Overlapping chunks of a text as symbols; at least one, the last padded."""
    step = shape.chunk - shape.overlap
    n = max(1, -(-max(0, len(data) - shape.overlap) // step))
    symbols = np.full(n * step + shape.overlap, PAD, np.int16)
    symbols[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(symbols, shape.chunk)[::step]


class Network:
    """Weights of the network."""

    def __init__(self, shape: Shape, seed: int = 0, prior: float | None = None):
        rng = np.random.default_rng(seed)
        self.shape, self.prior = shape, prior
        fan = shape.width * shape.vector
        self.w = {
            "vectors": rng.normal(0, 1, (PAD + 1, shape.vector)).astype(np.float32),
            "filters": rng.normal(0, fan**-0.5, (fan, shape.filters)).astype(np.float32),
            "bias": np.zeros(shape.filters, np.float32),
            "out": np.zeros(2 * shape.filters, np.float32),
            "shift": np.zeros(1, np.float32),
        }

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        s = self.shape
        seen = self.w["vectors"][chunks]  # chunks, bytes, vector
        view = np.lib.stride_tricks.sliding_window_view(seen, s.width, axis=1)[:, :: s.stride]  # chunks, places, vector, width
        return np.ascontiguousarray(view.swapaxes(2, 3)).reshape(len(chunks), view.shape[1], s.width * s.vector)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Largest response per chunk and filter, at least 0."""
        windows = self._windows(chunks)
        response = windows.reshape(-1, windows.shape[2]) @ self.w["filters"]
        top = response.reshape(len(chunks), -1, self.shape.filters).max(axis=1) + self.w["bias"]
        return np.maximum(top, 0)

    def probability(self, texts: list[bytes]) -> np.ndarray:
        """One probability per text."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        shape, out = self.shape, np.zeros(len(texts))
        sums = np.zeros((len(texts), shape.filters))
        tops = np.zeros((len(texts), shape.filters), np.float32)
        counts = np.zeros(len(texts))
        most = max(1, STEP_POSITIONS // shape.chunk)
        waiting: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if not owner:
                return
            values, at = self.pooled(np.concatenate(waiting)), np.array(owner)
            np.add.at(sums, at, values)
            np.maximum.at(tops, at, values)
            np.add.at(counts, at, 1)
            waiting.clear()
            owner.clear()

        for row, data in enumerate(texts):
            chunks = chunked(data, shape)
            for start in range(0, len(chunks), most):
                part = chunks[start : start + most]
                if len(owner) + len(part) > most:
                    flush()
                waiting.append(part)
                owner.extend([row] * len(part))
        flush()
        features = np.concatenate([sums / counts[:, None], tops], axis=1)
        out = features @ self.w["out"].astype(np.float64) + float(self.w["shift"][0])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over one batch of texts."""
        s, n = self.shape, len(labels)
        windows = self._windows(chunks)
        response = (windows.reshape(-1, windows.shape[2]) @ self.w["filters"]).reshape(len(chunks), -1, s.filters)
        best = response.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(response, best[:, None], 1)[:, 0] + self.w["bias"], 0)
        counts = np.bincount(owner, minlength=n).astype(pooled.dtype)
        mean = np.zeros((n, s.filters), pooled.dtype)
        np.add.at(mean, owner, pooled)
        mean /= counts[:, None]
        top = np.zeros((n, s.filters), pooled.dtype)
        np.maximum.at(top, owner, pooled)
        features = np.concatenate([mean, top], axis=1)
        p = 1 / (1 + np.exp(-(features @ self.w["out"] + self.w["shift"])))
        miss = ((p - labels) / n).astype(pooled.dtype)
        back = miss[:, None] * self.w["out"]
        to_mean, to_top = back[:, : s.filters] / counts[:, None], back[:, s.filters :]
        flow = (to_mean[owner] + to_top[owner] * (pooled == top[owner])) * (pooled > 0)
        # Only the best window of each chunk and filter takes part.
        chosen = np.take_along_axis(windows, best[:, :, None], 1)  # chunks, filters, width * vector
        grad_filters = np.einsum("cf,cfk->kf", flow, chosen)
        grad_windows = flow[:, :, None] * self.w["filters"].T[None]  # chunks, filters, width * vector
        places = best[:, :, None] * s.stride + np.arange(s.width)
        symbols = np.take_along_axis(chunks[:, None].repeat(s.filters, 1), places, 2)
        grad_vectors = np.zeros_like(self.w["vectors"])
        np.add.at(grad_vectors, symbols.reshape(-1), grad_windows.reshape(-1, s.vector))
        return {"vectors": grad_vectors, "filters": grad_filters, "bias": flow.sum(0), "out": features.T @ miss, "shift": miss.sum(keepdims=True)}


def fit(texts: list[bytes], labels: list[int], shape: Shape = Shape(), law: Training = Training()) -> Network:
    """A network fitted to labelled texts (Adam on the log loss)."""
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Network(shape, law.seed, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(law.seed)
    net = Network(shape, law.seed)
    cut = [chunked(t, shape) for t in texts]
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    done = 0
    while done < law.steps:
        order = rng.permutation(len(y))
        for start in range(0, len(y), law.batch):
            if done == law.steps:
                break
            rows = order[start : start + law.batch]
            parts, owner = [], []
            for k, row in enumerate(rows):
                chunks = cut[row]
                if len(chunks) > law.chunks:
                    chunks = chunks[rng.choice(len(chunks), law.chunks, replace=False)]
                parts.append(chunks)
                owner += [k] * len(chunks)
            grads = net.gradients(np.concatenate(parts), np.array(owner), y[rows])
            done += 1
            rate = law.rate * (1 - 0.9 * done / law.steps)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.w[k] -= rate * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-7)
    return net


def fold(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(
    docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), law: Training = Training(), id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
) -> Network:
    """Fit on at most ``law.rows`` labelled rows of the folds other than 1.

    The sample is chosen by id hash among the labelled ids, then its texts are read; rows whose labels differ are skipped.
    """
    known = common.only(labels, {"_id": id_col, "_label": label_col}).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    known = known.where(fold(F.col("_id")) != 1).groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
    known = known.where(F.col("_label") == F.col("_other")).drop("_other")
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(law.rows)
    texts = common.only(docs, {"_id": id_col, "_text": text_col})
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("_label").alias("_label"), F.min("_text").alias("_text"))
    got = sorted(rows.toPandas().itertuples(index=False), key=lambda r: r[0])
    return fit([(r[2] or "").encode() for r in got], [int(r[1]) for r in got], shape, law)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.probability([(t or "").encode() for t in part.column("_text").to_pylist()])
        return common.batch(
            [part.column("doc_id"), part.column("held_out"), p, (p >= 0.5).astype(np.int32)], ["doc_id", "held_out", "score", "predicted"],
            [pa.int64(), pa.bool_(), pa.float64(), pa.int32()],
        )

    slim = common.only(docs, {"doc_id": id_col, "_text": text_col}).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(True)))
    return common.over_texts(slim, "_text", "doc_id BIGINT, held_out BOOLEAN, score DOUBLE, predicted INT", step)


def keep_good(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the network accepts, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def step(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = shared.value.probability([(t or "").encode() for t in part.column(text_col).to_pylist()])
        yield part.filter(pa.array(p >= 0.5))

    return common.over_texts(docs, text_col, docs.schema, step)
