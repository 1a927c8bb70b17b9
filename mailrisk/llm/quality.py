"""Quality classifier: a small convolutional network over bytes, trained and run in numpy.

A document is cut into overlapping chunks that cover it whole. Each byte is embedded, learnt
filters slide over each chunk, and each filter's largest response in a chunk is kept. The
document is described by the mean and the maximum over its chunks of these responses, and a
logistic unit combines them into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailrisk.llm.common import labelled_sample

WIDTH, EMBED, FILTERS, CHUNK, OVERLAP = 8, 4, 24, 256, 32
#: Chunks that one matrix product takes, which bounds the memory of a task for any text.
CHUNKS_AT_ONCE = 512


@dataclass
class QualityModel:
    embedding: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    filter_bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    bias: float

    def pooled(self, data: bytes) -> Iterator[np.ndarray]:
        """Largest responses of the chunks of one text, a block of chunks at a time."""
        step = (CHUNK - OVERLAP) * CHUNKS_AT_ONCE
        for start in range(0, max(1, len(data) - OVERLAP), step):
            yield self.respond(chunks(data[start : start + step + OVERLAP]))

    def respond(self, block: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk (n x FILTERS), rectified."""
        return np.maximum(self.responses(block).max(axis=1) + self.filter_bias, 0)

    def responses(self, block: np.ndarray) -> np.ndarray:
        return _windows(self.embedding[block]) @ self.filters

    def logit(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.concatenate([mean, most], axis=-1) @ self.weights + self.bias

    def score(self, data: bytes) -> float:
        return float(self.scores([data])[0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of many texts. Their chunks share matrix products, but no text affects another."""
        mean, most = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS))
        counts = np.zeros(len(texts))
        waiting: list[tuple[np.ndarray, int]] = []
        held = 0

        def flush() -> None:
            if waiting:
                got = self.respond(np.concatenate([b for b, _ in waiting]))
                owner = np.repeat([i for _, i in waiting], [len(b) for b, _ in waiting])
                np.maximum.at(most, owner, got)
                np.add.at(mean, owner, got)
                np.add.at(counts, owner, 1)
                waiting.clear()

        step = (CHUNK - OVERLAP) * CHUNKS_AT_ONCE
        for i, data in enumerate(texts):
            for start in range(0, max(1, len(data) - OVERLAP), step):
                block = chunks(data[start : start + step + OVERLAP])
                waiting.append((block, i))
                held += len(block)
                if held >= CHUNKS_AT_ONCE:
                    flush()
                    held = 0
        flush()
        # Rounded to six digits: the order of float32 sums inside a product may differ by its size.
        return np.round(1 / (1 + np.exp(-np.clip(self.logit(mean / np.maximum(counts, 1)[:, None], most), -30, 30))), 6)


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes; the last is padded with byte 0, an empty text is one padded chunk."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def _windows(embedded: np.ndarray) -> np.ndarray:
    """n x CHUNK x EMBED to n x positions x (WIDTH * EMBED)."""
    n, size, depth = embedded.shape
    flat = embedded.reshape(n, size * depth)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, WIDTH * depth, axis=1)[:, ::depth])


def fit(sample: list[tuple[str, int]], epochs: int = 6, chunks_per_text: int = 4, seed: int = 7) -> QualityModel:
    """Trains by Adam on labelled texts; each epoch takes some random chunks of each text.

    Classes weigh the same per epoch up to a factor of four. Without examples of both
    labels the model gives the share of label 1 (0.5 without examples).
    """
    rng = np.random.default_rng(seed)
    model = QualityModel(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0,
    )
    y = np.array([label for _, label in sample], dtype=float)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        model.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    texts = [chunks(text.encode("utf-8", "surrogatepass")) for text, _ in sample]
    share = y.mean()
    balance = np.where(y == 1, min(4.0, 0.5 / share), min(4.0, 0.5 / (1 - share)))
    model.weights = rng.normal(0, 0.1, 2 * FILTERS)
    params = [model.embedding, model.filters, model.filter_bias, model.weights, np.zeros(1)]
    moments = [[np.zeros(p.shape), np.zeros(p.shape)] for p in params]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            picked = [texts[i][rng.choice(len(texts[i]), min(chunks_per_text, len(texts[i])), replace=False)] for i in rows]
            t += 1
            _adam(params, moments, _gradients(model, picked, y[rows], balance[rows]), t, rate)
            model.bias = float(params[4][0])
    return model


def _gradients(model: QualityModel, picked: list[np.ndarray], y: np.ndarray, balance: np.ndarray) -> list[np.ndarray]:
    block = np.concatenate(picked)
    sizes = np.array([len(p) for p in picked])
    owner, starts = np.repeat(np.arange(len(picked)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
    embedded = model.embedding[block]
    windows = _windows(embedded)
    raw = windows @ model.filters
    place = raw.argmax(axis=1)  # chunk x filter
    at = np.arange(len(block))[:, None]
    best = np.take_along_axis(raw, place[:, None, :], axis=1)[:, 0] + model.filter_bias
    active = np.maximum(best, 0)
    mean, most = np.add.reduceat(active, starts) / sizes[:, None], np.maximum.reduceat(active, starts)
    p = 1 / (1 + np.exp(-np.clip(model.logit(mean, most), -30, 30)))
    d_logit = (p - y) * balance / len(y)
    d_weights = np.concatenate([mean, most], axis=1).T @ d_logit + 1e-4 * model.weights
    d_pool = d_logit[:, None] * model.weights[None, :]
    d_active = (d_pool[:, :FILTERS] / sizes[:, None])[owner] + d_pool[owner, FILTERS:] * (active == most[owner])
    d_best = d_active * (best > 0)
    chosen = windows[at, place]  # chunk x filter x taps: only the largest response has a gradient
    d_filters = np.einsum("nft,nf->tf", chosen, d_best)
    d_taps = d_best[:, :, None] * model.filters.T[None]
    d_embedding = np.zeros_like(model.embedding, dtype=float)
    letters = block[at[:, :, None], place[:, :, None] + np.arange(WIDTH)]
    np.add.at(d_embedding, letters.ravel(), d_taps.reshape(-1, EMBED))
    return [d_embedding, d_filters, d_best.sum(axis=0), d_weights, np.array([d_logit.sum()])]


def _adam(params, moments, gradients, t: int, rate: float) -> None:
    for p, (m, v), g in zip(params, moments, gradients, strict=True):
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(p.dtype)


def fit_tables(documents: DataFrame, labels: DataFrame, rows: int = 3000, max_bytes: int = 32768) -> QualityModel:
    """Fits on a bounded sample of labelled training rows (see common.labelled_sample)."""
    return fit(labelled_sample(documents, labels, "quality", rows, max_bytes))


def score(documents: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The documents with `score` (0 to 1) and `predicted`; columns of these names are replaced.

    Whole texts are scored. Null counts as empty; an empty text is one chunk of padding.
    Repeated rows are each scored alike. There is no shuffle.
    """
    kept = documents.drop("score", "predicted")
    names = kept.columns
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in kept.dtypes), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.scores([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))],
                names=[*names, "score", "predicted"],
            )

    return kept.mapInArrow(run, schema)
