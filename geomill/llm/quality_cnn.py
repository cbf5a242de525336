"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes become symbols: the byte, and whether the four bytes from it on also
stand within the 16 bytes before. Learned filters of width 6 run over overlapping
chunks that cover the whole text; each chunk keeps every filter's largest response,
the chunks' means and maxima go through one logistic unit. Chunks are built from
blocks of 64 bytes, so memory is a fixed multiple of a piece of text, and a text's
score does not depend on its neighbours.

The network is trained by back-propagation in numpy on a bounded sample of labelled
documents (`train_rows`, `train_bytes`); scoring runs in Spark tasks over all rows.

Defined results: null and empty texts are scored as one chunk of padding, blended to
the share of label 1; texts of any length are scored
whole; repeated rows each give a row; null ids count as fold 0; without labels every score
is 0.5; an empty table gives an empty table; extra columns, whatever their names, are not
read, or stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.llm.labels import fold, sample
from geomill.llm.text import pieces, thrifty

WIDTH, FILTERS, BLOCK = 6, 12, 64
#: A chunk is four blocks, and the next one begins three blocks later.
CHUNK, STRIDE = 4, 3
PAD = 24
TRAIN_ROWS, TRAIN_BYTES, EPOCHS = 1600, 16_000, 14


def symbols(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts laid end to end, and their bounds in blocks. Zeros on both sides fill whole blocks, so no filter reaches a neighbour."""
    blocks = np.array([(len(t) + PAD + BLOCK - 1) // BLOCK for t in texts])
    bounds = np.append(0, np.cumsum(blocks))
    data = np.zeros(int(bounds[-1]) * BLOCK + WIDTH, np.uint8)
    for t, b in zip(texts, bounds[:-1].tolist()):
        data[b * BLOCK + WIDTH : b * BLOCK + WIDTH + len(t)] = t
    gram = data[:-3].astype(np.uint32)
    for j in (1, 2, 3):
        gram |= data[j : len(data) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
    again = np.zeros(len(gram), bool)
    for lag in range(2, 17):
        again[lag:] |= gram[lag:] == gram[:-lag]
    out = data.astype(np.int16)
    out[:-3][again & (data[:-3] != 0)] += 256
    return out, bounds


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 512, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float
    prior: float

    def responses(self, sym: np.ndarray) -> np.ndarray:
        n = len(sym) - WIDTH
        out = self.filters[0][sym[:n]]
        for w in range(1, WIDTH):
            out += self.filters[w][sym[w : n + w]]
        return out

    def pooled(self, sym: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and the text of each chunk."""
        blocks = np.concatenate([self.responses(sym[i * BLOCK : (min(i + 4096, int(bounds[-1]))) * BLOCK + WIDTH]).reshape(-1, BLOCK, FILTERS).max(axis=1) for i in range(0, int(bounds[-1]), 4096)])
        first, owner = chunk_starts(bounds)
        last = bounds[owner + 1]
        top = blocks[first]
        for j in range(1, CHUNK):
            top = np.maximum(top, blocks[np.minimum(first + j, last - 1)])
        return top, owner

    def features(self, top: np.ndarray, owner: np.ndarray) -> np.ndarray:
        act = np.tanh(top + self.bias)
        lead = np.searchsorted(owner, np.arange(owner[-1] + 1))
        n = np.diff(np.append(lead, len(owner)))
        return np.concatenate([np.add.reduceat(act, lead) / n[:, None], np.maximum.reduceat(act, lead)], axis=1)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        x = self.features(*self.pooled(*symbols(texts)))
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", x.astype(np.float64), self.weights) + self.offset, -30, 30)))
        n = np.array([len(t) for t in texts])
        return np.where(n == 0, self.prior, p)


def chunk_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(bounds)
    n = np.maximum(1, (size - CHUNK + STRIDE - 1) // STRIDE + 1)
    owner = np.repeat(np.arange(len(size)), n)
    return bounds[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE, owner


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, batch: int = 64, rate: float = 0.02) -> Network:
    """Adam on the logistic loss; both labels weigh alike in the loss, and the offset is set back to their shares at the end."""
    rng = np.random.default_rng(seed)
    net = Network((rng.normal(0, 0.15, (WIDTH, 512, FILTERS))).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), 0.0, float(labels.mean()) if len(labels) else 0.5)
    if len(labels) == 0 or labels.min() == labels.max():
        net.weights[:] = 0
        net.offset = 0.0 if len(labels) == 0 else (4.0 if labels[0] else -4.0)
        return net
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = [net.filters, net.bias, net.weights]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    off_m = off_v = 0.0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sym, bounds = symbols([texts[i] for i in own])
            out = net.responses(sym)
            start, owner = chunk_starts(bounds)
            stop = np.minimum(start + CHUNK, bounds[owner + 1])
            seg = np.stack([start * BLOCK, stop * BLOCK], axis=1)
            where = np.empty((len(start), FILTERS), np.int64)
            top = np.empty((len(start), FILTERS), np.float32)
            for c, (a, b) in enumerate(seg.tolist()):
                part = out[a:b]
                k = part.argmax(axis=0)
                where[c], top[c] = a + k, part[k, np.arange(FILTERS)]
            act = np.tanh(top + net.bias)
            x = net.features(top, owner)
            p = 1 / (1 + np.exp(-np.clip(x @ net.weights + net.offset, -30, 30)))
            g = (p - labels[own]) * weight[own] / len(own)
            dx = np.outer(g, net.weights)
            n = np.bincount(owner)
            lead = np.searchsorted(owner, np.arange(len(own)))
            peak = np.maximum.reduceat(act, lead)
            dact = dx[owner, :FILTERS] / n[owner][:, None] + dx[owner, FILTERS:] * (act == peak[owner])
            dtop = (dact * (1 - act**2)).astype(np.float32)
            gf = np.zeros_like(net.filters)
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            for w in range(WIDTH):
                np.add.at(gf[w], (sym[where + w], f), dtop)
            step += 1
            for i, (p_, g_) in enumerate(zip(params, (gf, dtop.sum(axis=0), x.T @ g + 1e-4 * net.weights))):
                first[i] = 0.9 * first[i] + 0.1 * g_
                second[i] = 0.99 * second[i] + 0.01 * g_**2
                p_ -= (lr * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)).astype(p_.dtype)
            off_m, off_v = 0.9 * off_m + 0.1 * g.sum(), 0.99 * off_v + 0.01 * g.sum() ** 2
            net.offset -= lr * off_m / (1 - 0.9**step) / (np.sqrt(off_v / (1 - 0.99**step)) + 1e-7)
    net.offset += float(np.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int, label: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Network:
    rows = sample(docs, labels, label, folds, held, train_rows, train_bytes, id_col, text_col).collect()
    return train([np.frombuffer(r["text"].encode(), np.uint8) for r in rows], np.array([r["label"] for r in rows]))


def score(docs: DataFrame, net: Network, folds: int, held: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2), 1 << 20):
                p = shared.value.score([piece.data[a:b] for a, b in zip(piece.offsets[:-1], piece.offsets[1:])])
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(id_col, (fold(id_col, folds) == held).alias("held_out"), text_col).mapInArrow(thrifty(run), schema)


def accepted(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores at least the threshold, with all their columns."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(at), 1 << 20):
                p = shared.value.score([piece.data[a:b] for a, b in zip(piece.offsets[:-1], piece.offsets[1:])])
                yield batch.slice(piece.first, len(piece)).filter(pa.array(p >= threshold))

    return docs.mapInArrow(thrifty(run), docs.schema)
