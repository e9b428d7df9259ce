"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a vector of hashed term weights: character trigrams, four-grams of character
classes (letter, capital, digit, space, sign) and a few terms for how often its words repeat. The leading
singular directions of the labelled sample make the latent space. The labelled vectors, of
fixed number, go to every executor; every document is compared with all of them by blocked matrix products,
and its nearest vote with weights that grow with cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import hash_sample, slices

#: Hashed terms of each kind; latent dimensions; neighbours; power of the similarity; documents of one product.
TERMS, DIMS, NEIGHBOURS, SHARPNESS, BLOCK = 1024, 48, 15, 12, 512
#: The fit sees about this many labelled rows, never more than twice as many: 4096 * (2 * TERMS + STYLE) * 4 bytes to the driver, 35 MB.
SAMPLE = 4096
STYLE = 64
THRESHOLD = 0.3
_STEP = 1 << 20

_CLASS = np.full(256, 9, np.uint32)  # other signs by themselves, see below
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 1  # letters of more than a byte
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
for _i, _c in enumerate(b".,;:!?'\"-#$%&*@|/()<>=+_[]{}\\~^`"):
    _CLASS[_c] = 10 + _i


def terms(text: bytes) -> np.ndarray:
    """The term vector of a whole text: square roots of counts, each kind of length one; zeros if it is empty."""
    out = np.zeros(2 * TERMS + STYLE, np.float32)
    if not text:
        return out
    raw, shape = np.zeros(TERMS, np.int64), np.zeros(TERMS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), _STEP):
        b = data[at : at + _STEP + 3]
        x = b[: _STEP + 2].astype(np.uint32)
        if len(x) >= 3:
            raw += np.bincount((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22), minlength=TERMS)
        c = _CLASS[b]
        if len(c) >= 4:
            shape += np.bincount((c[:-3] * np.uint32(0x9E3779B1) + c[1:-2] * np.uint32(0x85EBCA77) + c[2:-1] * np.uint32(0xC2B2AE3D) + c[3:] * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=TERMS)
    for lo, counts in ((0, raw), (TERMS, shape)):
        w = np.sqrt(counts.astype(np.float32))
        out[lo : lo + TERMS] = w / max(1e-9, float(np.sqrt((w * w).sum())))
    words = text.split()
    n = max(1, len(words))
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    lines = text.split(b"\n")
    signs = float(np.count_nonzero(_CLASS[data] >= 9)) / len(data)
    capitals = float(np.count_nonzero(_CLASS[data] == 2)) / len(data)
    facts = (same, len(set(words)) / n, 4 * signs, 2 * capitals, len(set(lines)) / len(lines), min(1.0, np.log2(1 + n) / 16), min(1.0, len(text) / n / 40), len(lines) / (n + 1))
    for i, v in enumerate(facts):  # each fact is shared out between two of eight terms
        place = min(max(v, 0.0), 1.0) * 6.999
        k = int(place)
        out[2 * TERMS + 8 * i + k] = np.sqrt(1 - (place - k)) * 0.35
        out[2 * TERMS + 8 * i + k + 1 if k < 7 else 2 * TERMS + 8 * i + k] += np.sqrt(place - k) * 0.35
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


class Model:
    """The latent space of the labelled rows, their vectors and their labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dims: int = DIMS):
        self.labels = labels.astype(np.float32)
        self.base = float(labels.mean()) if len(labels) else 0.5
        self.mean = rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1], np.float32)
        centred = rows - self.mean
        dims = max(1, min(dims, *centred.shape)) if len(rows) else 1
        q = np.random.default_rng(5).normal(size=(centred.shape[1], dims + 16)).astype(np.float32)
        for _ in range(6):  # subspace iteration
            q, _ = np.linalg.qr(centred.T @ (centred @ q))
        _, _, vt = np.linalg.svd(centred @ q, full_matrices=False)
        self.axes = np.ascontiguousarray((q @ vt.T)[:, :dims]).astype(np.float32)
        self.vectors = np.ascontiguousarray(_unit(centred @ self.axes).T)

    def score(self, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Weighted vote of the nearest labelled vectors; the share of label 1 where there is none."""
        n, k = len(rows), min(neighbours, len(self.labels))
        if not k:
            return np.full(n, self.base)
        out = np.empty(n)
        for at in range(0, n, BLOCK):
            sims = _unit((rows[at : at + BLOCK] - self.mean) @ self.axes) @ self.vectors
            near = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :]
            weight = np.maximum(np.take_along_axis(sims, near, axis=1), 0) ** SHARPNESS + 1e-9
            out[at : at + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        out[~rows.any(axis=1)] = self.base
        return np.clip(out, 0.0, 1.0)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled rows that are not held out, chosen by hash of their id."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    chosen = hash_sample(known, "_id", sample).groupBy("_id").agg(F.min("label").alias("label")).limit(2 * sample)
    # at most 2 * sample rows of 20 bytes
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "_id").select(F.xxhash64(F.col("_id").cast("string")).alias("_k"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t or b"").tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["k", "label", "terms"])

    # an id that rows repeat counts once, so no more rows than were chosen come to the driver
    made = rows.mapInArrow(run, "k long, label int, terms binary").groupBy("k").agg(F.min(F.struct("label", "terms")).alias("one"))
    got = sorted((r.k, r.one.label, bytes(r.one.terms)) for r in made.collect())
    matrix = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(len(got), 2 * TERMS + STYLE)
    return Model(matrix, np.array([r[1] for r in got], np.float32))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row per input row; the whole text is read, and nothing else.

    Null and empty texts have the share of label 1 in the sample as their score. Repeated
    rows get equal scores; an empty table gives an empty result; very long texts are read in steps;
    other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column(2)
            s = np.concatenate([shared.value.score(np.stack([terms(t.as_py() or b"") for t in texts[at : at + BLOCK]])) for at in range(0, len(texts), BLOCK)]) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
