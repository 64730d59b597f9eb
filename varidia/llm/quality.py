"""Quality classifier: logistic regression on hashed word n-grams, learned with follow-the-regularised-leader.

Words and runs of other marks are tokens; the shape of each token (in capitals, marks, same as the one before)
joins them as a feature of its own. Unigrams and bigrams are hashed into 2**bits slots. A text's vector has, at each slot, its count
over the square root of the text's number of features, so a score is one sparse dot product.

Fitting uses a bounded sample: one row of each of ``max_rows`` labelled documents at most (the smallest hashes of
doc_id; of rows with one doc_id the one whose text has the smallest hash). One task of an executor fits; the driver gets
the 2**bits weights only. Scoring covers every row and whole texts.

Nulls: a null text counts as the empty one, whose score is that of the bias alone. Rows of labels with null
doc_id or label are skipped; repeated label rows of a document count once with their largest label. If no
labels are left, every score is 0.5. Very long texts are cut into slices of words. Columns named like the outputs are
replaced; ``out`` gives the outputs other names. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, mix, segment_sum, token_hashes

BITS = 18
MAX_ROWS = 6000


def _slots(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all texts in order, and each text's bounds: unigrams, bigrams, shape unigrams."""
    hs, bounds, kinds = token_hashes(data, offs, split_marks=True, shapes=True)
    pair = np.empty_like(hs)
    if len(hs):
        prev = np.concatenate((hs[:1], hs[:-1]))
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        prev[first] = np.uint64(7)  # the start of a text
        pair = mix(prev * np.uint64(3) + hs)
        kinds = np.where(hs == prev, 3, kinds)
    shape = mix(kinds.astype(np.uint64) + np.uint64(11))
    top = np.uint64(64 - bits)
    return np.stack([hs >> top, pair >> top, shape >> top], 1).astype(np.int64).ravel(), bounds * 3


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        slots, bounds = _slots(data, offs, self.bits)
        n = np.maximum(np.diff(bounds), 1)
        z = segment_sum(self.weights[slots].astype(np.float64), bounds) / np.sqrt(n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 7) -> QualityModel:
    """FTRL-Proximal over sparse rows (slots, values, label); per-coordinate rates."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            idx, val, y = rows[k]
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            b = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(float(w @ val) + b, -30, 30)))
            g = (p - y) * val
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx], n[idx] = zi + g - sigma * w, ni + g * g
            gb = p - y
            zb, nb = zb + gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / alpha * b, nb + gb * gb
    return QualityModel(weight(z, n).astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha)), bits)


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text has the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, fold: tuple[int, int] | None = (5, 0)) -> QualityModel:
    """Fit on max_rows labelled rows at most, none of the held-out fold (modulus, remainder)."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).dropna()
    if fold:
        lab = lab.filter(~held_out(F.col("_id"), *fold))
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    picked = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).join(F.broadcast(lab), "_id")
    picked = picked.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t"))).alias("_m")).select("_m._t", "_y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column(1).to_pylist()
            for lo, hi, data, offs in blocks(batch.column(0)):
                slots, bounds = _slots(data, offs, bits)
                idx, val = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    u, c = np.unique(slots[a:b], return_counts=True)
                    idx.append(u.astype(np.int32))
                    val.append((c / np.sqrt(max(b - a, 1))).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())), pa.array(ys[lo:hi], pa.int32())], ["i", "v", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for got in batches:
            rows += [(i.values.to_numpy(), v.values.to_numpy(), y) for i, v, y in zip(got["i"], got["v"], got["y"].to_pylist(), strict=True)]
        rows.sort(key=lambda r: (len(r[0]), r[2], r[0].tobytes(), r[1].tobytes()))  # the order rows arrive in differs between runs
        if rows:
            m = ftrl(rows, bits)
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias])], ["w", "b"])

    best = picked.mapInArrow(features, "i array<int>, v array<float>, y int").repartition(1).mapInArrow(fit, "w binary, b double").first()
    if best is None:
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, bits)
    return QualityModel(np.frombuffer(best["w"], np.float32), best["b"], bits)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits))  # 2**bits floats, whatever the data

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = QualityModel(*shared.value)
        for arr in parts:
            got = [m.scores(data, offs) for _, _, data, offs in blocks(arr)]
            yield pa.array(np.concatenate(got) if got else [], pa.float64())

    return docs.withColumn(out[0], score("text")).withColumn(out[1], (F.col(out[0]) >= threshold).cast("int"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
