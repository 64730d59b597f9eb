"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are used; documents labelled as harmless say nothing but how common toxic ones are, that is,
the class prior. A linear classifier on the set of a text's words (as 64-bit hashes) is trained in numpy. With l the logistic loss, its risk is

    prior * mean l(toxic, +1) + max(0, mean l(unlabelled, -1) - prior * mean l(toxic, -1))

The second term is the risk on harmless texts, which can't be below 0; where it falls below -SLACK on some step, the step goes up its gradient instead
of down (the non-negative correction), so the toxic texts among the unlabelled ones aren't learned as harmless. Words whose share of the
confirmed texts is within ``sigma`` standard errors or a ``factor`` of their share of the unlabelled ones, or that are too rare to tell (``seen``), get no weight,
so long texts aren't judged by their length. The steps run over all rows of the samples, each weight's scaled by a bound of its curvature.

Fitting uses bounded samples: ``max_toxic`` confirmed and ``max_unlabelled`` other documents, those with the smallest hashes of doc_id, one row
of each. One executor task fits; the driver gets the weights only. Scoring covers all rows and whole texts.

Nulls: a null text counts as the empty one, whose score is that of the bias alone. Label rows with null doc_id or label are skipped; repeated ones count
once with their largest label. Without confirmed documents all scores are the prior's (0 without labels). Columns named like the outputs are
replaced; ``out`` gives the outputs other names. Repeated rows stay. Very long texts are cut into slices of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks
from ._grams import byte_classes, hashes, words
from .quality import held_out

MAX_TOXIC, MAX_UNLABELLED = 4000, 8000
STEPS, SIGMA, FACTOR, RIDGE, SLACK, SEEN = 6000, 6.0, 4.0, 1e-6, 0.0, 5
_LETTERS = byte_classes([range(65, 91), range(97, 123), range(128, 256)], [])


def _sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct words, text after text, and each text's bounds."""
    spelled, code, text, _ = words(data, offs, _LETTERS)
    k = max(1, len(spelled))
    pair = np.unique(text * k + code)
    return hashes(spelled).astype(np.int64)[pair % k], np.searchsorted(pair // k, np.arange(len(offs)))


@dataclass
class ToxicityModel:
    """Hashes of words, in order, their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        spelled, code, text, _ = words(data, offs, _LETTERS)
        h = hashes(spelled).astype(np.int64)
        at = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        w = np.where(self.words[at] == h, self.weights[at], 0.0) if len(self.words) else np.zeros(len(h))
        told = (w != 0)[code]  # other words add nothing
        k = max(1, len(spelled))
        pair = np.unique(text[told] * k + code[told])
        return _sigmoid(np.bincount(pair // k, w[pair % k], minlength=len(offs) - 1) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def prior_model(prior: float) -> ToxicityModel:
    return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))


def risk(toxic_z: np.ndarray, unlabelled_z: np.ndarray, prior: float) -> tuple[float, float]:
    """Of scores before the sigmoid, the risk on toxic texts, and that on harmless ones, estimated without seeing any."""
    loss = lambda z: float(np.logaddexp(0, -z).mean())
    return prior * loss(toxic_z), loss(-unlabelled_z) - prior * loss(-toxic_z)


def nnpu(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, sigma: float = SIGMA, factor: float = FACTOR, ridge: float = RIDGE, slack: float = SLACK, seen: int = SEEN) -> ToxicityModel:
    """Steps on the non-negative risk; rows are the hashes of the distinct words of texts."""
    model = prior_model(prior)
    if not toxic or not unlabelled:
        return model
    n_p, n_u = len(toxic), len(unlabelled)
    known, place = np.unique(np.concatenate([*toxic, *unlabelled]), return_inverse=True)
    cut = sum(map(len, toxic))
    in_p, in_u = (np.bincount(x, minlength=len(known)) for x in (place[:cut], place[cut:]))
    share_p, share_u = in_p / n_p, in_u / n_u
    both = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    apart = (share_p > factor * share_u) | (share_u > factor * share_p)
    used = (np.maximum(in_p, in_u * (n_p / n_u)) >= seen) & (np.abs(share_p - share_u) > sigma * error) & apart
    number = np.cumsum(used) - 1

    def packed(rows: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[used[at]]
        return number[at][used[at]], row, np.bincount(row, minlength=len(rows)) + 1

    (p_slot, p_row, _), (u_slot, u_row, u_each) = packed(toxic, place[:cut]), packed(unlabelled, place[cut:])
    w, b = np.zeros(int(used.sum())), model.bias

    def total(slot: np.ndarray, row: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(slot, by_row[row], minlength=len(w)), by_row.sum())

    each = np.bincount(p_row, minlength=n_p) + 1
    curve = 0.25 * np.maximum(total(u_slot, u_row, u_each / n_u), prior * total(p_slot, p_row, each / n_p)) + ridge  # steps of 1 / curve don't overshoot
    for _ in range(steps):
        zp = np.bincount(p_row, w[p_slot], minlength=n_p) + b
        zu = np.bincount(u_row, w[u_slot], minlength=n_u) + b
        p, u = _sigmoid(zp), _sigmoid(zu)
        harmless = total(u_slot, u_row, u / n_u) - prior * total(p_slot, p_row, p / n_p)
        if risk(zp, zu, prior)[1] < -slack:
            g = -harmless
        else:
            g = harmless - prior * total(p_slot, p_row, (1 - p) / n_p)
        g[:-1] += ridge * w
        w, b = w - (g / curve)[:-1], b - float(g[-1] / curve[-1])
    return ToxicityModel(known[used], w, float(b))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of each of some ids (a bounded number): the one whose text has the smallest hash."""
    picked = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).join(F.broadcast(ids), "_id")
    return picked.groupBy("_id").agg(F.max("_y").alias("_y"), F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t"))).alias("_m")).select("_m._t", "_y")


def train_toxicity(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED, fold: tuple[int, int] | None = (3, 1), prior: float | None = None, **options,
) -> ToxicityModel:
    """Fit on bounded samples, none of the held-out fold (modulus, remainder); the prior is the share of toxic ones among labelled documents unless it is given."""
    id_ = F.col("doc_id").alias("_id")
    lab = labels.select(id_, F.col("toxic").cast("int").alias("_y")).dropna()
    every = docs.select(id_).dropna()
    if fold:
        lab, every = (df.filter(~held_out(F.col("_id"), *fold)) for df in (lab, every))
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y"))
    if prior is None:
        prior = lab.agg(F.avg((F.col("_y") > 0).cast("double"))).first()[0] or 0.0
    prior = min(prior, 0.99)
    least = lambda df, n: df.orderBy(F.xxhash64("_id"), "_id").limit(n)
    toxic = least(lab.filter("_y > 0").join(every, "_id", "left_semi").select("_id"), max_toxic).withColumn("_y", F.lit(1))
    others = least(every.distinct(), max_unlabelled).withColumn("_y", F.lit(0))
    rows = _texts(docs, toxic).unionByName(_texts(docs, others))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column(1)
            for lo, hi, data, offs in blocks(batch.column(0)):
                slots, bounds = _sets(data, offs)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(slots, pa.int64())), ys.slice(lo, hi - lo)], ["i", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list] = ([], [])
        for got in batches:
            for i, y in zip(got["i"], got["y"].to_pylist(), strict=True):
                found[y].append(i.values.to_numpy())
        for part in found:
            part.sort(key=lambda r: (len(r), r.tobytes()))  # the order rows arrive in differs between runs
        m = nnpu(found[1], found[0], prior, **options)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.words, m.weights)] + [pa.array([m.bias])], ["h", "w", "b"])

    best = rows.mapInArrow(features, "i array<bigint>, y int").repartition(1).mapInArrow(fit, "h binary, w binary, b double").first()
    return prior_model(prior) if best is None else ToxicityModel(np.frombuffer(best["h"], np.int64), np.frombuffer(best["w"], np.float64), best["b"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1, higher: more likely toxic) and predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.bias))  # words of the bounded samples at most

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = ToxicityModel(*shared.value)
        for arr in parts:
            got = [m.scores(data, offs) for _, _, data, offs in blocks(arr)]
            yield pa.array(np.concatenate(got) if got else [], pa.float64())

    return docs.withColumn(out[0], score("text")).withColumn(out[1], (F.col(out[0]) >= threshold).cast("int"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
