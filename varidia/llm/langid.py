"""Language identification: a byte convolutional network trained and applied in numpy.

A text's UTF-8 bytes (ASCII letters lowered) are cut into windows of WINDOW bytes, the last one padded with
zeros. Each byte has an embedding; filters of several widths run over the window, each keeps its maximum, and
a softmax layer follows. A text's probabilities are the mean of its windows' weighted by their bytes, so whole
texts count. Fitting uses a bounded sample: of the ``max_langs`` languages with most documents, one row of each of ``per_lang``
documents (the smallest hashes of doc_id) and ``windows_each`` windows of each row, so one task of an executor
gets max_langs * per_lang * windows_each * WINDOW bytes at most. It trains; the driver gets the network, some thousand numbers.

Nulls and texts without a letter: lang_pred is ``und`` and score 0. Rows with null lang are never learned from, nor
are ids that are held out. A doc_id with rows of several languages counts for the least of them. If nothing can be learned, every
lang_pred is ``und``. Very long texts are read in blocks of windows. Columns named like the outputs are
replaced; ``out`` gives the outputs other names. Repeated rows stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import _LOWER, blocks
from .quality import held_out

WINDOW = 256
WIDTHS = (2, 3, 4)
DIM, FILTERS = 8, 12
UND = "und"


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (zero-padded rows), the text of each, and how many bytes of it are real."""
    size = np.diff(offs)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    nth = np.arange(len(owner)) - first[owner]
    start = offs[:-1][owner] + nth * WINDOW
    real = np.minimum(WINDOW, size[owner] - nth * WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    out = _LOWER[data[np.minimum(at, max(len(data) - 1, 0))]] if len(owner) else np.zeros((0, WINDOW), np.uint8)
    out[np.arange(WINDOW) >= real[:, None]] = 0
    return out, owner, real


def _columns(x: np.ndarray, emb: np.ndarray) -> np.ndarray:
    """For each window position the embeddings of max(WIDTHS) bytes in a row."""
    wide = max(WIDTHS)
    e = emb[np.pad(x, ((0, 0), (0, wide - 1)))].reshape(len(x), -1)
    view = np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, wide * DIM), (e.strides[0], DIM * 4, 4))
    return np.ascontiguousarray(view)


def forward(net: dict, x: np.ndarray) -> np.ndarray:
    """Softmax probabilities of windows, in batches that fit the cache."""
    out = np.empty((len(x), len(net["b2"])), np.float32)
    for lo in range(0, len(x), 64):
        part = x[lo : lo + 64]
        z = _columns(part, net["emb"]).reshape(-1, max(WIDTHS) * DIM) @ net["w1"]
        pooled = np.maximum(z.reshape(len(part), WINDOW, -1).max(1) + net["b1"], 0)
        logit = pooled @ net["w2"] + net["b2"]
        e = np.exp(logit - logit.max(1, keepdims=True))
        out[lo : lo + 64] = e / e.sum(1, keepdims=True)
    return out


def gradients(net: dict, xb: np.ndarray, yb: np.ndarray, mask: np.ndarray) -> dict:
    """Of the mean cross entropy of some windows; it flows through each filter's maximum only. mask has each filter's width."""
    wide, f, n = max(WIDTHS), FILTERS * len(WIDTHS), len(xb)
    col = _columns(xb, net["emb"])
    z = (col.reshape(-1, wide * DIM) @ net["w1"]).reshape(n, WINDOW, f)
    arg = z.argmax(1)
    top = np.take_along_axis(z, arg[:, None, :], 1)[:, 0] + net["b1"]
    pooled = np.maximum(top, 0)
    logit = pooled @ net["w2"] + net["b2"]
    e = np.exp(logit - logit.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    p[np.arange(n), yb] -= 1
    p /= n
    g = {"w2": pooled.T @ p, "b2": p.sum(0)}
    dtop = (p @ net["w2"].T) * (top > 0)
    g["b1"] = dtop.sum(0)
    at = np.take_along_axis(col, arg[:, :, None], 1)  # n, f, wide * DIM
    g["w1"] = np.einsum("nf,nfk->kf", dtop, at) * mask
    dcol = (dtop[:, :, None] * net["w1"].T[None]).reshape(n, f, wide, DIM)
    used = np.pad(xb, ((0, 0), (0, wide - 1)))[np.arange(n)[:, None, None], arg[:, :, None] + np.arange(wide)]
    g["emb"] = np.zeros_like(net["emb"])
    np.add.at(g["emb"], used.ravel(), dcol.reshape(-1, DIM))
    return g


def new_network(n_lang: int, rng: np.random.Generator) -> tuple[dict, np.ndarray]:
    wide, f = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((wide * DIM, f), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    shape = {"emb": (256, DIM), "w1": (wide * DIM, f), "b1": (f,), "w2": (f, n_lang), "b2": (n_lang,)}
    net = {k: (rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    net["w1"] *= mask
    return net, mask


def train_network(x: np.ndarray, y: np.ndarray, n_lang: int, epochs: int = 6, rate: float = 0.01, seed: int = 11) -> dict:
    """Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    net, mask = new_network(n_lang, rng)
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(p) for k, p in net.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            pick = order[lo : lo + 64]
            g = gradients(net, x[pick], y[pick], mask)
            step += 1
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net[k] = (net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, per_lang: int, fold: tuple[int, int] | None, max_langs: int) -> DataFrame:
    """(text, lang): one row of each of per_lang documents of each language at most.

    Each language's ids are counted first, roughly; then only rows whose hash is below a bound that some 1.3 * per_lang of
    its ids meet are shuffled, so a language with most rows costs no more than another.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t"), F.col("lang").alias("_l")).filter("_l is not null")
    if fold:
        rows = rows.filter(~held_out(F.col("_id"), *fold))
    langs = rows.groupBy("_l").agg(F.approx_count_distinct("_id").alias("_c")).orderBy(F.desc("_c"), "_l").limit(max_langs)
    rows = rows.join(F.broadcast(langs), "_l")  # max_langs rows at most
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    rows = rows.filter(place * F.col("_c") < 1.3 * per_lang + 100)
    ids = rows.groupBy("_id").agg(F.min(F.struct(F.col("_l"), F.xxhash64("_t").alias("h"), F.col("_t"))).alias("_m")).select("_id", "_m._l", "_m._t")
    order = Window.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id")
    return ids.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_lang).select("_t", "_l")


def train_langid(docs: DataFrame, per_lang: int = 700, windows_each: int = 4, fold: tuple[int, int] | None = (3, 1), max_langs: int = 100) -> tuple[dict, list[str]]:
    """The network and the languages in order; none of the held-out fold (modulus, remainder) is used."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_pylist()
            for lo, hi, data, offs in blocks(batch.column(0)):
                x, owner, real = windows(data, offs)
                n = np.bincount(owner, minlength=hi - lo)
                nth = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(n)))[owner]
                keep = nth % np.maximum(1, n // windows_each)[owner] == 0  # spread over the text
                keep &= nth // np.maximum(1, n // windows_each)[owner] < windows_each
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[keep]], pa.binary()), pa.array([lang[lo + o] for o in owner[keep]], pa.string())], ["x", "l"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for got in batches for r in zip(got["l"].to_pylist(), got["x"].to_pylist(), strict=True))
        langs = sorted({lang for lang, _ in rows})
        if langs:
            x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
            place = {lang: k for k, lang in enumerate(langs)}
            net = train_network(x, np.array([place[lang] for lang, _ in rows]), len(langs))
            yield pa.RecordBatch.from_arrays([pa.array([langs], pa.list_(pa.string())), pa.array([pickle.dumps(net)], pa.binary())], ["langs", "net"])

    sample = training_rows(docs, per_lang, fold, max_langs)
    got = sample.mapInArrow(cut, "x binary, l string").repartition(1).mapInArrow(fit, "langs array<string>, net binary").first()
    return (pickle.loads(got["net"]), list(got["langs"])) if got else ({}, [])


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify_language(docs: DataFrame, net: dict, langs: list[str], out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (the mean probability of that language)."""
    if not langs:
        return docs.withColumns({out[0]: F.lit(UND), out[1]: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers, whatever the data
    kind = pa.struct([("k", pa.int32()), ("p", pa.float64())])

    @F.arrow_udf("k int, p double")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in parts:
            best, top = [], []
            for lo, hi, data, offs in blocks(arr, 1 << 20):
                x, owner, real = windows(data, offs)
                total = np.zeros((hi - lo, len(langs)))
                np.add.at(total, owner, forward(shared.value, x) * real[:, None])
                total /= np.maximum(np.diff(offs), 1)[:, None]
                best.append(total.argmax(1))
                top.append(total.max(1))
            join = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
            yield pa.StructArray.from_arrays([pa.array(join(best, int), pa.int32()), pa.array(join(top, float), pa.float64())], fields=list(kind))

    letter = has_letter("text")
    rows = docs.withColumn("__p", predict("text"))
    return rows.withColumns({
        out[0]: F.when(letter, F.element_at(F.array(*map(F.lit, langs)), F.col("__p.k") + 1)).otherwise(UND),
        out[1]: F.when(letter, F.least(F.col("__p.p"), F.lit(1.0))).otherwise(0.0),
    }).drop("__p")


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify_language(docs.select("doc_id", "text"), *train_langid(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
