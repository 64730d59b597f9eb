"""Phrase collocation mining by hashed buckets and Apriori pruning.

Four passes over the text. Pass k counts phrases of k words exactly, by language, and at the same time counts the phrases of k + 1
words, whose parts it hasn't ruled out, in 2**BITS buckets whose counts stop at the minimum. From each pass two bitmaps are broadcast,
whose size doesn't depend on the data: the buckets that reach the minimum, and the hashes of the phrases that do. A phrase of k + 1 words
is counted in the next pass only if its bucket and both of its parts are set. Bitmaps never miss a phrase that reaches the minimum,
and the exact counts drop those that only seemed to. Counts are summed within tasks before they are shuffled.

Words are `[^\\x20\\x09]+` in the pieces that `[.,;:!?\\x0A-\\x0D]` leave, A to Z as small letters. A null text is empty, a null lang is ``und``.
Repeated rows count again; overlapping occurrences all count. Ties of cuts go to the smallest k, ties of rank to the bytes of the phrase. An empty
table, or no phrase that reaches the minimum, gives an empty result. Whole texts are read in blocks; memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import blocks, mix
from ._grams import Buckets, bitmap, byte_classes, hashes, is_set, reached, runs, words
from ._shared import removed, written

LONGEST = 4
MIN_COUNT = 30
SHARE = 80
TOP = 2000
BITS, FREQUENT_BITS = 25, 26
HELD = 1 << 18
PIECE = 2 << 20  # bytes of text at a time
_MARKS = byte_classes([range(0, 9), range(14, 32), range(33, 256)], [*b".,;:!?", *range(0x0A, 0x0E)])
_ROWS = "lang string, phrase string, h bigint, n bigint, part int, places binary, counts binary"
_NAMES = ["lang", "phrase", "h", "n", "part", "places", "counts"]


def _row_batch(counted: pa.Table | None = None, chunks: pa.RecordBatch | None = None) -> Iterator[pa.RecordBatch]:
    size = len(counted) if counted is not None else len(chunks)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    have = dict(zip(counted.column_names, counted.columns, strict=True)) if counted is not None else dict(zip(chunks.schema.names, chunks.columns, strict=True))
    yield from pa.table([have[n].cast(t) if n in have else pa.nulls(size, t) for n, t in zip(_NAMES, kinds, strict=True)], names=_NAMES).to_batches(max_chunksize=1 << 16)


def _summed(held: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(held).group_by(["lang", "phrase", "h"]).aggregate([("n", "sum")])
    return t.rename_columns(["lang", "phrase", "h", "n"])


def _set(bits: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    return is_set(bits, (h >> np.uint64(64 - width)).astype(np.int64))


def _grams(data: np.ndarray, offs: np.ndarray, lang: np.ndarray, number: np.ndarray, k: int, frequent: np.ndarray | None, bucket: np.ndarray | None, bits: int, next_buckets: Buckets | None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of one block: language, phrase, hash and occurrences of each phrase of k words that the bitmaps let pass; counts those of k + 1 in their buckets."""
    spelled, code, text, piece = words(data, offs, _MARKS)
    m, size = len(code), max(1, len(spelled))
    word = hashes(spelled)[code]
    of = lang[text]
    start = mix(word ^ number[of])
    gram = [start]  # by length, the hash of the phrase that begins at each word
    for j in range(1, k + 1):
        last = gram[-1]
        fits = max(0, m - j)
        gram.append(mix(last[:fits] * np.uint64(0x9E3779B97F4A7C15) + word[j : j + fits]))
    inside = [piece[: max(0, m - j)] == piece[j:] for j in range(k + 1)]
    passes = inside[k - 1].copy()
    if k > 1:
        part = _set(frequent, gram[k - 2], FREQUENT_BITS)
        passes &= part[: len(passes)] & part[1 : len(passes) + 1]
        at = np.flatnonzero(passes)
        passes[at[~_set(bucket, gram[k - 1][at], bits)]] = False
    if next_buckets is not None and m > k:
        longer = np.flatnonzero(inside[k] & passes[: m - k] & passes[1 : m - k + 1])
        next_buckets.add((gram[k][longer] >> np.uint64(64 - bits)).astype(np.int64))
    at = np.flatnonzero(passes)
    key = of[at] * size + code[at]
    for j in range(1, k):
        _, key = np.unique(key, return_inverse=True)
        key = key.astype(np.int64) * size + code[at + j]
    _, first, times = runs(key)
    at = at[first]
    phrase = [spelled.take(pa.array(code[at + j])) for j in range(k)]
    joined = pc.binary_join_element_wise(*phrase, pa.scalar(b" ", pa.large_binary())) if k > 1 else phrase[0]
    return of[at], joined, gram[k - 1][at], times


def _pass(docs: DataFrame, k: int, frequent: np.ndarray | None, bucket: np.ndarray | None, min_count: int, bits: int) -> DataFrame:
    """Rows of counts of phrases of k words, and of the buckets of those of k + 1."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, bucket))  # bits, whatever the data

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_buckets = Buckets(1 << bits, min_count) if k < LONGEST else None
        held: list[pa.Table] = []
        for b in batches:
            c = b.column(1).dictionary_encode()
            langs, lang = c.dictionary, np.asarray(c.indices, np.int64)
            number = hashes(langs.cast(pa.large_binary()))
            for lo, hi, data, offs in blocks(b.column(0), PIECE):
                of, phrase, h, n = _grams(data, offs, lang[lo:hi], number, k, *shared.value, bits, next_buckets)
                if len(n):
                    held.append(pa.table([langs.take(pa.array(of)), phrase.cast(pa.large_string()), pa.array(h.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "phrase", "h", "n"]))
                if sum(map(len, held)) > HELD:
                    held = [_summed(held)]
                    if len(held[0]) > HELD // 2:
                        yield from _row_batch(held.pop())
        if held:
            yield from _row_batch(_summed(held))
        if next_buckets is not None:
            for chunks in next_buckets.batches():
                yield from _row_batch(chunks=chunks)

    return docs.mapInArrow(count, _ROWS)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f): all phrases of 1 to LONGEST words that occur min_count times in a language; and (lang, n), its words. Both are written tables."""
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    cap = min(min_count, 255)
    frequent = bucket = totals = None
    found = []
    for k in range(1, LONGEST + 1):
        rows, path = written(_pass(docs, k, frequent, bucket, cap, bits), f"phrases{k}")
        counts = rows.filter("part IS NULL")
        if totals is None:
            totals, _ = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        exact = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("h").alias("h")).filter(F.col("f") >= min_count)
        exact, _ = written(exact, f"frequent{k}")
        found.append(exact.select("lang", "phrase", F.lit(k).alias("size"), "f"))
        if k < LONGEST:
            bucket = reached(rows.filter("part IS NOT NULL").select("part", "places", "counts"), 1 << bits, cap)
            frequent = bitmap(exact.select("h"), FREQUENT_BITS)
        removed(spark, path)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out, totals


def _score(a: Column, both: Column) -> Column:
    """floor(2000000 a / both); the product may pass 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(10,0)"), both.cast("decimal(20,0)"))


def _piece(start, size) -> Column:
    return F.array_join(F.slice("w", start, size), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by the score of their weakest cut."""
    known, totals = frequent_phrases(docs, min_count, bits)
    cand = known.filter("size > 1").withColumn("w", F.split("phrase", " ", -1))

    cuts = cand.select("lang", "phrase", "size", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _piece(F.lit(1), F.col("k")).alias("first"), _piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = known.filter(F.col("size") < LONGEST).select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(part.toDF("lang", "first", "l"), ["lang", "first"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
    weakest = F.min(F.struct(_score(F.col("a"), F.col("l") + F.col("r")).alias("score"), "k", "l", "r")).alias("x")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), weakest).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    inner = cand.filter("size > 2").select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", _piece(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("rank", F.col("rank").cast("long"))


OP12_SQL = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, cut.k, gx.f AS l, gy.f AS r, CAST((2000000::HUGEINT * a) // (gx.f + gy.f) AS BIGINT) AS score FROM cut JOIN g gx ON gx.lang = cut.lang AND gx.phrase = x JOIN g gy ON gy.lang = cut.lang AND gy.phrase = y
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, cut.k) = 1),
inn AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT lang, w, f, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT lang, w, a AS f, size, unnest(range(2, size)) AS m FROM c)) GROUP BY 1, 2),
k AS (SELECT s.* FROM s LEFT JOIN inn USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
