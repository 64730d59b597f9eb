"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

First pass: each task keeps a count-min sketch of document frequencies by language (DEPTH rows of 2**bits counts that stop at
MIN_DOCS). Merged, it never underestimates, so a term whose least count is below MIN_DOCS can't be kept. Second pass: the terms that pass
are counted exactly, by (lang, term, source) within blocks of text first; only these counts are shuffled. Terms in MIN_DOCS documents are kept.

Divergence from source o is the sum over all V kept terms of f(p, q). Terms that a source lacks have its least share, so the sum is
V f(p0, q0), plus what the terms of one source change (from the numbers of terms with each count), plus what the terms of both change,
which is a join of sources by term: only terms that occur in both make rows, and these are summed before they are shuffled.

Terms are runs of letters and characters beyond ASCII; only A to Z are lower-cased. Nulls in text, lang and source count as ''. A repeated row is a
document of its own. A group without terms has the count 0 for each kept term; without kept terms all values are 0 and there are no
terms. Ties in value are ordered by the bytes of the item. An empty table gives an empty result. Whole texts are read in blocks; memory grows
with the longest text. Groups are joined by broadcast only if they are counted to be MANY rows at most; beyond, by shuffle. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import blocks, mix
from ._grams import BLOCK, CHUNKS, Buckets, byte_classes, hashes, is_set, reached, runs, words
from ._shared import cut

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
DEPTH, BITS = 2, 24
MANY = 10_000
_LETTERS = byte_classes([range(65, 91), range(97, 123), range(128, 256)], [])


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bucket of each hash in each row of the sketch."""
    for row in range(DEPTH):
        yield (mix(h + np.uint64(row)) >> np.uint64(64 - bits)).astype(np.int64) + (row << bits)


def _by_lang(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(h ^ (lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _coded(values: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct values, the code of each row, and a number of each value that is the same in all tasks."""
    c = values.dictionary_encode()
    names = c.dictionary
    return names.to_pylist(), np.asarray(c.indices, np.int64), hashes(names.cast(pa.large_binary())).astype(np.int64)


def frequency_sketch(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = BITS) -> np.ndarray:
    """For each bucket of the count-min sketch of (lang, term) whether its document frequency may reach min_docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Buckets(DEPTH << bits, min_docs)
        for b in batches:
            _, lang, number = _coded(b.column(1))
            for lo, hi, data, offs in blocks(b.column(0), BLOCK):
                spelled, code, text, _ = words(data, offs, _LETTERS)
                pair, _, _ = runs(text * len(spelled) + code)  # once a document
                key, _, times = runs(lang[lo:hi][pair // max(1, len(spelled))] * len(spelled) + pair % max(1, len(spelled)))
                h = _by_lang(hashes(spelled)[key % max(1, len(spelled))], number[key // max(1, len(spelled))])
                for at in _places(h, bits):
                    sketch.add(at, times)
        yield from sketch.batches()

    return reached(docs.select("text", "lang").mapInArrow(count, CHUNKS), DEPTH << bits, min_docs)


def term_counts(docs: DataFrame, may: np.ndarray, bits: int = BITS) -> DataFrame:
    """(lang, term, source, docs, n): documents and occurrences of the terms that the sketch lets pass, as sums of blocks of text."""
    shared = docs.sparkSession.sparkContext.broadcast(may)  # DEPTH * 2**bits bits, whatever the data

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            langs, lang, number = _coded(b.column(1))
            sources, source, _ = _coded(b.column(2))
            for lo, hi, data, offs in blocks(b.column(0), BLOCK):
                spelled, code, text, _ = words(data, offs, _LETTERS)
                k = max(1, len(spelled))
                h = hashes(spelled)
                passes = np.zeros((len(langs), k), bool)
                for i in range(len(langs)):
                    if len(h):
                        x = _by_lang(h, number[i : i + 1])
                        passes[i] = np.logical_and.reduce([is_set(bitmap, at) for at in _places(x, bits)])
                keep = passes[lang[lo:hi][text], code]
                pair, _, times = runs(text[keep] * k + code[keep])
                d, c = pair // k, pair % k
                group = (lang[lo:hi][d] * len(sources) + source[lo:hi][d]) * k + c
                order = np.argsort(group, kind="stable")
                s = group[order]
                at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
                s = s[at]
                if not len(s):
                    continue
                n = np.add.reduceat(times[order], at)
                took = np.diff(np.append(at, len(order)))
                g = s // k
                yield pa.RecordBatch.from_arrays([
                    pa.array(langs, pa.string()).take(pa.array(g // len(sources))), spelled.take(pa.array(s % k)).cast(pa.large_string()).cast(pa.string()),
                    pa.array(sources, pa.string()).take(pa.array(g % len(sources))), pa.array(took, pa.int64()), pa.array(n, pa.int64()),
                ], ["lang", "term", "source", "docs", "n"])

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, term string, source string, docs bigint, n bigint")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = BITS) -> DataFrame:
    """(lang, term, total, at): for each term in min_docs documents of its language its occurrences there and, as at, those by source (source, n)."""
    rows = term_counts(docs, frequency_sketch(docs, min_docs, bits), bits)
    each = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    found = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("at"))
    return found.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "at")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + terms)), exactly."""
    small = count < 9_000_000_000
    quick = F.call_function("div", F.when(small, count + 1).otherwise(F.lit(1)) * F.lit(SCALE), total + terms)
    wide = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))
    return F.when(small, quick).otherwise(wide) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = BITS, many: int = MANY) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other sources of the language, part ``term`` the first top terms."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    terms = cut(kept_terms(docs, min_docs, bits))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    posts = terms.select("lang", "term", "total", F.inline("at"))
    had = posts.groupBy("lang", "source").agg(F.sum("n").alias("n_own"))
    groups = docs.select("lang", "source").distinct().join(had, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n_own", "v", "n_lang"])
    none = F.lit(0).cast("long")
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(none, F.col("n_own"), F.col("v"))).otherwise(1)))
    few = groups.count() <= many
    maybe = F.broadcast if few else (lambda df: df)

    posts = posts.join(maybe(groups), ["lang", "source"])
    posts = posts.withColumn("p", share(F.col("n"), F.col("n_own"), F.col("v")))
    q = share(F.col("total"), F.col("n_lang"), F.col("v"))
    of_terms = posts.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = of_terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    pairs = groups.select("lang", "source", "p0", "v").join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").filter("source <> item")
    hist = posts.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("ps"))
    base = distance(F.col("p0"), F.col("q0"))

    def alone(change) -> Column:
        return F.coalesce(F.aggregate("ps", none, lambda s, x: s + x["k"] * (change(x["p"]) - base)), none)

    sizes = pairs.join(maybe(hist), ["lang", "source"], "left").select("lang", "source", "item", "p0", "q0", "v", alone(lambda p: distance(p, F.col("q0"))).alias("own"))
    other = hist.withColumnRenamed("source", "item")
    sizes = sizes.join(maybe(other), ["lang", "item"], "left").select("lang", "source", "item", "v", base.alias("base"), "own", alone(lambda p: distance(F.col("p0"), p)).alias("others"))

    # both sides of the join by term read one exchange; no term has more rows than its language has sources
    mine = posts.select("lang", "term", "source", "p", "p0")
    theirs = mine.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = mine.join(theirs, ["lang", "term"]).filter("source <> item")
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    shared = both.groupBy("lang", "source", "item").agg(F.sum(distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)).alias("both"))
    value = F.when(F.col("v") > 0, F.col("v") * F.col("base") + F.col("own") + F.col("others") + F.coalesce("both", none)).otherwise(none)
    of_pairs = sizes.join(shared, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    of_pairs = of_pairs.withColumn("rank", F.row_number().over(best))
    return of_pairs.unionByName(of_terms).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY 1),
g AS (SELECT s.lang, s.source, coalesce((SELECT sum(c.n) FROM c SEMI JOIN k ON c.lang = k.lang AND c.term = k.term WHERE c.lang = s.lang AND c.source = s.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS BIGINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS BIGINT) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p)::HUGEINT * (a.p - b.p)) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
al AS (SELECT a.lang, a.source, b.source AS item, coalesce(pr.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
te AS (SELECT lang, source, term AS item, ((p - q)::HUGEINT * (p - q)) // q AS value FROM x WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM al
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM te) WHERE rank <= 200"""
