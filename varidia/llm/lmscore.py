"""Stupid-backoff scores of documents by an n-gram model counted on all of the corpus.

Words are runs of non-space bytes in lower case (ASCII and Latin-1). A word w after v scores c(v w) / c(v) if the pair occurs
min_count times or more in the corpus, else alpha c(w) / N; a first word scores c(w) / N. A document's log_score
is the sum of the logs, and mean_log that over its words. With min_count 1, the default and that of op3_lmscore, nothing is pruned.

score_documents is of order 2 and made for large inputs. Counting covers all documents. Word counts are partitioned by hash. The
TOP most frequent words have numbers of their own, and their counts are a table of fixed size that is broadcast; the others,
rare ones, are numbered by 45 bits of their hash, so one shares a count with another with a probability of their number
over 2**45. A pair is a number of 64 bits, which holds both words unless both are rare; the second one then has a column.
First words of a document need no pair: frequent ones are scored where they are read, rare ones make a row. Pairs of two of the
HEAVY most frequent words, which would be hot keys, are counted in a table of fixed size and scored where they are read.
All other pairs are exploded to (document, pair), partitioned once by the pair's hash, counted there, joined with
that count table and summed by document. The table holds the pairs that reach min_count, and those whose score
takes the count of a rare word, each with its score; a pair without a row there backs off to its second
word, whose count is looked up in the broadcast table.

score_ngrams takes any order and hashes nothing: n-grams are strings, their count table is partitioned by Spark's hash and
joined to the exploded n-grams and to their contexts. It is the exact way, at some ten times the shuffle.

Rows with one doc_id count as one document (so do those with a null one). Null text has no words; a document
without words has log_score 0 and a null mean. Very long texts are read in slices of words by score_documents, in one row
by score_ngrams. Other columns aren't used. An empty table gives no rows. The table of word counts stays until the
process ends, as the result reads it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, mix, segment_sum, token_hashes
from ._shared import written

TOP = (1 << 17) - 1
HEAVY = 768
START = TOP  # the number before a first word
RARE = 1 << 46  # added to the 45 bits of rare words
M17, M45, M62 = (1 << 17) - 1, (1 << 45) - 1, (1 << 62) - 1
ALPHA = 0.4
MIN_COUNT = 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in blocks(batch.column(0)):
            h, n = np.unique(token_hashes(data, offs)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): the hash of each distinct word and how often it occurs."""
    return docs.select("text").mapInArrow(_count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame, top: int) -> tuple[pd.DataFrame, int]:
    """The top most frequent words (to 9 % of a count) with their counts, and the sum of all counts.

    Sizes of levels of counts say which levels to take whole and which share, by the hash's low bits, of the next one;
    so no task's own best words are gathered.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()  # some 500 rows at most
    least, part, share, room = 1 << 30, -1, 0, top
    for r in sorted(sizes, reverse=True):
        if r["n"] > room:
            part, share = r["level"], (room << 19) // r["n"]
            break
        least, room = r["level"], room - r["n"]
    chosen = counts.filter((level >= least) | ((level == part) & (F.col("h").bitwiseAND(F.lit((1 << 19) - 1)) < share)))
    best = chosen.select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True]).head(top)
    return best, sum(r["c"] for r in sizes) or 1


class Words:
    """Numbers of words: their places among the most frequent, or else a number made from the hash.

    A table by the hash's first bits holds the most frequent word with those bits; only words that meet another one
    there are searched for.
    """

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.table = np.full(1 << 20, -1, np.int64)
        for k in range(len(hashes) - 1, -1, -(1 << 16)):  # from the end, so that the most frequent word stays
            part = np.arange(k, max(-1, k - (1 << 16)), -1)
            slot, first = np.unique((hashes[part] >> np.uint64(44)).astype(np.int64)[::-1], return_index=True)
            self.table[slot] = part[::-1][first]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return self._rare(h)
        at = self.table[(h >> np.uint64(44)).astype(np.int64)]
        out = at.astype(np.uint64)
        other = np.flatnonzero((at < 0) | (self.hashes[at] != h))
        out[other] = self._rare(h[other])
        met = other[at[other] >= 0]
        place = np.minimum(np.searchsorted(self.sorted, h[met]), len(self.sorted) - 1)
        found = self.sorted[place] == h[met]
        out[met[found]] = self.order[place[found]]
        return out

    def _rare(self, h: np.ndarray) -> np.ndarray:
        return np.uint64(RARE) + (h >> np.uint64(19))


def _pairs(words: Words, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words, of the words before them (START for first ones), and bounds of documents."""
    h, bounds = token_hashes(data, offs)
    w = words.numbers(h)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[bounds[:-1][bounds[:-1] < bounds[1:]]] = START
    return v, w, bounds


def pair_numbers(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair, and the places of pairs of two rare words.

    Its two highest bits say which word is rare: 0 none (v, w: 17 bits each), 1 the second (v 17, w 45), 2 the first
    (w 17, v 45), 3 both (62 bits, from which w gives v).
    """
    low17, low45 = np.uint64(17), np.uint64(45)
    pair = v << low17 | w
    rv, rw = v >= RARE, w >= RARE
    for tag, at in ((1, np.flatnonzero(rw & ~rv)), (2, np.flatnonzero(rv & ~rw))):
        known, rare = (v[at], w[at]) if tag == 1 else (w[at], v[at])
        pair[at] = np.uint64(tag << 62) | known << low45 | rare & np.uint64(M45)
    both = np.flatnonzero(rv & rw)
    pair[both] = np.uint64(3 << 62) | (v[both] & np.uint64(M45)) << low17 ^ w[both] & np.uint64(M45)
    return pair, both


def score_documents(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, top: int = TOP, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log); top is TOP at most."""
    if not 0 <= heavy <= top <= TOP:
        raise ValueError(f"heavy is {heavy} and top {top}; 0 <= heavy <= top <= {TOP}")
    spark = docs.sparkSession
    docs = docs.select("text", "doc_id")
    counts, _ = written(word_counts(docs), "words")
    best, total = frequent_words(counts, top)
    hashes, c_top = best["h"].to_numpy(np.int64).view(np.uint64), best["c"].to_numpy(np.int64)
    heavy = min(heavy, len(best))
    shared = spark.sparkContext.broadcast((hashes, c_top.astype(np.float64)))

    def count_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(shared.value[0][:heavy]), np.zeros(heavy * heavy, np.int64)
        for batch in batches:
            for _, _, data, offs in blocks(batch.column(0)):
                v, w, _ = _pairs(words, data, offs)
                both = (v < heavy) & (w < heavy)
                table += np.bincount((v[both] * np.uint64(heavy) + w[both]).astype(np.int64), minlength=heavy * heavy)
        at = np.flatnonzero(table)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], ["p", "n"])

    rows = docs.mapInArrow(count_heavy, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).toPandas()  # heavy**2 rows at most
    pair_counts = np.zeros(heavy * heavy, np.int64)
    pair_counts[rows["p"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    shared_pairs = spark.sparkContext.broadcast(pair_counts)
    back = math.log(alpha) - math.log(total)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's words, and its score from frequent first words and pairs of HEAVY words."""
        (h_top, c1), pairs = shared.value, shared_pairs.value
        words = Words(h_top)
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column(0), 1 << 20):
                v, w, bounds = _pairs(words, data, offs)
                value = np.zeros(len(v))
                both = (v < heavy) & (w < heavy)
                vi, wi = v[both].astype(np.int64), w[both].astype(np.int64)
                c2 = pairs[vi * heavy + wi]
                value[both] = np.where(c2 >= min_count, np.log(np.maximum(c2, 1)) - np.log(c1[vi]), back + np.log(c1[wi]))
                first = (v == START) & (w < len(c1))
                value[first] = np.log(c1[w[first].astype(np.int64)]) - math.log(total)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(segment_sum(value, bounds))], ["doc_id", "n", "value"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All other pairs; ``rare`` is the second word of two rare ones."""
        h_top, c1 = shared.value
        words = Words(h_top)
        for batch in batches:
            ids = batch.column(1)
            for lo, hi, data, offs in blocks(batch.column(0), 1 << 20):
                v, w, bounds = _pairs(words, data, offs)
                rest = np.flatnonzero(~((v < heavy) & (w < heavy) | (v == START) & (w < len(c1))))
                owner = np.repeat(np.arange(lo, hi), np.diff(bounds))[rest]
                pair, both = pair_numbers(v[rest], w[rest])
                second, none = np.zeros(len(rest), np.int64), np.ones(len(rest), bool)
                second[both], none[both] = (w[rest[both]] & np.uint64(M45)).astype(np.int64), False
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(pair.view(np.int64)), pa.array(second, mask=none)], ["doc_id", "pair", "rare"])

    placed = docs.mapInArrow(explode, "doc_id bigint, pair bigint, rare bigint").filter("pair is not null").repartition("pair")
    # all columns are used, so that this reads the very exchange that the join below reads
    types = placed.groupBy("pair").agg(F.count("*").alias("c2"), F.count("doc_id").alias("d"), F.max("rare").alias("hidden"))
    types = types.filter((F.col("c2") > 0) & (F.col("d") >= 0))
    tag, bits = F.shiftrightunsigned("pair", 62), lambda shift, mask: F.shiftrightunsigned("pair", shift).bitwiseAND(F.lit(mask))
    hidden = F.col("hidden")
    v = F.when(tag == 0, bits(17, M17)).when(tag == 1, bits(45, M17)).when(tag == 2, bits(0, M45)).otherwise(F.shiftrightunsigned(bits(0, M62).bitwiseXOR(hidden), 17))
    w = F.when(tag == 1, bits(0, M45)).when(tag == 3, hidden)  # null if it isn't rare
    first = ((tag == 0) & (bits(17, M17) == START)) | ((tag == 1) & (bits(45, M17) == START))
    # first words never count as pairs; a condition on pair alone would go below the exchange, which then were another one
    kept = F.when(first, -F.col("c2")).otherwise(F.col("c2")) >= min_count
    types = types.withColumns({"kept": kept, "need": F.when(kept, v).otherwise(w), "kind": F.when(kept, tag).otherwise(tag + 4)})
    alone = lambda log_c1: log_c1 + F.when(first, -math.log(total)).otherwise(back)
    value = F.when(F.col("kept"), F.log("c2") - F.col("log_c1")).otherwise(alone(F.col("log_c1")))
    frequent = spark.createDataFrame(pa.table({"need": np.arange(len(best), dtype=np.int64), "log_c1": np.log(np.maximum(c_top, 1).astype(np.float64))}))  # top rows at most
    rare = counts.join(F.broadcast(spark.createDataFrame(pa.table({"h": hashes.view(np.int64)}))), "h", "left_anti")
    rare = rare.groupBy(F.shiftrightunsigned("h", 19).alias("need")).agg(F.log(F.sum("c")).alias("log_c1"))
    near = types.filter("kind < 2").join(F.broadcast(frequent), "need").select("pair", value.alias("near"))
    far = types.filter("kind in (2, 3, 5, 7)").join(rare, "need").select("pair", value.alias("far"))
    second = F.broadcast(frequent.select(F.col("need").alias("w"), F.col("log_c1").alias("log_w")))
    known_second = F.when(F.col("rare").isNull(), F.when(tag == 0, bits(0, M17)).when(tag == 2, bits(45, M17)))  # reads rare, as types does: see above
    scored = placed.withColumn("w", known_second).join(second, "w", "left")
    scored = scored.join(near.hint("shuffle_hash"), "pair", "left").join(far.hint("shuffle_hash"), "pair", "left")
    scored = scored.select("doc_id", F.lit(0).cast("long").alias("n"), F.coalesce("near", "far", alone(F.col("log_w"))).alias("value"))
    return _summed(scored.unionByName(docs.mapInArrow(known, "doc_id bigint, n bigint, value double")))


def _summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("log_score"))
    return out.withColumn("mean_log", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


# The letters that words fold, as in token_hashes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
LOWER = "".join(chr(ord(c) + 0x20) for c in UPPER)


def score_ngrams(docs: DataFrame, order: int = 3, alpha: float = ALPHA, min_count: int = 1) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log) by a model of n-grams of up to ``order`` words, exactly.

    A word scores c(n-gram) / c(context) by the longest n-gram that ends in it and occurs min_count times or more, times
    alpha for each step down; a single word always counts. Equal rows are scored once and counted as often as they come.
    """
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    texts = docs.groupBy("doc_id", "text").agg(F.count("*").alias("times")).select("doc_id", "times", words.alias("w"))
    texts = texts.withColumn("key", F.sha2(F.array_join("w", " "), 256))
    gram = lambda k: F.when(F.col("i") >= k - 1, F.array_join(F.slice("w", F.col("i") - k + 2, F.lit(k)), " "))
    context = lambda k: F.when(F.col("i") >= k - 1, F.array_join(F.slice("w", F.col("i") - k + 2, F.lit(k - 1)), " "))
    levels = [F.struct(F.lit(k).alias("k"), gram(k).alias("gram"), context(k).alias("context")) for k in range(1, order + 1)]
    places = texts.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - 1))).filter("i >= 0 and size(w) > 0")
    rows = places.withColumn("least", F.least("i", F.lit(order - 1)) + 1).select("doc_id", "key", "i", "times", "least", F.explode(F.array(*levels)).alias("g")).select("doc_id", "key", "i", "times", "least", "g.*").filter("gram is not null")
    counts, _ = written(rows.groupBy("k", "gram").agg(F.sum("times").alias("c")), "grams")
    total = counts.filter("k = 1").agg(F.sum("c")).first()[0] or 1
    own = rows.join(counts, ["k", "gram"]).filter((F.col("c") >= min_count) | (F.col("k") == 1))
    before = counts.select((F.col("k") + 1).alias("k"), F.col("gram").alias("context"), F.col("c").alias("b"))
    own = own.join(before, ["k", "context"], "left").withColumn("value", F.log("c") - F.log(F.coalesce("b", F.lit(total))) + (F.col("least") - F.col("k")) * math.log(alpha))
    best = own.groupBy("doc_id", "key", "i").agg(F.max_by("value", "k").alias("value"), F.max("times").alias("times"))
    scored = best.select("doc_id", F.lit(0).cast("long").alias("n"), (F.col("value") * F.col("times")).alias("value"))
    return _summed(scored.unionByName(texts.select("doc_id", (F.size("w") * F.col("times")).cast("long").alias("n"), F.lit(0.0).alias("value"))))


def op3_lmscore(spark, sf_dir: str) -> DataFrame:
    """Every pair counts, those that occur once too: stupid backoff uses any count above 0."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_count=1)
