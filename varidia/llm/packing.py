"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document longer than a bin is cut: pieces of a whole bin stay alone, the rest is packed. No bin holds two
pieces of one duplicate cluster (equal texts but for case and white space, unless a column says otherwise) and,
among packed pieces, none holds more than ``per_source`` (one) of one source. Within a shard, pieces go largest first. Open bins are kept
in the order of their residual space; each bin carries a bitmap of its sources (one for each piece that a source may have) and one of its clusters. The
search starts at the smallest residual that is large enough and goes on to its successors until a bin without a
conflict is found, which is the tightest compatible one; else a new bin opens.

Documents are dealt to shards of about ``shard_rows`` by a hash of doc_id, text and copy number, so memory and
search are bounded, and hot sources and clusters are spread over all shards. Shards are a function of the data
alone: reruns agree. Null text has no words; documents without words take a place of size 0. Rows that repeat
are separate documents and, being one cluster, get separate bins. Null source is a source of its own. Extra
columns aren't used; an empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import word_count

CAPACITY = 2048
SHARD_ROWS = 2000
CHUNK = 100_000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int = 1) -> list[int]:
    """The bin of each piece; sources and clusters are small numbers, one bit of a bitmap each.

    Bitmap k of a bin's sources has those with more than k pieces.
    """
    bins: list[int] = [-1] * len(sizes)
    open_bins: list[tuple[int, int]] = []  # residual, bin
    has_source: list[list[int]] = []
    has_cluster: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size, s, c = sizes[k], 1 << sources[k], 1 << clusters[k]
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (has_source[b := open_bins[at][1]][-1] & s or has_cluster[b] & c):
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(has_source)
            has_source.append([0] * per_source)
            has_cluster.append(0)
        level = next(i for i, bits in enumerate(has_source[b]) if not bits & s)
        has_source[b][level] |= s
        has_cluster[b] |= c
        bins[k] = b
        insort(open_bins, (residual - size, b))
    return bins


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: str | None = None, per_source: int = 1) -> DataFrame:
    """bin_id, doc_id, source, piece, first_word, words, bin_words, bin_pieces: a row for each piece of a document."""
    text = F.coalesce("text", F.lit(""))
    same = F.col(cluster).cast("string") if cluster else F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(same).alias("cluster"), F.xxhash64("doc_id", text).alias("h"))
    shards = max(1, -(-docs.count() // shard_rows))
    # copies of one document differ by nothing: a salt that only depends on the row's place would not rerun alike, so they
    # are counted and dealt out by number
    rows = rows.groupBy("doc_id", "source", "size", "cluster", "h").agg(F.count("*").alias("n"))
    # a document with more copies than CHUNK is dealt to several tasks before it is repeated
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK)))).repartition("h", "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, last)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("h", "copy"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "copy", "cluster", "source"], kind="stable").reset_index(drop=True)
        full = (pdf["size"] // capacity).tolist()
        rest = (pdf["size"] % capacity).tolist()
        code = pdf["source"].factorize(use_na_sentinel=False)[0].tolist()
        clusters = pdf["cluster"].factorize()[0].tolist()
        packed = [i for i in range(len(pdf)) if rest[i] or not full[i]]
        bins = best_fit([rest[i] for i in packed], [code[i] for i in packed], [clusters[i] for i in packed], capacity, per_source)
        rows = [(b, i, full[i], full[i] * capacity, rest[i]) for b, i in zip(bins, packed, strict=True)]
        top = max(bins, default=-1) + 1
        for i, n in enumerate(full):
            for piece in range(n):
                rows.append((top, i, piece, piece * capacity, capacity))
                top += 1
        out = pd.DataFrame(rows, columns=["bin", "at", "piece", "first_word", "words"])
        out["doc_id"] = pdf["doc_id"].astype("Int64").array.take(out["at"])
        out["source"] = pdf["source"].to_numpy()[out["at"]]
        by = out.groupby("bin")["words"]
        out["bin_words"], out["bin_pieces"] = by.transform("sum"), by.transform("size")
        out["bin_id"] = pdf["shard"].iloc[0].astype("int64") * (1 << 32) + out["bin"]
        return out[["bin_id", "doc_id", "source", "piece", "first_word", "words", "bin_words", "bin_pieces"]]

    return rows.groupBy("shard").applyInPandas(run, "bin_id bigint, doc_id bigint, source string, piece bigint, first_word bigint, words bigint, bin_words bigint, bin_pieces bigint")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
