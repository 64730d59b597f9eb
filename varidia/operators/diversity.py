"""Diversity of samples and contigs from diversity of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_pi(sites: DataFrame, by: list[str], length) -> DataFrame:
    """Sum of site diversities over a length, by group."""
    return sites.groupBy(*by).agg((F.sum("pi") / length).alias("pi"))


def sample_pi(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """Diversity of each sample over the whole reference."""
    total = contigs.agg(F.sum("length").alias("__total"))  # one row
    sums = sites.groupBy("sample_id").agg(F.sum("pi").alias("__pi"))
    return sums.crossJoin(F.broadcast(total)).select("sample_id", (F.col("__pi") / F.col("__total")).alias("pi"))


def contig_pi(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """Diversity of each sample on each contig on which some sample has a variant site; 0 where it has no reads."""
    sums = sites.groupBy("sample_id", "contig").agg(F.sum("pi").alias("__pi"))
    every = sites.select("sample_id").distinct().crossJoin(contigs.select("contig", "length"))
    out = every.join(sums, ["sample_id", "contig"], "left")
    return out.select("sample_id", "contig", F.col("length").alias("contig_length"), (F.coalesce("__pi", F.lit(0.0)) / F.col("length")).alias("pi"))


def window_pi(sites: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """Diversity of windows of ``width`` bases side by side; the last one of a contig may be shorter."""
    start = (F.floor(F.col("pos") / width) * width).cast("long")
    sums = sites.groupBy("sample_id", "contig", start.alias("start")).agg(F.sum("pi").alias("__pi"))
    size = F.least(F.lit(width), F.col("length") - F.col("start"))
    return sums.join(contigs.select("contig", "length"), "contig").select("sample_id", "contig", "start", size.alias("window_length"), (F.col("__pi") / size).alias("pi"))


def weighted_pi(parts: DataFrame) -> DataFrame:
    """Diversity of samples from parts (sample_id, pi, length) of the reference."""
    return parts.groupBy("sample_id").agg((F.sum(F.col("pi") * F.col("length")) / F.sum("length")).alias("pi"))
