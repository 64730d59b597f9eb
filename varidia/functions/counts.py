"""Expressions over the four read counts a, c, g and t of a sample at a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
COUNTS = ("a", "c", "g", "t")
PAIRS = ("ac", "ag", "at", "cg", "ct", "gt")


def depth() -> Column:
    return F.col("a") + F.col("c") + F.col("g") + F.col("t")


def filter_minor(df: DataFrame, maf: float) -> DataFrame:
    """Counts below ``maf`` of the unfiltered depth become 0; all four are compared with the same depth."""
    return df.withColumns({n: F.when(F.col(n) < F.lit(float(maf)) * depth(), F.lit(0)).otherwise(F.col(n)).cast("long") for n in COUNTS})


def products() -> dict[str, Column]:
    return {p: F.col(p[0]) * F.col(p[1]) for p in PAIRS}


def pairs_of_reads() -> Column:
    """The number of pairs of reads at the site; null below two reads."""
    return F.when(depth() > 1, depth().cast("double") * (depth() - 1) / 2)


def site_pi() -> Column:
    """The share of pairs of reads that differ; 0 below two reads."""
    total = sum((c.cast("double") for c in list(products().values())[1:]), products()["ac"].cast("double"))
    return F.coalesce(total / pairs_of_reads(), F.lit(0.0))


def frequency(base: str, reference: Column) -> Column:
    """Share of a base among the reads; without reads, whether it's the reference base."""
    return F.when(depth() > 0, F.col(base.lower()).cast("double") / depth()).otherwise((F.coalesce(reference, F.lit("N")) == base).cast("double"))


def consensus(reference: Column) -> Column:
    """The base with the most reads, ties to the first of A, C, G, T; without reads the reference base (N if unknown)."""
    a, c, g, t = (F.col(n) for n in COUNTS)
    most = F.when((a >= c) & (a >= g) & (a >= t), "A").when((c >= g) & (c >= t), "C").when(g >= t, "G").otherwise("T")
    known = F.when(reference.isin(*BASES), reference).otherwise("N")
    return F.when(depth() > 0, most).otherwise(known)


def complement(base: Column) -> Column:
    return F.translate(base, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))
